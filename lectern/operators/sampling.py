"""Reproducible samples: the same seed gives the same rows on every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scalars import overlap, unit
from lectern.operators.search import Target, _list


def head_and_tail(items: DataFrame, size: int, share: float, seed: int, key: str = "work_key", by: str = "popularity") -> DataFrame:
    """The best known share of size items and a random draw from the rest, marked by part.

    Two bounded top-k selections and an anti-join with the bounded head; no window over all rows.
    """
    top = max(1, int(size * share))
    head = items.orderBy(F.desc_nulls_last(by), key).limit(top)
    rest = items.join(head.select(key), key, "left_anti")
    tail = rest.orderBy(unit(key, seed), key).limit(max(0, size - top))
    return head.withColumn("part", F.lit("head")).unionByName(tail.withColumn("part", F.lit("tail")))


def fixed_size(items: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Exactly n rows (or all), by seeded hash order."""
    return items.orderBy(unit(key, seed), key).limit(n)


def weighted(items: DataFrame, n: int, weight: Column, seed: int, key: str) -> DataFrame:
    """n rows without replacement with probability in proportion to weight (exponential keys)."""
    u = (unit(key, seed) * 4294967296.0 + 0.5) / 4294967296.0
    return items.withColumn("draw", F.round(-F.ln(u) / weight, 9)).orderBy("draw", key).limit(n)


def capped(rows: DataFrame, group: str, cap: int, seed: int, key: str) -> DataFrame:
    """At most cap rows of each group, by seeded hash order."""
    w = Window.partitionBy(group).orderBy(unit(key, seed), key)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap)


#: Buckets of the histogram that finds the place of a hash threshold.
BUCKETS = 1 << 16


def split(rows: DataFrame, ratio: float, seed: int, key: str) -> DataFrame:
    """Marks max(1, int(n * ratio)) rows as valid, the others as train, by seeded hash order.

    A histogram of the hashes, of BUCKETS rows at most, tells in which bucket the threshold
    lies; only that bucket's rows are ordered. Rows are then marked where they are.
    """
    u = unit(key, seed)
    bucket = F.floor(u * BUCKETS)
    sizes = {r[0]: r[1] for r in rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()}
    left = max(1, int(sum(sizes.values()) * ratio))
    at = -1
    for b in sorted(sizes):
        at = b
        if left <= sizes[b]:
            break
        left -= sizes[b]
    edge = rows.filter(bucket == at).select(u.alias("u"), F.col(key).alias("k")).orderBy("u", "k").limit(left).agg(F.max(F.struct("u", "k"))).first()[0]
    if edge is None:
        return rows.withColumn("part", F.lit("train"))
    inside = (bucket < at) | ((bucket == at) & ((u < edge[0]) | ((u == edge[0]) & (F.col(key) <= F.lit(edge[1])))))
    return rows.withColumn("part", F.when(inside, "valid").otherwise("train"))


def tail_holdout(rows: DataFrame, order: str, n: int = 200, least: int = 600) -> DataFrame:
    """The last n rows by order are held out if there are more than least rows."""
    if rows.count() <= least:
        return rows.withColumn("part", F.lit("train"))
    last = rows.select(order).orderBy(F.desc(order)).limit(n).withColumn("is_valid", F.lit(True))
    return rows.join(last, order, "left").withColumn("part", F.when(F.col("is_valid"), "valid").otherwise("train")).drop("is_valid")


def hard_negatives(items: DataFrame, t: Target, n: int, seed: int, taken: Column) -> DataFrame:
    """Items that are near the target but wrong, with the kind of error, n of each kind at most.

    Same genre without a common mood, same mood without a common genre, wrong length, wrong era.
    """
    none = F.array().cast("array<string>")
    g = overlap(F.coalesce("genres", none), _list(t.genres)) if t.genres else F.lit(0)
    m = overlap(F.coalesce("moods", none), _list(t.moods)) if t.moods else F.lit(0)
    kinds = {
        "mood": (g > 0) & (m == 0) if t.genres else None,
        "genre": (m > 0) & (g == 0) if t.moods else None,
        "length": F.coalesce(F.col("length_bucket") != t.length, F.lit(True)) if t.length else None,
        "era": F.coalesce(F.col("era") != t.era, F.lit(True)) if t.era else None,
    }
    kind = F.array_compact(F.array(*[F.when(c, name) for name, c in kinds.items() if c is not None]))
    rows = items.filter(~taken).select("work_key", F.explode(kind).alias("kind"))
    w = Window.partitionBy("kind").orderBy(unit(F.concat("kind", "work_key"), seed), "work_key")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def informative(least_readers: int = 1) -> Column:
    """Known well enough, and with subjects or a description to go by."""
    return (F.coalesce("readers", F.lit(0)) >= least_readers) & ((F.size(F.coalesce("subjects", F.array().cast("array<string>"))) >= 2) | (F.length(F.coalesce("description", F.lit(""))) >= 60))


def numbered_candidates(rows: DataFrame, group: str, key: str, seed: int, cap: int = 12) -> DataFrame:
    """Each group's distinct items in seeded order, at most cap, with ids a1, a2, ..."""
    w = Window.partitionBy(group).orderBy(unit(F.concat(F.col(group).cast("string"), F.lit("/"), F.col(key).cast("string")), seed), key)
    x = rows.select(group, key).distinct().withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap)
    return x.withColumn("candidate_id", F.concat(F.lit("a"), F.col("place").cast("string")))

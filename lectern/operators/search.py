"""Search: BM25, dense vectors, rank fusion, match scores, filters, similar items."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scalars import all_of, overlap, unit
from lectern.session import written

RRF_K = 60


@dataclass(frozen=True)
class Target:
    """What a request asks for; empty parts ask for nothing."""

    genres: tuple[str, ...] = ()
    moods: tuple[str, ...] = ()
    era: str | None = None
    length: str | None = None
    audience: str | None = None
    languages: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    min_ratings: int = 0
    strict: bool = False


def _list(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _hits(column: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(F.array_compact(column), _list(values)), F.lit(False))


def passes(t: Target) -> Column:
    """Whether a book satisfies the target's filters; genres and moods filter only if strict."""
    c = []
    if t.exclude:
        c.append(~F.col("work_key").isin(*t.exclude))
    if t.min_ratings:
        c.append(F.col("rating_count") >= t.min_ratings)
    if t.languages:
        c.append(_hits("languages", t.languages))
    for name, value in (("era", t.era), ("length_bucket", t.length), ("audience", t.audience)):
        if value:
            c.append(F.coalesce(F.col(name) == value, F.lit(False)))
    if t.strict:
        c += [_hits(name, values) for name, values in (("genres", t.genres), ("moods", t.moods)) if values]
    return all_of(c)


def match_score(t: Target) -> Column:
    """How well a book fits the target, 0 to 1, with a small bonus for being well known."""
    parts: list[tuple[float, Column]] = []
    for weight, name, values in ((3.0, "genres", t.genres), (2.0, "moods", t.moods)):
        if values:
            parts.append((weight, F.least(F.lit(1.0), overlap(name, _list(values)) / len(values))))
    for weight, name, value in ((1.5, "era", t.era), (1.5, "length_bucket", t.length), (1.0, "audience", t.audience)):
        if value:
            parts.append((weight, F.when(F.col(name) == value, 1.0).otherwise(0.0)))
    if t.languages:
        parts.append((1.0, F.when(_hits("languages", t.languages), 1.0).otherwise(0.0)))
    known = F.coalesce("popularity", F.lit(0.0))
    if not parts:
        return 0.45 + 0.45 * known
    base = sum((w * c for w, c in parts), F.lit(0.0)) / sum(w for w, _ in parts)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.85 * base + 0.15 * known))


def match_reasons(t: Target) -> Column:
    """Evidence of a match as tags, genres and moods sorted."""
    tag = lambda prefix, name, values: F.transform(F.array_sort(F.array_intersect(F.coalesce(name, F.array().cast("array<string>")), _list(values))), lambda v: F.concat(F.lit(prefix), v))
    out = []
    if t.genres:
        out.append(tag("tür:", "genres", t.genres))
    if t.moods:
        out.append(tag("ruh:", "moods", t.moods))
    single = [F.when(F.col(name) == value, f"{prefix}{value}") for prefix, name, value in (("dönem:", "era", t.era), ("uzunluk:", "length_bucket", t.length)) if value]
    if t.languages:
        both = F.array_sort(F.array_intersect("languages", _list(t.languages)))
        single.append(F.when(F.size(both) > 0, F.concat(F.lit("dil:"), F.array_join(both, ","))))
    if single:
        out.append(F.array_compact(F.array(*single)))
    return F.concat(*out) if out else F.array().cast("array<string>")


def postings(docs: DataFrame, key: str, terms: Column) -> tuple[DataFrame, DataFrame]:
    """(postings: term, key, tf; lengths: key, dl) of texts given as term lists."""
    t = docs.select(key, terms.alias("terms"))
    return t.select(key, F.explode("terms").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf")), t.select(key, F.size("terms").alias("dl"))


def term_stats(post: DataFrame) -> DataFrame:
    """term, df, cf."""
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@dataclass
class BM25:
    """BM25 over a table of texts: only the postings of the query's terms are aggregated and joined."""

    k1: float = 1.2
    b: float = 0.75
    fields: dict = field(default_factory=dict)

    def search(self, docs: DataFrame, key: str, terms: Column, query: list[str], k: int | None = 10, where: Column | None = None) -> DataFrame:
        """key, score (rounded to 6 places) of the best k texts for the distinct query terms; scores of 0 or less are no hits.

        Statistics cover all texts; where filters the hits only. The score is a sum over
        the few terms of a query within one row, so no join is needed: texts that hold
        none of the terms leave the plan at the scan.
        """
        wanted = sorted(set(query))

        def counts(ts: Column) -> Column:  # the terms are bound once for all counts
            tf = [F.size(F.filter(ts, (lambda w: lambda x: x == F.lit(w))(w))).alias(f"tf{i}") for i, w in enumerate(wanted)]
            return F.struct(F.size(ts).alias("dl"), *tf)

        t = docs.select("*", F.get(F.transform(F.array(terms), counts), F.lit(0)).alias("_s"))
        t = t.withColumns({"_dl": F.col("_s.dl")} | {f"_tf{i}": F.col(f"_s.tf{i}") for i in range(len(wanted))})
        stats = t.agg(F.count("*").alias("n"), F.avg("_dl").alias("avgdl"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))]).first()
        n, avgdl = stats["n"], max(stats["avgdl"] or 0.0, 1.0)
        score = F.lit(0.0)
        for i in range(len(wanted)):
            df = stats[f"df{i}"]
            if df:
                idf = float(np.log((n - df + 0.5) / (df + 0.5)))
                c = F.col(f"_tf{i}")
                score = score + F.lit(idf) * c * (self.k1 + 1) / (c + self.k1 * (1 - self.b + self.b * F.col("_dl") / avgdl))
        hits = t.filter(all_of([where]) if where is not None else F.lit(True)).filter(F.greatest(*[F.col(f"_tf{i}") for i in range(len(wanted))], F.lit(0)) > 0)
        hits = hits.select(key, F.round(score, 6).alias("score")).filter("score > 0")
        return hits.orderBy(F.desc("score"), key).limit(k) if k else hits


def bm25_each(docs: DataFrame, key: str, terms: Column, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query, key, score, place of the best k texts for each row of queries(query, terms), which may be a table of any size.

    Postings (term, key, tf, length) are written once; only those of the queries' terms
    are joined, so a query reads what its terms hold and not all texts.
    """
    one = docs.select(key, terms.alias("terms"))
    stats = one.agg(F.count("*").alias("n"), F.greatest(F.avg(F.size("terms")), F.lit(1.0)).alias("avgdl")).first()
    asked = queries.select("query", F.explode(F.array_distinct("terms")).alias("term"))
    held = one.select(key, F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    post = written(held.join(asked.select("term").distinct(), "term", "left_semi"), "postings")
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln((F.lit(stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(stats["avgdl"])))
    hits = asked.join(df, "term").join(post, "term").groupBy("query", key).agg(F.round(F.sum(part), 6).alias("score")).filter("score > 0")
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def dense_topk(vectors: DataFrame, key: str, queries: dict, k: int = 10) -> DataFrame:
    """query, key, score of the k nearest vectors by cosine for each query vector.

    Blocks of vectors meet all queries in one matrix product; each block hands on its
    best k a query only. Null vectors and those of another length are left out.
    """
    ids = list(queries)
    q = np.array([queries[i] for i in ids], np.float64)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.num_rows
            if not rows:
                continue
            v = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(rows, q.shape[1])
            s = np.round((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)) @ q.T, 6)
            keys = np.asarray(b.column(0).to_pylist(), object)
            out_q, out_k, out_s = [], [], []
            for j, name in enumerate(ids):
                at = np.lexsort((np.arange(rows), -s[:, j]))
                edge = s[at[min(k, rows) - 1], j]
                at = at[s[at, j] >= edge]  # ties at the edge stay for the final order
                out_q += [name] * len(at)
                out_k += keys[at].tolist()
                out_s += s[at, j].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_k, pa.int64()), pa.array(out_s, pa.float64())], ["query", key, "score"])

    slim = vectors.filter(F.size("embedding") == q.shape[1]).select(F.col(key).cast("bigint"), F.col("embedding").cast("array<double>"))
    best = slim.mapInArrow(run, f"query bigint, {key} bigint, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


#: Vectors a block, of the searched ones and of the queries.
BLOCK, QUERY_BLOCK = 2048, 256


def _blocks(vectors: DataFrame, key: str, size: int, prefix: str) -> DataFrame:
    """Vectors scaled to length 1, as blocks of equal dimension: dim, keys, values (as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lens = np.asarray(b.column(2).to_numpy(zero_copy_only=False))
            for dim in np.unique(lens).tolist():
                rows = b.filter(pa.array(lens == dim))
                for at in range(0, rows.num_rows, size):
                    part = rows.slice(at, size)
                    v = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(part.num_rows, dim)
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                    keys = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], [f"{prefix}dim", f"{prefix}keys", f"{prefix}values"])

    slim = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(F.col(key).cast("bigint"), F.col("embedding").cast("array<double>"), F.size("embedding").alias("dim"))
    return slim.mapInArrow(run, f"{prefix}dim int, {prefix}keys binary, {prefix}values binary")


def dense_topk_each(vectors: DataFrame, key: str, queries: DataFrame, k: int = 10, itself: bool = True) -> DataFrame:
    """query, key, score, place of the k nearest vectors by cosine for each row of queries, which may be a table of any size.

    Blocks of queries meet blocks of vectors, each pair in one matrix product that hands
    on its best k a query only; nothing is collected. Null vectors are left out, and
    vectors of other lengths don't meet. itself tells whether a query may find itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qd, qk, qv, vd, vk, vv in zip(*[b.column(c).to_pylist() for c in ("q_dim", "q_keys", "q_values", "dim", "keys", "values")], strict=True):
                if qd != vd:
                    continue
                names, keys = np.frombuffer(qk, np.int64), np.frombuffer(vk, np.int64)
                s = np.round(np.frombuffer(qv).reshape(-1, qd) @ np.frombuffer(vv).reshape(-1, vd).T, 6)
                if not itself:
                    s[names[:, None] == keys[None, :]] = -np.inf
                n = min(k, len(keys))
                edge = np.partition(s, len(keys) - n, axis=1)[:, len(keys) - n]
                i, j = np.nonzero((s >= edge[:, None]) & (s > -np.inf))  # ties at the edge stay for the final order
                yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(keys[j]), pa.array(s[i, j])], ["query", key, "score"])

    pairs = _blocks(queries, key, QUERY_BLOCK, "q_").crossJoin(_blocks(vectors, key, BLOCK, ""))
    best = pairs.mapInArrow(run, f"query bigint, {key} bigint, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def nearest_each(items: DataFrame, queries: DataFrame, near: Column, order: list[Column], k: int) -> DataFrame:
    """The k best items for each row of queries, another work with a common genre; queries' columns have the prefix q_.

    near is a column over both, called nearness; order ranks the items of a query.
    """
    meets = (F.col("work_key") != F.col("q_work_key")) & F.coalesce(F.arrays_overlap(F.array_compact("genres"), F.array_compact("q_genres")), F.lit(False))
    x = items.join(queries, meets).withColumn("nearness", near)
    w = Window.partitionBy("q_work_key").orderBy(*order)
    return x.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def ranked(hits: DataFrame, key: str) -> DataFrame:
    """key, place of a short list of hits by score."""
    return hits.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), key))).select(key, "place")


def fuse(lists: list[tuple[DataFrame, float]], key: str, k: int = RRF_K) -> DataFrame:
    """key, fusion: reciprocal ranks of ranked lists (key, place), weighted and summed."""
    parts = [x.select(key, (F.lit(w) / (k + F.col("place"))).alias("part")) for x, w in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(key).agg(F.sum("part").alias("fusion"))


def hybrid(fused: DataFrame, items: DataFrame, key: str, match: Column, popularity: Column, pool: int = 40) -> DataFrame:
    """Fused hits with their items, by fusion, match and popularity."""
    total = F.least(F.lit(1.0), F.col("fusion") * RRF_K) + 1.2 * match + 0.35 * popularity
    return items.join(fused, key).withColumn("total", F.round(total, 6)).orderBy(F.desc("total"), key).limit(pool)


def retrieve(items: DataFrame, key: str, terms: Column, query: list[str], vectors: DataFrame, vector: list[float] | None, t: Target, pool: int = 40, seed: int | None = None) -> DataFrame:
    """The items for a request, with fusion and total: hybrid search among those that pass the target's filters.

    Excluded and failing items leave both lists before they are ranked, so the vectors
    searched are those of passing items only. Without any hit, the best known passing
    items take the place of the hits.
    """
    allowed = items.filter(passes(t))
    lists = []
    if query:
        lists.append((ranked(BM25().search(items, key, terms, query, pool, passes(t)), key), 1.0))
    if vector is not None:
        near = dense_topk(vectors.join(allowed.select(key), key, "leftsemi"), key, {0: vector}, pool)
        lists.append((near.select(key, "place"), 0.7))
    fused = written(fuse(lists, key), "fused") if lists else None
    if fused is None or fused.isEmpty():
        fused = browse(items, t, pool, seed, key).select(key, F.col("rank_score").alias("fusion"))
    return hybrid(fused, allowed, key, match_score(t), F.coalesce("popularity", F.lit(0.0)), pool)


def browse(items: DataFrame, t: Target, k: int, seed: int | None = None, key: str = "work_key") -> DataFrame:
    """The best known items that pass; with a seed, shuffled a little, the same for every run."""
    jitter = 1.0 if seed is None else 0.75 + 0.5 * F.floor(unit("work_key", seed) * 1000) / 1000
    return items.filter(passes(t)).withColumn("rank_score", F.round(F.coalesce("popularity", F.lit(0.0)) * jitter, 6)).orderBy(F.desc("rank_score"), key).limit(k)


def similar_by_overlap(items: DataFrame, work_key: str, k: int = 10) -> DataFrame:
    """Items that share a genre with one item, by common subjects and popularity."""
    one = items.filter(F.col("work_key") == work_key).select("genres", "subjects").first()
    if one is None:
        return items.limit(0).select("work_key", F.lit(0).alias("shared"), "popularity")
    g, s = tuple(x for x in one["genres"] or () if x), tuple(x for x in one["subjects"] or () if x)
    rows = items.filter((F.col("work_key") != work_key) & (_hits("genres", g) if g else F.lit(False)))
    shared = overlap("subjects", _list(s)) if s else F.lit(0)
    return rows.select("work_key", shared.alias("shared"), "popularity").orderBy(F.desc("shared"), F.desc("popularity"), "work_key").limit(k)


def not_weak(rows: DataFrame, group: str, score: str, least: float) -> DataFrame:
    """Rows of at least the score; of a group without any, its best row; dropped counts what went.

    Groups are aggregated first and joined back, so no group meets in one task. Null groups
    stand for none and are left out.
    """
    per = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("n"), F.count_if(F.col(score) >= least).alias("strong"), F.min(F.struct((-F.col(score)).alias("s"), "id")).alias("best"))
    x = rows.join(per, F.col(group) == F.col("_g"))
    kept = x.filter((F.col(score) >= least) | ((F.col("strong") == 0) & (F.col("id") == F.col("best.id")) & (F.col(score) == -F.col("best.s"))))
    return kept.withColumn("dropped", F.col("n") - F.greatest("strong", F.lit(1))).drop("strong", "n", "best", "_g")

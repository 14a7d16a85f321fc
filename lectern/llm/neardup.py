"""Near-duplicate works by universe partition and pigeonhole (problem 6).

Two word sets with a Jaccard similarity of at least t differ in at most
H = (1-t)/(1+t) * (|r|+|s|) words. The universe of words is cut by hash into
segments, more of them for larger sets (size bands). If r spends H+1 units on its
segments - one unit to look up a segment's subset as it is, a second one to look up
its one-deletion neighbourhood too - then every such s agrees in at least one
segment to within what was spent there. Each set spends its units where the
expected number of matches is least. Every agreement is then verified exactly.

Deletions are indexed in every second segment only, which is where a second unit may be
spent, and only on subsets that keep two words. Empty subsets are the last resort: a
band and segment in which no set needs them is not indexed for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.words import mix, words
from lectern.llm.tokensets import WordHashes, class_id, list_column, members_pairs, parity_sketches
from lectern.session import written

#: Words in more than this share of all sets get their own probability in the costs; at most average size / share words.
COMMON = 0.005
BAND_RATIO = 1.5
SKETCH = 2


def band_of(size: np.ndarray) -> np.ndarray:
    """Size band of a set: bands grow by BAND_RATIO."""
    return np.floor(np.log(np.maximum(size, 1)) / np.log(BAND_RATIO) + 1e-9).astype(np.int64)


def band_low(band: np.ndarray) -> np.ndarray:
    return np.ceil(BAND_RATIO ** np.asarray(band, float) - 1e-9)


class Partition:
    """Segment numbers and counts for a similarity threshold num/den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def units(self, size: np.ndarray) -> np.ndarray:
        """H + 1 for a set whose partner is no larger."""
        return (self.den - self.num) * 2 * size // (self.den + self.num) + 1

    def segments(self, band: np.ndarray) -> np.ndarray:
        """Segments of a band: one unit each is enough for its largest set."""
        return self.units(np.maximum(np.ceil(BAND_RATIO ** (np.asarray(band, float) + 1) - 1e-9).astype(np.int64) - 1, 1))


def _keys(content: np.ndarray, seg: np.ndarray, band: np.ndarray, kind: int) -> np.ndarray:
    salt = (seg.astype(np.uint64) << np.uint64(20)) ^ (band.astype(np.uint64) << np.uint64(8)) ^ np.uint64(kind)
    return mix(content + mix(salt + np.uint64(0x51ED270B27)))


FULL, LESS = 1, 2
#: Costs of units that come last and of those that can't be spent.
LAST, NEVER = 10.0, 1e9


class Layout:
    """Words of sets ordered by (set, segment), with each slot's content, size, set (row), segment and band."""

    def __init__(self, h: np.ndarray, sizes: np.ndarray, band: np.ndarray, part: Partition) -> None:
        self.m = m = part.segments(band)
        self.first = first = np.concatenate(([0], np.cumsum(m)))
        row = np.repeat(np.arange(len(sizes)), sizes)
        slot = first[row] + (mix(h ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.int64) % m[row]
        self.order = np.argsort(slot, kind="stable")
        self.slot = slot[self.order]
        self.mixed = mix(h[self.order])
        n = int(first[-1])
        self.content = np.zeros(n, np.uint64)
        np.add.at(self.content, self.slot, self.mixed)
        self.count = np.bincount(self.slot, minlength=n)
        self.row = np.repeat(np.arange(len(sizes)), m)
        self.seg = np.arange(n) - first[self.row]
        self.band = band[self.row]
        self.second = self.seg % 2 == 0

    def full(self, at: np.ndarray) -> np.ndarray:
        """Keys of the subsets of slots."""
        return _keys(self.content[at], self.seg[at], self.band[at], FULL)

    def less(self, words_: np.ndarray, kind: int) -> np.ndarray:
        """Keys of the subsets without one word each (places in the order of words)."""
        at = self.slot[words_]
        return _keys(self.content[at] - self.mixed[words_], self.seg[at], self.band[at], kind)


def index_keys(x: Layout, empty: set[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which sets are found, and the set (row) of each; empty are the bands and segments where empty subsets count."""
    take = x.count > 0
    for band, seg in empty:
        take |= (x.band == band) & (x.seg == seg)
    at = np.flatnonzero(take)
    w = np.flatnonzero((x.second & (x.count >= 3))[x.slot])
    return np.concatenate((x.full(at), x.less(w, LESS))), np.concatenate((x.row[at], x.row[x.slot[w]]))


def probe_units(x: Layout, sizes: np.ndarray, prob: np.ndarray, part: Partition) -> tuple[np.ndarray, np.ndarray]:
    """Slots on which one unit at least, and two units, are spent, by the cost of each unit.

    A cost is the log of the expected share of matching sets: the product of the words'
    probabilities; a deletion frees the rarest word.
    """
    n = len(x.content)
    lp = np.log(prob[x.order])
    c0 = np.zeros(n)
    np.add.at(c0, x.slot, lp)
    rarest = np.zeros(n)
    np.minimum.at(rarest, x.slot, lp)
    c1 = np.where(x.second & (x.count >= 2), c0 - rarest + 1.0, NEVER)
    cost = np.concatenate((np.where(x.count > 0, c0, LAST), c1))
    owner = np.concatenate((x.row, x.row))
    rank = np.lexsort((cost, owner))
    place = np.arange(2 * n) - np.repeat(2 * x.first[:-1], 2 * x.m)
    take = np.zeros(2 * n, bool)
    take[rank] = place < part.units(sizes)[owner[rank]]
    return take[:n] | take[n:], take[n:]  # the second unit of a segment costs more than its first, so it never comes alone


def probe_keys(x: Layout, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that sets look up, and the set (row) of each."""
    a, b, w = np.flatnonzero(one), np.flatnonzero(two), np.flatnonzero(two[x.slot])
    up = _keys(x.content[b], x.seg[b], x.band[b], LESS)
    return np.concatenate((x.full(a), up, x.less(w, FULL))), np.concatenate((x.row[a], x.row[b], x.row[x.slot[w]]))


def word_sets(rows: DataFrame, key: str, min_words: int, num: int, den: int) -> DataFrame:
    """key, c0, c1, size, h (hashes of the distinct words, as bigints), s0.. (sketch) of rows with long enough body.

    rows: key, head string, body string. Rows whose key or body is null, or whose body
    has fewer than min_words words, are no cases.
    """
    schema = f"{key} string, c0 bigint, c1 bigint, size int, h array<bigint>, " + ", ".join(f"s{k} bigint" for k in range(SKETCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            keys, cls, flat, sizes = [], [], [], []
            for k, head, body in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                w = words(body)
                if len(w) < min_words:
                    continue
                s = set(w)
                s.update(words(head))
                keys.append(k)
                cls.append(class_id(s))
                flat.extend([cache[x] for x in s])
                sizes.append(len(s))
            h, n = np.array(flat, np.uint64), np.array(sizes, np.int64)
            sk = parity_sketches(h, n, SKETCH) if len(n) else [n] * SKETCH
            c = np.array(cls, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(n, pa.int32()), list_column(h.view(np.int64), n), *map(pa.array, sk)],
                [key, "c0", "c1", "size", "h", *[f"s{k}" for k in range(SKETCH)]],
            )

    slim = rows.filter(F.col(key).isNotNull() & F.col("body").isNotNull()).select(F.col(key).cast("string"), F.coalesce("head", F.lit("")), "body")
    return slim.mapInArrow(run, schema)


_META = ["rid", "size", *[f"s{k}" for k in range(SKETCH)]]
_META_SCHEMA = "rid bigint, size int, " + ", ".join(f"s{k} bigint" for k in range(SKETCH))


def _over_sets(reps: DataFrame, work, schema: str) -> DataFrame:
    """work(batch, words' hashes, sizes) on all sets, piece by piece; it yields record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                yield from work(b, b.column("h").flatten().to_numpy().view(np.uint64), b.column("size").to_numpy().astype(np.int64))

    return reps.select(*_META, "h").mapInArrow(run, schema)


def _signature_pairs(reps: DataFrame, part: Partition, common: dict) -> DataFrame:
    """rid_a, rid_b of sets that agree in a segment and whose sizes and sketches allow the similarity, each pair once.

    Only keys, set numbers, sizes and sketches are shuffled.
    """
    shared = reps.sparkSession.sparkContext.broadcast((np.array(sorted(common), np.int64), np.array([common[k] for k in sorted(common)])))

    def spent(h: np.ndarray, n: np.ndarray) -> tuple[Layout, np.ndarray, np.ndarray]:
        ck, cp = shared.value
        prob = np.full(len(h), COMMON / 4)
        if len(ck):
            i = np.minimum(np.searchsorted(ck, h.view(np.int64)), len(ck) - 1)
            hit = ck[i] == h.view(np.int64)
            prob[hit] = cp[i[hit]]
        x = Layout(h, n, band_of(n), part)
        return x, *probe_units(x, n, prob, part)

    def keyed(b: pa.RecordBatch, key: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
        # One set's rows stay together, which compresses well.
        order = np.argsort(row, kind="stable")
        take = pa.array(row[order])
        return pa.RecordBatch.from_arrays([pa.array(key[order].view(np.int64)), *[b.column(c).take(take) for c in _META]], ["key", *_META])

    def asked(b: pa.RecordBatch, h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, one, _ = spent(h, n)
        at = np.flatnonzero(one & (x.count == 0))
        yield pa.RecordBatch.from_arrays([pa.array(x.band[at]), pa.array(x.seg[at])], ["band", "seg"])

    def probe(b: pa.RecordBatch, h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, one, two = spent(h, n)
        yield keyed(b, *probe_keys(x, one, two))

    # At most one row for each band and segment.
    empty = {(int(r[0]), int(r[1])) for r in _over_sets(reps, asked, "band bigint, seg bigint").distinct().collect()}

    def index(b: pa.RecordBatch, h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = band_of(n)
        key, row = index_keys(Layout(h, n, own, part), empty)
        # A larger partner may sit in the next band; its own sets look up there.
        up = np.flatnonzero(band_low(own + 1) * part.num <= n * part.den)
        if len(up):
            inner = np.isin(np.repeat(np.arange(len(n)), n), up)
            k2, r2 = index_keys(Layout(h[inner], n[up], own[up] + 1, part), empty)
            key, row = np.concatenate((key, k2)), np.concatenate((row, up[r2]))
        yield keyed(b, key, row)

    named = lambda work, x: _over_sets(reps, work, f"key bigint, {_META_SCHEMA}").select("key", *[F.col(c).alias(f"{c}_{x}") for c in _META])
    num, den = part.num, part.den
    apart = " + ".join(f"bit_count(s{k}_a ^ s{k}_b)" for k in range(SKETCH))
    near = F.expr(
        f"index.key = probe.key and (size_a < size_b or (size_a = size_b and rid_a < rid_b)) and {den} * size_a >= {num} * size_b"
        f" and {den + num} * ({apart}) <= {den - num} * (size_a + size_b)"
    )
    return named(index, "a").alias("index").join(named(probe, "b").alias("probe"), near).select("rid_a", "rid_b").distinct()


def similar_sets(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets and the links between similar classes.

    sets: rid and what word_sets gives. Out: (classes: c0, c1, rid of the set that stands
    for the class; links: rid_a, rid_b).
    """
    part = Partition(num, den)
    classes = sets.groupBy("c0", "c1").agg(F.min("rid").alias("rid"))
    # Sets that stand for no class; the join is a broadcast only if the written table is small.
    copies = written(sets.select("rid").join(classes.select("rid"), "rid", "left_anti"), "neardup-copies")
    reps = sets.join(copies, "rid", "left_anti")
    n = classes.count()
    df = reps.select(F.explode("h").alias("h")).groupBy("h").count().filter(F.col("count") > COMMON * n)
    common = {r[0]: r[1] / n for r in df.collect()}  # at most average size / COMMON words
    side = lambda x: reps.select(F.col("rid").alias(f"rid_{x}"), F.col("h").alias(f"h_{x}"))
    both = _signature_pairs(reps, part, common).join(side("a"), "rid_a").join(side("b"), "rid_b").withColumn("common", F.size(F.array_intersect("h_a", "h_b")))
    links = both.filter(F.expr(f"{den + num} * common >= {num} * (size(h_a) + size(h_b))")).select("rid_a", "rid_b")
    return classes, links


def newest_works(books: DataFrame) -> DataFrame:
    """work_key, head (title and authors) and body (description) of the newest snapshot of each work."""
    cols = F.struct(F.coalesce("snapshot_at", F.timestamp_seconds(F.lit(0))), F.col("description").alias("body"), F.concat_ws("\n", "title", "authors").alias("head"))
    one = books.filter(F.col("work_key").isNotNull()).groupBy("work_key").agg(F.max(cols).alias("x"))
    return one.select("work_key", "x.head", "x.body")


def similar_works(books: DataFrame, num: int = 7, den: int = 10, min_words: int = 20) -> tuple[DataFrame, DataFrame]:
    """(works: work_key, rid of its class; links: rid_a, rid_b) of works whose word sets are similar by num/den or more.

    Null titles, authors and descriptions, repeated rows and older snapshots are
    handled as newest_works and word_sets say; an empty table gives empty results.
    """
    sets = word_sets(newest_works(books), "work_key", min_words, num, den)
    sets = written(sets.withColumn("rid", F.monotonically_increasing_id()), "neardup-works")
    classes, links = similar_sets(sets, num, den)
    return sets.select("work_key", "c0", "c1").join(classes, ["c0", "c1"]).select("work_key", "rid"), links


def similar_pairs(books: DataFrame) -> DataFrame:
    """All pairs work_key_a < work_key_b of similar works, copies included."""
    works, links = similar_works(books)
    p = members_pairs(works, links, "work_key", ["rid"])
    return p.select(F.least("a", "b").alias("work_key_a"), F.greatest("a", "b").alias("work_key_b"))

"""Samples that recur across splits, by an edit-distance segment join (problem 3).

A sample's set of words becomes a sequence: its distinct words in one fixed order of
all words. Two sequences in the same order are |A| + |B| - 2 |A and B| insertions and
deletions apart, so a Jaccard similarity of at least num/den is an edit distance of at
most k = (den-num)/(den+num) * (|A|+|B|). Each evaluation sequence is cut into more
than k segments; a training sequence within k must hold one of them whole, at a
position that the edits before and after it allow. Candidates are verified by banded
dynamic programming. The fixed order puts words that stand in few samples first, and
segments of commoner words are longer, so that segments are selective.

What meets by shuffle are narrow rows only (a key, a place and a sample's number);
sketches and texts join what is left. Nothing that grows with the data is broadcast
by us.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tokensets import WordHashes, class_id, parity_sketches
from lectern.llm.words import mix, words
from lectern.session import spread, written

#: Word classes by the share of samples a word stands in: up to the first bound, up to the second, beyond.
CLASS_BOUNDS = (0.05, 0.2)
#: Segment lengths by class; the first level that gives enough segments is used for a sequence, the last always does.
LEVELS = ((2, 3, 6), (2, 2, 6), (1, 2, 4), (1, 1, 2), (1, 1, 1))
SKETCH = 6
_ROWS = 500


def conversation(messages: str = "messages") -> F.Column:
    """All user and assistant contents of a sample as one text; null contents are left out."""
    kept = F.filter(messages, lambda m: m["role"].isin("user", "assistant"))
    return F.concat_ws("\n", F.transform(kept, lambda m: m["content"]))


_SK = [f"s{k}" for k in range(SKETCH)]
_SCAN = ["word", "n", "sample_id", "train", "c0", "c1", *_SK]
_SCAN_SCHEMA = "word string, n bigint, sample_id bigint, train boolean, c0 bigint, c1 bigint, " + ", ".join(f"{s} bigint" for s in _SK)


def _scanned(texts: DataFrame) -> DataFrame:
    """One reading of all texts: rows of partial word counts (word, n) and one row a sample (class id, size n, sketch)."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * (2 + SKETCH)]

    def batch(cols: dict, size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(size, t) for c, t in zip(_SCAN, types, strict=True)], _SCAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        cache = WordHashes()
        for whole in batches:
            for b in _rows(whole):
                sets = [set(words(t)) for t in b.column(2).to_pylist()]
                for w in sets:
                    seen.update(w)
                n = np.array([len(w) for w in sets], np.int64)
                sk = parity_sketches(np.array([cache[x] for w in sets for x in w], np.uint64), n, SKETCH)
                cls = np.array([class_id(w) for w in sets], np.int64).reshape(-1, 2)
                yield batch({"n": n, "sample_id": b.column(0), "train": b.column(1), "c0": cls[:, 0], "c1": cls[:, 1]} | dict(zip(_SK, sk, strict=True)), len(n))
            if len(seen) > 1_000_000:
                yield batch({"word": list(seen), "n": list(seen.values())}, len(seen))
                seen.clear()
        yield batch({"word": list(seen), "n": list(seen.values())}, len(seen))

    return texts.select("sample_id", "train", "text").mapInArrow(run, _SCAN_SCHEMA)


def _common(scan: DataFrame) -> dict:
    """Class (1 or 2) of every word that stands in more than the first bound of all samples.

    There are at most average set size / bound of them, whatever the input's size.
    """
    n = scan.filter(F.col("sample_id").isNotNull()).count()
    df = scan.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") > CLASS_BOUNDS[0] * n)
    return {r[0]: 1 + (r[1] > CLASS_BOUNDS[1] * n) for r in df.collect()}


def _sequences(texts: list, common: dict, cache: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Hashes and classes of all sequences end to end, their lengths, and class ids of the sets."""
    flat, cl, sizes, ids = [], [], [], []
    get = common.get
    for t in texts:
        s = set(words(t))
        ids.append(class_id(s))
        sizes.append(len(s))
        flat.extend([cache[w] for w in s])
        cl.extend([get(w, 0) for w in s])
    h, c, n = np.array(flat, np.uint64), np.array(cl, np.int8), np.array(sizes, np.int64)
    order = np.lexsort((h, c, np.repeat(np.arange(len(n)), n)))
    return h[order], c[order], n, ids


def _runs(h: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word, its place in the sequence, and how many words of its class follow it, itself included."""
    row = np.repeat(np.arange(len(n)), n)
    start = np.concatenate(([0], np.cumsum(n)))
    group = row * 3 + c
    last = np.searchsorted(group, group, side="right")
    return row, np.arange(len(h)) - start[row], last - np.arange(len(h))


def _substring_keys(h: np.ndarray, at: np.ndarray, cls: int, length: int) -> np.ndarray:
    key = np.full(len(at), cls * 64 + length, np.uint64)
    for k in range(length):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + h[at + k])
    return key


def _segments(h: np.ndarray, c: np.ndarray, n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, ...]:
    """Segments of evaluation sequences: row, ordinal (from 0), place, key, level; more segments than k everywhere."""
    row, place, left = _runs(h, c, n)
    size = np.zeros((len(n), 3), np.int64)
    np.add.at(size, (row, c), 1)
    # A partner is at most den/num times as long.
    need = (den - num) * (n + n * den // num) // (den + num) + 1
    level = np.full(len(n), len(LEVELS) - 1)
    for lv in range(len(LEVELS) - 2, -1, -1):
        level[(size // np.array(LEVELS[lv])).sum(1) >= need] = lv
    lens = np.array(LEVELS)[level]
    class_start = np.concatenate((np.zeros((len(n), 1), np.int64), np.cumsum(size, 1)), 1)
    length = lens[row, c]
    inside = place - class_start[row, c]
    at = np.flatnonzero((inside % length == 0) & (left >= length))
    key = np.zeros(len(at), np.uint64)
    for cls, ln in {(int(a), int(b)) for a, b in zip(c[at], length[at], strict=True)}:
        m = (c[at] == cls) & (length[at] == ln)
        key[m] = _substring_keys(h, at[m], cls, ln)
    r = row[at]
    first = np.concatenate(([True], r[1:] != r[:-1])) if len(r) else np.zeros(0, bool)
    ordinal = np.arange(len(r)) - np.maximum.accumulate(np.where(first, np.arange(len(r)), 0)) if len(r) else r
    return r, ordinal, place[at], key, level


def _rows(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for k in range(0, b.num_rows, _ROWS):
        yield b.slice(k, _ROWS)


def _with_parity(key: np.ndarray, odd: np.ndarray) -> np.ndarray:
    return mix(key + (odd & 1).astype(np.uint64)).view(np.int64)


def _eval_segments(texts: DataFrame, shared, num: int, den: int) -> DataFrame:
    """level, key, ord, p (place), n (size), a (sample) of the first k + 1 segments of evaluation samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, cache = shared.value, WordHashes()
        for whole in batches:
            for b in _rows(whole):
                h, c, n, _ = _sequences(b.column(1).to_pylist(), common, cache)
                row, ordinal, place, key, level = _segments(h, c, n, num, den)
                use = ordinal <= ((den - num) * (n + n * den // num) // (den + num))[row]
                row, ordinal, place, key = row[use], ordinal[use], place[use], key[use]
                # A first segment whole has exactly as many edits before it as segments, so its shift has their parity.
                cols = [pa.array(level[row], pa.int32()), pa.array(_with_parity(key, place + ordinal)), *[pa.array(x, pa.int32()) for x in (ordinal, place, n[row])], b.column(0).take(pa.array(row))]
                yield pa.RecordBatch.from_arrays(cols, ["level", "key", "ord", "p", "n", "a"])

    return texts.select("sample_id", "text").mapInArrow(run, "level int, key bigint, ord int, p int, n int, a bigint")


def _levels_of(size: np.ndarray, n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which levels a partner of each training sample may use (rows by levels).

    A partner has x words more and y fewer, with x + y edits at most. It goes beyond a
    level only if its segments there, at least size/length less what rounding and y take,
    are fewer than it needs; the extreme points of (x, y) bound the difference.
    """
    r, out = (den - num) / (den + num), np.ones((len(n), len(LEVELS)), bool)
    g = r * (1 + den / num)
    for lv, lens in enumerate(LEVELS[:-1]):
        some = (size / np.array(lens)).sum(1) - sum(1 - 1 / x for x in lens)
        more = max((g - 1 / max(lens)) * 2 * r / (1 - r), (1 / min(lens) - g) * 2 * r / (1 + r), 0.0)
        out[:, lv + 1 :] &= (some < (g + more) * n + 1 + 1e-6)[:, None]
    return out


def _train_substrings(texts: DataFrame, shared, levels: list[int], num: int, den: int) -> DataFrame:
    """key, q (place + size * 2 ** 32), b (sample) of all substrings of training samples that may be a partner's segments."""
    kinds = sorted({(c, LEVELS[lv][c]) for lv in levels for c in range(3)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, cache = shared.value, WordHashes()
        for whole in batches:
            for b in _rows(whole):
                h, c, n, _ = _sequences(b.column(1).to_pylist(), common, cache)
                row, place, left = _runs(h, c, n)
                size = np.zeros((len(n), 3), np.int64)
                np.add.at(size, (row, c), 1)
                may = _levels_of(size, n, num, den)
                rows, places, keys = [], [], []
                for cls, ln in kinds:
                    wanted = may[:, [lv for lv in levels if LEVELS[lv][cls] == ln]].any(1)
                    at = np.flatnonzero((c == cls) & (left >= ln) & wanted[row])
                    rows.append(row[at]), places.append(place[at]), keys.append(_with_parity(_substring_keys(h, at, cls, ln), place[at]))
                r, p, k = np.concatenate(rows), np.concatenate(places), np.concatenate(keys)
                # One sample's rows stay together, which compresses well.
                order = np.argsort(r, kind="stable")
                r, p, k = r[order], p[order], k[order]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(p + (n[r] << 32)), b.column(0).take(pa.array(r))], ["key", "q", "b"])

    return texts.select("sample_id", "text").mapInArrow(run, "key bigint, q bigint, b bigint")


def banded_distance(a: list[np.ndarray], b: list[np.ndarray], k: np.ndarray) -> np.ndarray:
    """Insertions plus deletions between a[i] and b[i] where at most k[i], else more than k[i]; all pairs in step."""
    p, w = len(a), int(k.max()) if len(a) else 0
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    ma = int(na.max()) if p else 0
    left = np.zeros((p, max(ma, 1)), np.uint64)
    right = np.zeros((p, ma + 2 * w + 2), np.uint64)
    has = np.zeros(right.shape, bool)
    for i in range(p):
        m = min(na[i] + w, nb[i])
        left[i, : na[i]] = a[i]
        right[i, w : w + m] = b[i][:m]
        has[i, w : w + m] = True
    big = 1 << 20
    d = np.arange(-w, w + 1)  # column d: position in b minus position in a
    dist = np.where(d >= 0, d, big)[None, :].repeat(p, 0)
    out = np.where(na == 0, nb, big)
    for i in range(1, ma + 1):
        here = right[:, i - 1 : i + 2 * w]
        same = (here == left[:, i - 1 : i]) & has[:, i - 1 : i + 2 * w]
        cand = np.where(same, dist, big)
        cand[:, :-1] = np.minimum(cand[:, :-1], dist[:, 1:] + 1)
        cand[:, d + i < 0] = big
        dist = np.minimum.accumulate(cand - d, axis=1) + d
        done = np.flatnonzero(na == i)
        off = nb[done] - i + w
        ok = (off >= 0) & (off <= 2 * w)
        out[done[ok]] = dist[done[ok], off[ok]]
    return out


def _verified(pairs: DataFrame, shared, num: int, den: int) -> DataFrame:
    """pairs: one text of either side; the class ids of those similar by num/den."""
    names = ["c0_a", "c1_a", "c0_b", "c1_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, cache = shared.value, WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                ha, _, na, ia = _sequences(b.column("text_a").to_pylist(), common, cache)
                hb, _, nb, ib = _sequences(b.column("text_b").to_pylist(), common, cache)
                k = (den - num) * (na + nb) // (den + num)
                dist = banded_distance(np.split(ha, np.cumsum(na)[:-1]), np.split(hb, np.cumsum(nb)[:-1]), k)
                ids = np.concatenate((np.array(ia, np.int64), np.array(ib, np.int64)), 1)[dist <= k]
                yield pa.RecordBatch.from_arrays([pa.array(ids[:, j]) for j in range(4)], names)

    return pairs.mapInArrow(run, ", ".join(f"{c} bigint" for c in names)).distinct()


def class_links(samples: DataFrame, num: int = 8, den: int = 10) -> tuple[DataFrame, DataFrame]:
    """(members: sample_id, train, c0, c1; links: c0_a, c1_a, c0_b, c1_b) of similar evaluation (a) and training (b) classes.

    A class holds the samples of one side with equal sets of words; it is joined once,
    by its smallest sample_id.
    """
    texts = samples.filter(F.col("sample_id").isNotNull() & F.col("split").isin("train", "valid", "test"))
    texts = texts.select(F.col("sample_id").cast("bigint"), (F.col("split") == "train").alias("train"), F.coalesce(conversation(), F.lit("")).alias("text"))
    texts = spread(texts)
    scan = written(_scanned(texts), "overlap-scan")
    shared = samples.sparkSession.sparkContext.broadcast(_common(scan))
    rows = scan.filter(F.col("sample_id").isNotNull())
    cls = ["train", "c0", "c1"]
    first = rows.groupBy(*cls).agg(F.min("sample_id").alias("rid"))
    # Samples that stand for no class; their texts aren't read again. The join is a broadcast only if the written table is small.
    one = rows.select("sample_id", *cls).join(first, cls).groupBy("train", "sample_id").agg(F.max(F.col("sample_id") == F.col("rid")).alias("stands"))
    copies = written(one.filter(~F.col("stands")).select("train", "sample_id"), "overlap-copies")
    reps = texts.join(copies, ["train", "sample_id"], "left_anti")
    seg = written(_eval_segments(reps.filter(~F.col("train")), shared, num, den), "overlap-segments")
    levels = sorted(r[0] for r in seg.select("level").distinct().collect())
    t = _train_substrings(reps.filter("train"), shared, levels or [0], num, den)
    edits = f"(({den - num}) * (n + m)) div {den + num}"
    shift = "(cast(q & 4294967295 as int) - p)"
    # The rest of the edits comes after the segment.
    fits = F.expr(f"{den} * n >= {num} * m and {den} * m >= {num} * n and abs({shift}) <= ord and abs((m - n) - {shift}) <= {edits} - ord")
    met = seg.drop("level").join(t, "key").withColumn("m", F.expr("cast(shiftright(q, 32) as int)")).filter(fits)
    cand = met.select("a", "b").repartition("b").dropDuplicates(["a", "b"])
    sketch = lambda side, name: rows.filter(side).select(F.col("sample_id").alias(name), F.col("n").alias(f"n_{name}"), *[F.col(c).alias(f"{c}_{name}") for c in _SK])
    apart = " + ".join(f"bit_count({c}_a ^ {c}_b)" for c in _SK)
    near = cand.join(sketch(F.col("train"), "b"), "b").join(sketch(~F.col("train"), "a"), "a").filter(F.expr(f"{apart} <= (({den - num}) * (n_a + n_b)) div {den + num}"))
    found = written(near.select("a", "b").distinct(), "overlap-candidates")
    side = lambda which, x: texts.filter(which).select(F.col("sample_id").alias(x), F.col("text").alias(f"text_{x}"))
    with_text = found.join(side(~F.col("train"), "a"), "a").join(side(F.col("train"), "b"), "b")
    return rows.select("sample_id", *cls).distinct(), _verified(with_text.select("text_a", "text_b"), shared, num, den)


def split_overlaps(samples: DataFrame, num: int = 8, den: int = 10) -> DataFrame:
    """All pairs sample_id_a < sample_id_b of one training and one evaluation sample similar by num/den.

    samples: sample_id, split ('train'; 'valid' or 'test'; other rows are no cases),
    messages. Null ids and splits are left out; null messages, roles and contents count
    as no words, and a sample without words is like none. Repeated rows count once.
    Copies are joined once and expanded at the end, as all pairs are asked for. Other
    columns are ignored.
    """
    members, links = class_links(samples, num, den)
    a = members.filter(~F.col("train")).select(F.col("sample_id").alias("a"), F.col("c0").alias("c0_a"), F.col("c1").alias("c1_a"))
    b = members.filter("train").select(F.col("sample_id").alias("b"), F.col("c0").alias("c0_b"), F.col("c1").alias("c1_b"))
    pairs = links.join(a, ["c0_a", "c1_a"]).join(b, ["c0_b", "c1_b"])
    return pairs.select(F.least("a", "b").alias("sample_id_a"), F.greatest("a", "b").alias("sample_id_b"))


def overlap_report(samples: DataFrame, num: int = 8, den: int = 10) -> DataFrame:
    """Per evaluation split and source: samples, those that recur in training, and the pairs, counted by class without expanding them."""
    members, links = class_links(samples, num, den)
    of_b = members.filter("train").groupBy(F.col("c0").alias("c0_b"), F.col("c1").alias("c1_b")).agg(F.count("*").alias("n"))
    per = links.join(of_b, ["c0_b", "c1_b"]).groupBy(F.col("c0_a").alias("c0"), F.col("c1_a").alias("c1")).agg(F.sum("n").alias("n"))
    ids = members.filter(~F.col("train")).join(per, ["c0", "c1"]).select("sample_id", "n")
    ev = samples.filter(F.col("split").isin("valid", "test")).select(F.col("sample_id").cast("bigint"), "split", "source")
    grouped = ev.join(ids, "sample_id", "left").groupBy("split", "source")
    return grouped.agg(F.count("*").alias("samples"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))

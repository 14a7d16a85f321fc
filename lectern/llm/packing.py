"""Filling containers of fixed capacity with related texts (problem 7).

Texts are sized in tokens of a public tokenizer. Each text keeps all of its terms with
their frequencies; texts that share rare terms come together in shards of bounded
size, each with an inverted index of all terms. The largest unused text opens a container; its
unused BM25 neighbours, and theirs, fill the window greedily, and what fits best closes
it, a neighbour first. Containers that stay too empty are filled once more in the same
way. Shards follow from the texts alone, so any cluster gives the same containers.
"""

from __future__ import annotations

import base64
import bisect
import math
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.words import words
from lectern.session import spread, written

#: The public split pattern that belongs to the tokenizer's vocabulary (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of a shard, about, in the first and the second round; bounds a task's memory.
SHARD_TEXTS, SHARD_LOOSE = 4000, 8000
#: A container filled less than this is emptied for the second round; a neighbour closes a container if it leaves no more than the rest.
FULL_ENOUGH = 0.98
#: Rarest terms of a text that decide on its shard.
ROUTE = 6
#: Slots of the table of document frequencies; bounds its size whatever the text. Words that share a slot count together.
SLOTS = 1 << 22
K1, B = 1.2, 0.75


def tokenizer_path(spark: SparkSession) -> str:
    """Vocabulary file: the setting spark.lectern.tokenizer, else $LECTERN_TOKENIZER, else the public files' usual folder."""
    return spark.conf.get("spark.lectern.tokenizer", None) or os.environ.get("LECTERN_TOKENIZER") or "/opt/tokenizers/byte_bpe_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token ranks of a vocabulary file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(ranks: dict[bytes, int]):
    """Token ids of a text."""
    import tiktoken

    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _slot(word: str) -> int:
    return xxhash.xxh64_intdigest(word) & (SLOTS - 1)


def _frequencies(docs: DataFrame) -> tuple[np.ndarray, float, int]:
    """Document frequency by slot, mean length in words, and number of texts; partial counts in every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total, n = Counter(), 0, 0
        for b in batches:
            for t in b.column(0).to_pylist():
                w = words(t)
                df.update(set(w))
                total, n = total + len(w), n + 1
            if len(df) > 1_000_000:
                yield out(df)
                df.clear()
        yield out(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2], pa.int32()), pa.array([total, n], pa.int64())], ["slot", "n"])

    def out(df: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_slot(w) for w in df], pa.int32()), pa.array(list(df.values()), pa.int64())], ["slot", "n"])

    got = docs.select("text").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = got.column("slot").to_numpy(), got.column("n").to_numpy()
    df = np.zeros(SLOTS, np.float32)
    df[slot[slot >= 0]] = n[slot >= 0]
    texts = int(n[slot == -2].sum())
    return df, float(n[slot == -1].sum()) / max(texts, 1), texts


_SIZED = "doc_id bigint, size bigint, route bigint, words bigint, terms binary"


def _vocabulary(df: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the terms of more than one text, commonest first, and their BM25 idf. A term's number is its place there."""
    at = np.flatnonzero(df > 1)
    at = at[np.lexsort((-at, -df[at]))]
    return at.astype(np.int32), np.log1p((n - df[at].astype(np.float64) + 0.5) / (df[at] + 0.5))


def coded(terms: np.ndarray, tf: np.ndarray) -> bytes:
    """Numbers of a text's terms, ascending, as gaps, and their frequencies; byte by byte of all values, so that zeros stand together and compress."""
    return np.concatenate((np.diff(terms, prepend=0), tf)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def decoded(code: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What coded made a code of."""
    gaps, tf = np.frombuffer(np.frombuffer(code, np.uint8).reshape(4, -1).T.tobytes(), "<u4").astype(np.int64).reshape(2, -1)
    return np.cumsum(gaps), tf


def _sized(docs: DataFrame, tokenizer: str, slots: np.ndarray) -> DataFrame:
    """Size in tokens, route, number of words, and all terms with their frequencies (see coded) of each text.

    Terms of one text only are left out, as they have no neighbours. The route is the
    least hash among the very rarest terms, so texts that share them tend to meet.
    """
    shared = docs.sparkSession.sparkContext.broadcast((load_ranks(tokenizer), slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, slots = shared.value
        encode = encoder(ranks)
        number = np.full(SLOTS, -1, np.int32)
        number[slots] = np.arange(len(slots))
        slot: dict[str, int] = {}
        for b in batches:
            texts = b.column(1).to_pylist()
            sizes = [len(encode(t)) for t in texts]
            if len(slot) > 1_000_000:
                slot.clear()
            counts = [Counter(words(t)) for t in texts]
            for tf in counts:
                for w in tf:
                    if w not in slot:
                        slot[w] = _slot(w)
            ids = number[np.array([slot[w] for tf in counts for w in tf], np.int64)]
            f = np.array([n for tf in counts for n in tf.values()], np.int64)
            row = np.repeat(np.arange(len(texts)), [len(tf) for tf in counts])
            dl = np.bincount(row, f, minlength=len(texts)).astype(np.int64)
            keep = np.flatnonzero(ids >= 0)
            keep = keep[np.lexsort((ids[keep], row[keep]))]
            ids, f, row = ids[keep], f[keep], row[keep]
            ends = np.searchsorted(row, np.arange(len(texts)), side="right")
            # The rarest terms of each text come last.
            rarest = np.arange(len(ids)) >= ends[row] - ROUTE
            h = slots[ids[rarest]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) >> np.uint64(1)
            routes = np.full(len(texts), np.iinfo(np.int64).max, np.int64)
            np.minimum.at(routes, row[rarest], h.astype(np.int64))
            routes[routes == np.iinfo(np.int64).max] = 0
            codes = [coded(i, n) for i, n in zip(np.split(ids, ends[:-1]), np.split(f, ends[:-1]), strict=True)] if texts else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(routes), pa.array(dl), pa.array(codes, pa.binary())], ["doc_id", "size", "route", "words", "terms"])

    return docs.select("doc_id", "text").mapInArrow(run, _SIZED)


class Index:
    """Inverted index of a shard's terms."""

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray]) -> None:
        n = np.array([len(t) for t in terms], np.int64)
        flat = np.concatenate(terms) if len(terms) else np.zeros(0, np.int64)
        vocab, t = np.unique(flat, return_inverse=True)
        order = np.argsort(t, kind="stable")
        cuts = np.searchsorted(t[order], np.arange(1, len(vocab)))
        self.doc = np.split(np.repeat(np.arange(len(n)), n)[order], cuts)
        self.weight = np.split((np.concatenate(weights) if len(weights) else np.zeros(0))[order], cuts)
        self.terms = np.split(t, np.cumsum(n)[:-1]) if len(n) else []
        self.small = np.min_scalar_type(max(len(n) - 1, 0))
        self.memo: dict[int, np.ndarray] = {}

    def near(self, i: int) -> np.ndarray:
        """Other texts of the shard that share a term with i, best BM25 score first."""
        terms = self.terms[i].tolist()
        if not terms:
            return np.zeros(0, np.int64)
        score = np.bincount(np.concatenate([self.doc[t] for t in terms]), np.concatenate([self.weight[t] for t in terms]), minlength=len(self.terms))
        score[i] = 0.0
        docs = np.flatnonzero(score)
        # Score to four places and number in one key, which sorts faster than an order of the scores.
        return np.sort(docs - (np.rint(score[docs] * 1e4).astype(np.int64) << 32)) & 0xFFFFFFFF

    def kept(self, i: int) -> np.ndarray:
        """near, kept, for where several specs ask alike."""
        got = self.memo.get(i)
        if got is None:
            got = self.memo[i] = self.near(i).astype(self.small)
        return got


class SizeIndex:
    """Unused items by size."""

    def __init__(self, sizes: np.ndarray) -> None:
        self.by_size = sorted((int(s), i) for i, s in enumerate(sizes))

    def remove(self, size: int, item: int) -> None:
        del self.by_size[bisect.bisect_left(self.by_size, (size, item))]

    def largest(self, limit: int) -> int | None:
        """The largest unused item of at most limit."""
        k = bisect.bisect_right(self.by_size, (limit, 1 << 60))
        return self.by_size[k - 1][1] if k else None


def pack(sizes: np.ndarray, capacity: int, near) -> list[list[tuple[int, bool]]]:
    """Items of each container, in order, with whether a neighbour of theirs is in it already; near(item) are its neighbours, best first."""
    free = SizeIndex(sizes)
    unused = np.ones(len(sizes), bool)
    spare = capacity - math.ceil(FULL_ENOUGH * capacity)
    out = []
    while free.by_size:
        bag: list[tuple[int, bool]] = []
        room = capacity

        def take(i: int, related: bool) -> None:
            nonlocal room
            unused[i] = False
            free.remove(int(sizes[i]), i)
            bag.append((i, related))
            room -= int(sizes[i])

        take(free.by_size[-1][1], False)
        asked = 0
        while free.by_size and free.by_size[0][0] <= room and asked < len(bag):
            some = near(bag[asked][0])
            asked += 1
            while len(some):
                some = some[unused[some] & (sizes[some] <= room)]
                if not len(some):
                    break
                s = sizes[some]
                closing = np.flatnonzero(s >= max(room - spare, 1))
                if len(closing):
                    take(int(some[closing[0]]), True)
                    break
                # What comes before the last place leaves room for an item that fits it well.
                early = np.flatnonzero(2 * s <= room)
                if not len(early):
                    break
                take(int(some[early[0]]), True)
        related = np.zeros(len(sizes), bool)
        for i, _ in bag if free.by_size and free.by_size[0][0] <= room else ():
            related[near(i)] = True
        while free.by_size and (i := free.largest(room)) is not None:
            # Of the items that fit equally well, a neighbour.
            size = int(sizes[i])
            k = bisect.bisect_left(free.by_size, (size, -1))
            i = next((x for _, x in free.by_size[k : bisect.bisect_right(free.by_size, (size, 1 << 60))] if related[x]), i)
            take(i, bool(related[i]))
        out.append(bag)
    return out


_OUT = "spec_id int, container_id string, doc_id bigint, part int, start_token bigint, n_tokens bigint, position int, related boolean"
_NAMES = ["spec_id", "container_id", "doc_id", "part", "start_token", "n_tokens", "position", "related"]
_TYPES = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
_ARROW = pa.schema(list(zip(_NAMES, _TYPES, strict=True)))


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], schema=_ARROW)


def _index(t: pa.Table, idf: np.ndarray, mean: float) -> Index:
    """Index of the texts of t, with the BM25 weights of their terms."""
    terms, weights = [], []
    for code, dl in zip(t.column("terms").to_pylist(), t.column("words").to_pylist(), strict=True):
        ids, f = decoded(code)
        terms.append(ids)
        weights.append(idf[ids] * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / max(mean, 1e-9))))
    return Index(terms, weights)


def _sharded(rows: DataFrame, by: list[str], n: int, target: int) -> DataFrame:
    """rows with shard columns g and sub: by route, and by text as well where more than twice the target meet.

    Copies may hold a third of all rows; their route is one value, which sub splits.
    """
    groups = max(1, math.ceil(n / target))
    x = rows.withColumn("g", F.expr(f"pmod(route, {groups})"))
    heavy = x.groupBy(*by, "g").agg(F.count("*").alias("m")).filter(F.col("m") > 2 * target).withColumn("pieces", F.ceil(F.col("m") / target)).drop("m")
    return x.join(heavy, [*by, "g"], "left").withColumn("sub", F.when(F.col("pieces").isNotNull(), F.expr("pmod(xxhash64(doc_id), pieces)")).otherwise(F.lit(0).cast("bigint"))).drop("pieces")


def containers(docs: DataFrame, specs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """For each row of specs, every text in containers of at most capacity_tokens.

    docs: doc_id, text (null texts are left out, empty ones have size 0 and are assigned
    too). specs: spec_id, capacity_tokens (a short list of settings; rows that are null
    or below 1 are ignored). Out: spec_id, container_id, doc_id, part (0 unless the text
    alone exceeds the capacity), start_token, n_tokens, position in the container, and
    whether a BM25 neighbour stands before it there. Of the texts only sizes and terms are
    shuffled.
    """
    spark = docs.sparkSession
    wanted = sorted({(int(r[0]), int(r[1])) for r in specs.select("spec_id", "capacity_tokens").collect() if r[0] is not None and r[1] and r[1] > 0})
    capacity = dict(wanted)
    slim = spread(docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), "text"))
    df, mean, n = _frequencies(slim)
    slots, idf = _vocabulary(df, n)
    sized = written(_sized(slim, tokenizer or tokenizer_path(spark), slots), "packing-texts")
    weigh = spark.sparkContext.broadcast(idf)

    def first(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        label = f"a{key[0].as_py()}-{key[1].as_py()}"
        ids, size = t.column("doc_id").to_pylist(), t.column("size").to_numpy()
        index = _index(t, weigh.value, mean)
        rows = []
        for spec, cap in wanted:
            k = 0
            for i in np.flatnonzero(size > cap).tolist():  # full parts of texts that exceed the capacity
                for part in range(int(size[i]) // cap):
                    rows.append((spec, f"{label}-{k}", ids[i], part, part * cap, cap, 0, False))
                    k += 1
            rest = np.where(size > cap, size % cap, size)
            item = np.flatnonzero((size <= cap) | (rest > 0))
            place = np.full(len(size), -1)
            place[item] = np.arange(len(item))

            def near(i: int, item: np.ndarray = item, place: np.ndarray = place) -> np.ndarray:
                p = place[index.kept(int(item[i]))]
                return p[p >= 0]

            for bag in pack(rest[item], cap, near):
                for position, (i, related) in enumerate(bag):
                    x = int(item[i])
                    part = int(size[x]) // cap if size[x] > cap else 0
                    rows.append((spec, f"{label}-{k}", ids[x], part, part * cap, int(rest[x]), position, related))
                k += 1
        return _table(rows)

    packed = written(_sharded(sized, [], n, SHARD_TEXTS).groupBy("g", "sub").applyInArrow(first, _OUT), "packing")
    fill = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("filled"))
    cap = F.coalesce(*[F.when(F.col("spec_id") == s, F.lit(c)) for s, c in wanted]) if wanted else F.lit(1)
    loose_keys = written(fill.filter(F.col("filled") < FULL_ENOUGH * cap).select("spec_id", "container_id"), "packing-loose")
    kept = packed.join(loose_keys, ["spec_id", "container_id"], "left_anti")
    loose = packed.join(loose_keys, ["spec_id", "container_id"], "left_semi").select("spec_id", "doc_id", "part", "start_token", "n_tokens")

    def again(key: tuple, t: pa.Table) -> pa.Table:
        spec, label = key[0].as_py(), f"b{key[1].as_py()}-{key[2].as_py()}"
        t = t.sort_by([("doc_id", "ascending"), ("part", "ascending")])
        index = _index(t, weigh.value, mean)
        held = list(zip(*[t.column(c).to_pylist() for c in ("doc_id", "part", "start_token", "n_tokens")], strict=True))
        bags = pack(t.column("n_tokens").to_numpy(), capacity[spec], index.near)
        return _table([(spec, f"{label}-{k}", *held[i], p, related) for k, bag in enumerate(bags) for p, (i, related) in enumerate(bag)])

    most = loose.groupBy("spec_id").count().agg(F.max("count")).first()[0] or 0
    with_terms = loose.join(sized.select("doc_id", "route", "words", "terms"), "doc_id")
    pieces = _sharded(with_terms, ["spec_id"], most, SHARD_LOOSE)
    return kept.select(*_NAMES).unionByName(pieces.groupBy("spec_id", "g", "sub").applyInArrow(again, _OUT))


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers, texts, tokens, the share of all capacity that is used, and the share of items that joined a BM25 neighbour.

    The first item of a container has none before it, so it doesn't count.
    """
    joined = F.count_if(F.col("position") > 0)
    per = packed.groupBy("spec_id").agg(
        F.count_distinct("container_id").alias("containers"), F.count_distinct("doc_id").alias("texts"), F.sum("n_tokens").alias("tokens"),
        F.round(F.count_if("related") / F.nullif(joined, F.lit(0)), 6).alias("related_share"),
    )
    both = per.join(specs.select("spec_id", "spec_name", "capacity_tokens"), "spec_id")
    return both.withColumn("used_share", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def placement(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: texts placed, texts whose parts don't follow on each other from 0, texts split though they fit, and overfull containers."""
    caps = specs.select("spec_id", "capacity_tokens")
    one = packed.groupBy("spec_id", "doc_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("size"), F.count_distinct("part").alias("different"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.max("part").alias("last"))
    one = one.join(caps, "spec_id")
    wrong = (F.col("parts") != F.col("different")) | (F.col("last") + 1 != F.col("parts")) | (F.col("end") != F.col("size"))
    texts = one.groupBy("spec_id").agg(F.count("*").alias("texts"), F.count_if(wrong).alias("misplaced"), F.count_if((F.col("parts") > 1) & (F.col("size") <= F.col("capacity_tokens"))).alias("split_needlessly"))
    full = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("filled")).join(caps, "spec_id").groupBy("spec_id").agg(F.count_if(F.col("filled") > F.col("capacity_tokens")).alias("overfull"))
    return texts.join(full, "spec_id")

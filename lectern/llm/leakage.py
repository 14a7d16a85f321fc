"""Evaluation passages inside training text (problem 8).

Training texts are cut into shards; each shard's FM-index over word numbers is built
once and written, whatever the evaluation set. Evaluation phrases are searched in all
shards by backward search, block by block, and their places are merged into spans.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.fmindex import FMIndex
from lectern.llm.tokensets import WordHashes
from lectern.llm.words import spans, words
from lectern.session import spread, written

#: Words of evaluation text that are searched for together; more text is searched in several blocks.
BLOCK_WORDS = 4_000_000
#: Words of an index shard; bounds a task's memory. A longer text is a shard of its own.
SHARD_WORDS = 400_000

_SHARDS = "doc_ids binary, starts binary, vocab binary, fm binary"


def build_index(docs: DataFrame) -> DataFrame:
    """One row a shard of docs(doc_id, text): ids and first words of its texts, its vocabulary (hashes), its FM-index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        ids: list[int] = []
        starts: list[int] = []
        flat: list[int] = []

        def flush() -> pa.RecordBatch:
            h = np.array(flat, np.uint64)
            edge = np.zeros(len(h), bool)
            edge[np.array(starts[1:] + [len(h)], np.int64) - 1] = True
            vocab, inner = np.unique(h[~edge], return_inverse=True)
            sym = np.zeros(len(h), np.int64)
            sym[~edge] = inner + 1
            fm = FMIndex.of(sym, len(vocab) + 1).packed()
            cols = [np.array(ids, np.int64).tobytes(), np.array(starts, np.int64).tobytes(), vocab.tobytes(), fm]
            ids.clear(), starts.clear(), flat.clear()
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cols], ["doc_ids", "starts", "vocab", "fm"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(doc_id), starts.append(len(flat))
                flat.extend([cache[w] for w in words(text)])
                flat.append(0)
                if len(flat) >= SHARD_WORDS:
                    yield flush()
        if ids:
            yield flush()

    return docs.mapInArrow(run, _SHARDS)


def item_words(items: DataFrame) -> DataFrame:
    """item_id and the hashes of its words, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            rows = [np.array([cache[w] for w in words(t)], np.uint64).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int64()))], ["item_id", "w"])

    return items.select("item_id", "text").mapInArrow(run, "item_id bigint, w array<bigint>")


_HITS = "doc_id bigint, items array<bigint>, firsts array<int>"


def _search(index: DataFrame, block: pa.Table, n: int) -> DataFrame:
    """doc_id, items, firsts (numbers of the first words of all phrases found) over all shards for a block of items."""
    w = block.column("w").combine_chunks()
    shared = index.sparkSession.sparkContext.broadcast((block.column("item_id").to_numpy(), w.value_lengths().to_numpy().astype(np.int64), w.flatten().to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, size, flat = shared.value
        flat = flat.view(np.uint64)
        owner = np.repeat(np.arange(len(item)), size)
        # Phrases that stay within an item.
        at = np.flatnonzero(owner[: max(len(flat) - n + 1, 0)] == owner[n - 1 :]) if len(flat) >= n else np.zeros(0, np.int64)
        for b in batches:
            for ids, starts, vocab, fm in zip(*[b.column(c).to_pylist() for c in ("doc_ids", "starts", "vocab", "fm")], strict=True):
                ids, starts, vocab = np.frombuffer(ids, np.int64), np.frombuffer(starts, np.int64), np.frombuffer(vocab, np.uint64)
                if not len(vocab) or not len(at):
                    continue
                k = np.minimum(np.searchsorted(vocab, flat), len(vocab) - 1)
                local = np.where(vocab[k] == flat, k + 1, 0)
                # Phrases of words that the shard knows.
                unknown = np.concatenate(([0], np.cumsum(local == 0)))
                some = at[unknown[at + n] == unknown[at]]
                if not len(some):
                    continue
                x = FMIndex.unpacked(fm)
                rows, lo, hi = x.search(np.lib.stride_tricks.sliding_window_view(local, n)[some])
                if not len(rows):
                    continue
                cnt = hi - lo
                first = np.concatenate(([0], np.cumsum(cnt)))
                where = x.locate(np.arange(first[-1]) + np.repeat(lo - first[:-1], cnt))
                found = item[owner[some[np.repeat(rows, cnt)]]]
                doc = np.searchsorted(starts, where, side="right") - 1
                order = np.lexsort((where, doc))
                doc, where, found = doc[order], where[order], found[order]
                cut = np.flatnonzero(np.diff(doc)) + 1
                docs_ = doc[np.concatenate(([0], cut))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[docs_]), pa.array([np.unique(f) for f in np.split(found, cut)], pa.list_(pa.int64())), pa.array([np.unique(p - starts[d]).astype(np.int32) for p, d in zip(np.split(where, cut), docs_, strict=True)], pa.list_(pa.int32()))],
                    ["doc_id", "items", "firsts"],
                )

    return index.mapInArrow(run, _HITS)


def _char_spans(n: int):
    """Character spans of merged phrases, of texts with hits only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            merged = []
            for text, firsts in zip(b.column("text").to_pylist(), b.column("firsts").to_pylist(), strict=True):
                w, p = spans(text), np.array(sorted(set(firsts)))
                gap = np.flatnonzero(p[1:] > p[:-1] + n) + 1
                merged.append([{"start_pos": w[g[0]][0], "end_pos": w[g[-1] + n - 1][1]} for g in np.split(p, gap)])
            kind = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("items"), pa.array(merged, kind)], ["doc_id", "items", "spans"])

    return run


def leaked_items(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, items (ids that leaked, sorted), firsts (numbers of the first words of phrases) of documents with leaks; see leaks."""
    items = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint"), "text")
    asked = written(item_words(items), "leak-items")
    total = asked.agg(F.sum(F.size("w"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_WORDS))
    index = written(build_index(spread(docs)), "leak-index")
    parts = [_search(index, asked.filter(F.expr(f"pmod(xxhash64(item_id), {blocks}) = {k}")).toArrow(), n) for k in range(blocks)]
    if blocks == 1:
        return parts[0]
    both = reduce(DataFrame.unionByName, parts).groupBy("doc_id")
    return both.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("firsts")).alias("firsts"))


def leaks(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Documents that share at least n consecutive words with an evaluation item.

    docs: doc_id (unique), text. items: item_id, text. Out: doc_id, items (ids that
    leaked, sorted), spans (merged character spans [start, end) to remove, sorted). Texts
    are whole; null, empty and shorter texts never match; rows with a null item_id
    are ignored; other columns are ignored. The items are a stated query set: they
    are taken in blocks of bounded size and every block meets the index of all documents,
    which are read as words once. Only texts with hits are read again for their spans.
    """
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), "text")
    hits = written(leaked_items(texts, items, n), "leak-hits")
    return hits.join(texts, "doc_id").select("doc_id", "items", "firsts", "text").mapInArrow(_char_spans(n), "doc_id bigint, items array<bigint>, spans array<struct<start_pos:int,end_pos:int>>")

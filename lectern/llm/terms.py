"""Frequencies of all distinct values by burst tries (problem 4).

Every task keeps a burst trie over (field, term, record) with an occurrence counter, so
repeated values and repeated rows are added up where they are read. Its subtrees are
written, cut at prefixes that share all entries evenly, and meet by these routes, where
matching subtrees are merged. A walk over a merged trie gives each term's occurrences and
records; a term that lies across routes is summed at the end.
"""

from __future__ import annotations

import bisect
import math
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import spread, written

#: A trie's container is burst beyond so many entries.
CONTAINER = 512
#: A task hands on its trie when it holds so many entries; bounds its memory.
TASK_ENTRIES = 400_000
#: Entries of a route, about, and sampled containers for each.
ROUTE_ENTRIES, ROUTE_SAMPLE = 400_000, 20


class BurstTrie:
    """Strings with a counter each.

    Inner nodes branch by character; leaves are containers (hash tables of
    remaining suffixes) that burst into a node when they grow too large.
    """

    def __init__(self, limit: int = CONTAINER) -> None:
        self.limit, self.size = limit, 0
        self.root: dict = {}
        self.is_node = {id(self.root): False}

    def _leaf(self, key: str) -> tuple[dict, int]:
        """The container that key belongs to, and its depth."""
        node, depth = self.root, 0
        while self.is_node[id(node)]:
            c = key[depth : depth + 1]
            node = self._child(node, c)
            if not c:
                break
            depth += 1
        return node, depth

    def _child(self, node: dict, c: str) -> dict:
        child = node.get(c)
        if child is None:
            child = node[c] = {}
            self.is_node[id(child)] = False
        return child

    def add(self, key: str, n: int) -> None:
        node, depth = self._leaf(key)
        suffix = key[depth:]
        old = node.get(suffix)
        node[suffix] = n if old is None else old + n
        if old is None:
            self.size += 1
            if len(node) > self.limit:
                self._burst(node)

    def graft(self, path: str, suffixes: list[str], counts: list[int]) -> None:
        """Merges a container of another trie, which lies at path, with the matching subtree."""
        node, depth = self.root, 0
        while self.is_node[id(node)] and depth < len(path):
            node, depth = self._child(node, path[depth]), depth + 1
        if depth < len(path):  # our container lies higher up: theirs joins it with longer suffixes
            head = path[depth:]
            suffixes = [head + s for s in suffixes]
        elif self.is_node[id(node)]:  # ours has burst
            for s, n in zip(suffixes, counts, strict=True):
                self.add(path + s, n)
            return
        before = len(node)
        for s, n in zip(suffixes, counts, strict=True):
            node[s] = node.get(s, 0) + n
        self.size += len(node) - before
        if len(node) > self.limit:
            self._burst(node)

    def _burst(self, node: dict) -> None:
        todo = [node]
        while todo:
            node = todo.pop()
            entries = list(node.items())
            node.clear()
            self.is_node[id(node)] = True
            for suffix, n in entries:
                self._child(node, suffix[:1])[suffix[1:]] = n
            todo += [child for c, child in node.items() if c and len(child) > self.limit]  # all began alike

    def containers(self) -> Iterator[tuple[str, dict]]:
        """All containers with their paths, in the order of their strings."""
        stack = [("", self.root)]
        while stack:
            path, node = stack.pop()
            if self.is_node[id(node)]:
                stack.extend((path + c, node[c]) for c in sorted(node, reverse=True))
            else:
                yield path, node

    def items(self) -> Iterator[tuple[str, int]]:
        """All strings with their counters, in order."""
        for path, node in self.containers():
            for suffix in sorted(node):
                yield path + suffix, node[suffix]


def normal(value: str) -> str:
    """Unicode NFKC, lower-casing, trimming, one space for each run of white space."""
    return " ".join(unicodedata.normalize("NFKC", value).lower().split())


#: Ends a term in an entry; terms that hold it or the escape are escaped.
_END, _ESCAPE = "\x00", "\x01"


def _escaped(term: str) -> str:
    return term.replace(_ESCAPE, _ESCAPE * 2).replace(_END, _ESCAPE + "\x02") if _END in term or _ESCAPE in term else term


def _plain(term: str) -> str:
    if _ESCAPE not in term:
        return term
    return term.replace(_ESCAPE * 2, "\ue000").replace(_ESCAPE + "\x02", _END).replace("\ue000", _ESCAPE)


_SUBTREES = "path string, suffixes array<string>, counts array<bigint>"
_COUNTS = "field_name string, term string, occurrences bigint, works bigint"


def _handed_on(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
    """Containers of a trie as rows."""
    rows = list(trie.containers())
    for k in range(0, len(rows), 2000):
        part = [(p, sorted(c.items())) for p, c in rows[k : k + 2000] if c]
        cols = [pa.array([p for p, _ in part], pa.string()), pa.array([[s for s, _ in c] for _, c in part], pa.list_(pa.string())), pa.array([[n for _, n in c] for _, c in part], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["path", "suffixes", "counts"])


def task_tries(rows: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Containers of every task's trie over all non-blank values of the array columns; an entry is field, term and record."""
    slim = rows.select(F.col(key).cast("string").alias("rec"), *[F.col(f).cast("array<string>").alias(f"v{k}") for k, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie()
        for b in batches:
            recs = ["0" if r is None else "1" + r for r in b.column(0).to_pylist()]
            for k in range(len(fields)):
                col = b.column(k + 1)
                flat = pa.compute.list_flatten(col).dictionary_encode()
                terms = [chr(48 + k) + _escaped(t) + _END if v and (t := normal(v)) else None for v in flat.dictionary.to_pylist()]
                for row, i in zip(pa.compute.list_parent_indices(col).to_pylist(), flat.indices.to_pylist(), strict=True):
                    if i is not None and (t := terms[i]) is not None:
                        trie.add(t + recs[row], 1)
            if trie.size > TASK_ENTRIES:
                yield from _handed_on(trie)
                trie = BurstTrie()
        yield from _handed_on(trie)

    return spread(slim).mapInArrow(run, _SUBTREES)


def _routes(partial: DataFrame) -> list[str]:
    """Strings that cut all entries into parts of about equal size, from a sample of containers; only the balance depends on it."""
    total = partial.agg(F.sum(F.size("counts"))).first()[0] or 0
    n = math.ceil(total / ROUTE_ENTRIES)
    if n < 2:
        return []
    first = F.concat("path", F.get("suffixes", F.lit(0)))
    some = partial.select(first.alias("s"), F.size("counts").alias("n")).orderBy(F.xxhash64("s", "n"), "s").limit(n * ROUTE_SAMPLE).collect()
    cuts, seen = [], 0
    some = sorted((r[0], r[1]) for r in some)
    step = sum(c for _, c in some) / n
    for s, c in some:
        if seen + c > step * (len(cuts) + 1) and (not cuts or s > cuts[-1]):
            cuts.append(s)
        seen += c
    return cuts


def _routed(partial: DataFrame, cuts: list[str]) -> DataFrame:
    """Containers with their route; one that lies across a cut is split there."""
    shared = partial.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for b in batches:
            out = []
            for path, suffixes, counts in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                lo = bisect.bisect_right(at, path + suffixes[0])
                if lo == bisect.bisect_right(at, path + suffixes[-1]):
                    out.append((lo, path, suffixes, counts))
                    continue
                split: dict[int, tuple[list, list]] = {}
                for s, n in zip(suffixes, counts, strict=True):
                    part = split.setdefault(bisect.bisect_right(at, path + s), ([], []))
                    part[0].append(s), part[1].append(n)
                out += [(r, path, *x) for r, x in split.items()]
            cols = zip(*out, strict=True) if out else [[]] * 4
            types = (pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["route", "path", "suffixes", "counts"])

    return partial.mapInArrow(run, "route int, " + _SUBTREES)


def _merged(fields: tuple[str, ...]):
    """Merges the subtrees of each route (rows come sorted by it) and counts each term's occurrences and records."""

    def counted(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        last = None
        for entry, n in trie.items():
            head, _, rec = entry.partition(_END)
            if head != last:
                last = head
                rows.append([fields[ord(head[0]) - 48], _plain(head[1:]), 0, 0])
            rows[-1][2] += n
            rows[-1][3] += rec[:1] == "1"
        for k in range(0, len(rows), 50_000):
            cols = zip(*rows[k : k + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["field_name", "term", "occurrences", "works"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trie = None, BurstTrie()
        for b in batches:
            for route, path, suffixes, counts in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                if route != now:
                    yield from counted(trie)
                    now, trie = route, BurstTrie()
                trie.graft(path, suffixes, counts)
        yield from counted(trie)

    return run


def term_counts(rows: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """field_name, term, occurrences, works of all distinct terms.

    Occurrences count every value of every row; works counts distinct non-null keys.
    Null and blank values are ignored. Repeated rows of a key are added up in the task
    that reads them; a term that stands in all records is cut into routes by record,
    so neither is a hot spot.
    """
    partial = written(task_tries(rows, key, fields), "term-tries")
    routed = _routed(partial, _routes(partial))
    parts = routed.repartition("route").sortWithinPartitions("route", "path").mapInArrow(_merged(fields), _COUNTS)
    return parts.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("works").alias("works"))


def marked_terms(rows: DataFrame, key: str = "work_key", fields: tuple[str, ...] = ("subjects", "genres"), rare: int = 2, common: float = 0.05) -> DataFrame:
    """term_counts with mark: 'rare' (at most so many works), else 'common' (in more than that share of all works), else null."""
    n = rows.select(key).filter(F.col(key).isNotNull()).distinct().count()
    mark = F.when(F.col("works") <= rare, "rare").when(F.col("works") > common * n, "common")
    return term_counts(rows, key, fields).withColumn("mark", mark)

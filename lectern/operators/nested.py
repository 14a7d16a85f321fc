"""Nested JSON records as related flat tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import jsonindex

#: Fields whose value is an array, or one bare value in its place (fixed by the data's description).
LIST_FIELDS = (
    "works", "authors", "languages", "isbn_13", "isbn_10", "covers", "publishers", "contributors", "ids",
    "table_of_contents", "entries", "notes", "source_records", "alternate_names", "links", "archived", "photos",
    "affiliations", "places", "years",
)
#: Every list directly under these objects is array-valued too.
LIST_PARENTS = ("identifiers",)
#: Rows of a batch that are indexed together; bounds a worker's memory, not the result.
BLOCK_ROWS = 4000


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, BLOCK_ROWS):
            yield b.slice(k, BLOCK_ROWS)


def _lists(values: pa.Array, doc: np.ndarray, rows: np.ndarray) -> pa.Array:
    """values (sorted by doc) as one list per row of rows."""
    off = np.append(np.searchsorted(doc, rows), len(doc)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), values)


def element_paths(lines: DataFrame, list_fields: tuple = LIST_FIELDS, list_parents: tuple = LIST_PARENTS) -> DataFrame:
    """Per readable line, the paths of its non-null array elements.

    lines: rec_key string, revision string, js string. Out: rec_key, revision double
    (unreadable numbers count as -1), paths array<string>. Lines whose js is null,
    empty or not a JSON object (directly or as a JSON text inside a JSON string)
    vanish; other columns of the input are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            ix = jsonindex.index(jsonindex.unwrap(b.column("js")))
            paths, is_case, _ = jsonindex.item_paths(ix, list_fields, list_parents)
            rows = np.flatnonzero(ix["valid"])
            doc = ix["doc"][is_case]
            lists = _lists(paths.filter(pa.array(is_case)).cast(pa.string()), doc, rows)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column("rec_key").take(take), b.column("revision").take(take), lists], ["rec_key", "revision", "paths"])

    slim = lines.select("rec_key", F.coalesce(F.expr("try_cast(revision as double)"), F.lit(-1.0)).alias("revision"), "js")
    return slim.mapInArrow(run, "rec_key string, revision double, paths array<string>")


def newest_elements(lines: DataFrame, **kw: tuple) -> DataFrame:
    """rec_key, item_path of the newest readable line of each key (repeated lines count once).

    Only the compact path lists are shuffled, never the records; the aggregation is
    partial on the map side, so a key with very many lines is no hot spot.
    """
    best = element_paths(lines.filter(F.col("rec_key").isNotNull()), **kw).groupBy("rec_key").agg(F.max_by("paths", "revision").alias("paths"))
    return best.select("rec_key", F.explode("paths").alias("item_path"))


NODE_SCHEMA = (
    "rec_key string, revision double, nodes array<struct<node_path:string,parent_path:string,field:string,position:int,kind:string,value:string>>"
)


def flat_nodes(lines: DataFrame, list_fields: tuple = LIST_FIELDS, list_parents: tuple = LIST_PARENTS) -> DataFrame:
    """Flat child table: every value below the root with the path of the value that holds it.

    Columns rec_key, node_path, parent_path ('' below the root), field (null for array
    elements), position (null for plain members), kind (scalar, null, object, array),
    value (the scalar as text, strings decoded; else null). Newest readable line of a key only.
    """
    names = {"s": "scalar", "n": "null", "o": "object", "a": "array"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            ix = jsonindex.index(jsonindex.unwrap(b.column("js")))
            paths, _, pos = jsonindex.item_paths(ix, list_fields, list_parents)
            rows = np.flatnonzero(ix["valid"])
            parent = ix["parent"]
            up = paths.take(pa.array(np.maximum(parent, 0))) if len(parent) else paths
            up = pa.compute.if_else(pa.array(parent < 0), "", up)
            member = ix["pos"] < 0
            field = pa.compute.if_else(pa.array(member), ix["key"], None)
            kind = pa.array([names[k] for k in ix["kind"]], pa.string())
            text = pa.array([_decoded(t) if k == "s" else None for t, k in zip(ix["text"].to_pylist(), ix["kind"], strict=True)], pa.string())
            nodes = pa.StructArray.from_arrays(
                [paths.cast(pa.string()), up.cast(pa.string()), field.cast(pa.string()), pa.array(pos, pa.int32(), mask=pos < 0), kind, text],
                ["node_path", "parent_path", "field", "position", "kind", "value"],
            )
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column("rec_key").take(take), b.column("revision").take(take), _lists(nodes, ix["doc"], rows)], ["rec_key", "revision", "nodes"])

    slim = lines.filter(F.col("rec_key").isNotNull()).select("rec_key", F.coalesce(F.expr("try_cast(revision as double)"), F.lit(-1.0)).alias("revision"), "js")
    best = slim.mapInArrow(run, NODE_SCHEMA).groupBy("rec_key").agg(F.max_by("nodes", "revision").alias("nodes"))
    return best.select("rec_key", F.inline("nodes"))


def _decoded(text: str) -> str:
    import json

    return json.loads(text) if text[:1] == '"' else text


def dump_lines(authors: DataFrame, editions: DataFrame) -> DataFrame:
    """Author and edition lines of two dump tables as rec_key, revision, js."""
    a = authors.filter(F.col("rec_type") == "/type/author").select(F.col("author_key").alias("rec_key"), "revision", "js")
    e = editions.filter(F.col("rec_type") == "/type/edition").select(F.col("edition_key").alias("rec_key"), "revision", "js")
    return a.unionByName(e)

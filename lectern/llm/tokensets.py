"""Word sets as numbers: hashes, class ids of equal sets, parity sketches."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class WordHashes(dict):
    """64-bit hash of a word, remembered; emptied when it grows too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def class_id(words: set[str]) -> tuple[int, int]:
    """128-bit id of a word set; equal sets share it."""
    d = hashlib.blake2b("\x00".join(sorted(words)).encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return tuple(np.frombuffer(d, np.int64).tolist())


def parity_sketches(hashes: np.ndarray, sizes: np.ndarray, longs: int) -> list[np.ndarray]:
    """Per set, the parity of its elements in 64 * longs cells, as that many int64 columns.

    Each element in which two sets differ flips one cell, so the number of differing
    cells never exceeds the size of the symmetric difference: a safe filter.
    """
    cells = 64 * longs
    row = np.repeat(np.arange(len(sizes)), sizes)
    cell = (hashes >> np.uint64(40)).astype(np.int64) % cells
    odd = (np.bincount(row * cells + cell, minlength=len(sizes) * cells) & 1).astype(np.uint8).reshape(len(sizes), cells)
    packed = np.packbits(odd, axis=1, bitorder="little").view(np.int64)
    return [np.ascontiguousarray(packed[:, k]) for k in range(longs)]


def list_column(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """values cut into lists of the given sizes."""
    off = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values))


def members_pairs(classes: DataFrame, links: DataFrame, member: str, cls: list[str]) -> DataFrame:
    """All pairs of members of linked classes, and of members of one class, as (a, b).

    classes: member and class columns; links: class columns suffixed _a and _b. This
    expansion is the asked-for result; skewed classes are split by adaptive execution.
    """
    a = classes.select(F.col(member).alias("a"), *[F.col(c).alias(f"{c}_a") for c in cls])
    b = classes.select(F.col(member).alias("b"), *[F.col(c).alias(f"{c}_b") for c in cls])
    across = links.join(a, [f"{c}_a" for c in cls]).join(b, [f"{c}_b" for c in cls]).select("a", "b")
    same = a.select("a", *[F.col(f"{c}_a").alias(f"{c}_b") for c in cls]).join(b, [f"{c}_b" for c in cls]).filter("a < b").select("a", "b")
    return across.unionByName(same)

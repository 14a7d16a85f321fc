"""Scalar expressions of the catalog: casts, buckets, scores, seeded randomness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A four-digit year from 1000 to 2099.
YEAR = "(1[0-9]{3}|20[0-9]{2})"
#: Eras and lengths as (label, lowest, highest), fixed values.
ERAS = (("klasik", None, 1899), ("modern", 1900, 1989), ("cagdas", 1990, None))
LENGTHS = (("kisa", None, 200), ("orta", 201, 400), ("uzun", 401, 700), ("tugla", 701, None))
#: Subjects that catalogs add for themselves (fixed value).
MACHINE_SUBJECT = (
    "^(nyt|ol|award|amazon):|new york times bestseller|^long now manual|^accessible book$|^protected daisy$|"
    "^in library$|^overdrive$|^internet archive wishlist$"
)


def ascii_text(c: Column | str) -> Column:
    """Text in which every character outside ASCII is a sign that is part of no word.

    Word boundaries in patterns then know ASCII letters only, whatever the regex engine
    thinks of others; lookarounds to the same end would cost several times as much.
    """
    return F.regexp_replace(c, r"[^\x00-\x7f]", "\x01")


def int_of(c: Column | str) -> Column:
    """A whole number read from text; fractions are rounded, what is no number is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.try_cast("double")).try_cast("int")


def year_of(c: Column | str) -> Column:
    """The first year in a text."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), YEAR, 1).try_cast("int")


def rounded_mean(c: Column) -> Column:
    """Mean as a whole number, halves to even."""
    return F.rint(F.avg(c)).cast("int")


def bucket(c: Column | str, table: tuple, positive: bool = False) -> Column:
    """Label of the range that holds c; null for null, and for nothing positive where asked."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.when(c.isNull() | (c <= 0 if positive else F.lit(False)), None)
    for label, low, high in table:
        inside = (F.lit(True) if low is None else c >= low) & (F.lit(True) if high is None else c <= high)
        out = out.when(inside, label)
    return out


def signal(ratings: Column, readers: Column, editions: Column) -> Column:
    """How well known a work is, on a logarithmic scale."""
    return 3 * F.log1p(ratings) + 2 * F.log1p(readers) + F.log1p(editions)


def overlap(a: Column | str, b: Column | str) -> Column:
    """Number of common elements; 0 for nulls."""
    return F.coalesce(F.size(F.array_intersect(a, b)), F.lit(0))


def joined_once(*lists: Column) -> Column:
    """The lists one after the other, each value at its first place; nulls count as empty."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


def unit(key: Column | str, seed: int | str) -> Column:
    """A number in [0, 1) that depends on key and seed only, the same on every engine that knows md5."""
    text = F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def all_of(conditions: list[Column]) -> Column:
    """Conjunction; true without conditions."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))

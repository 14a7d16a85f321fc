"""Evaluation: judge scores, pick metrics, relabelling, diversity, quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import FORMAL, is_turkish, marks, ngrams, shares_ngram, words_of


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)


def judge_score(records: DataFrame) -> DataFrame:
    """One row of judge metrics over records(grades map<string,int>, ids array<string>, n_limit int).

    Only rated records count; the mean over the best and over all candidates bounds it.
    """
    values = F.sort_array(F.transform(F.map_values("grades"), lambda g: g.cast("double")), asc=False)
    x = records.filter(F.size(F.map_keys("grades")) > 0).withColumn("values", values)
    top = F.slice("values", 1, F.col("n_limit"))
    picked = F.slice(F.filter(F.transform("ids", lambda i: F.try_element_at("grades", i).cast("double")), lambda g: g.isNotNull()), 1, F.col("n_limit"))
    x = x.select(_mean(top).alias("ideal"), _mean(F.col("values")).alias("rand"), picked.alias("picked"))
    size = F.sum(F.size("picked"))
    total = F.sum(F.aggregate("picked", F.lit(0.0), lambda a, b: a + b))
    count = lambda g: F.sum(F.size(F.filter("picked", lambda v: v == g)))
    out = x.agg(
        F.count("*").alias("n"), F.avg((F.size("picked") == 0).cast("double")).alias("no_pick"), F.avg("rand").alias("random_grade"), F.avg("ideal").alias("ideal_grade"),
        (total / size).alias("mean_grade"), (count(2.0) / size).alias("good_rate"), (count(0.0) / size).alias("bad_rate"),
    )
    span = F.col("ideal_grade") - F.col("random_grade")
    out = out.withColumn("normalized", F.when(span > 1e-9, (F.col("mean_grade") - F.col("random_grade")) / span).otherwise(0.0))
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns if c != "n"])


def pick_metrics(records: DataFrame) -> DataFrame:
    """Micro-averaged metrics over records(ids, reference, valid_ids array<string>, n_limit int)."""
    hits = F.size(F.array_intersect("ids", "reference"))
    x = records.select(hits.alias("hits"), F.size("ids").alias("picked"), F.least(F.size("reference"), F.col("n_limit")).alias("wanted"), F.size(F.array_intersect("ids", "valid_ids")).alias("valid"), (F.size("ids") <= F.col("n_limit")).cast("double").alias("kept_limit"), (F.size("ids") > 0).cast("double").alias("covered"))
    r = lambda c: F.round(c, 6)
    return x.agg(F.count("*").alias("n"), r(F.sum("hits") / F.sum("picked")).alias("pick_precision"), r(F.sum("hits") / F.sum("wanted")).alias("pick_recall"), r(F.sum("valid") / F.sum("picked")).alias("id_valid"), r(F.avg("kept_limit")).alias("limit_respected"), r(F.avg("covered")).alias("coverage"), r(F.avg("picked")).alias("avg_picks"))


def relabelled(grades: Column, reference: Column, order: Column, limit: Column) -> Column:
    """Ids by grade (only 1 and 2), then place in the reference, then in the list; at most limit."""
    ids = F.filter(order, lambda i: F.coalesce(F.try_element_at(grades, i) >= 1, F.lit(False)))
    far = F.lit(1 << 20)
    place = lambda a, i: F.coalesce(F.nullif(F.array_position(a, i), F.lit(0)), far)
    keyed = F.transform(ids, lambda i: F.struct((-F.try_element_at(grades, i)).alias("g"), place(reference, i).alias("r"), place(order, i).alias("o"), i.alias("id")))
    return F.slice(F.transform(F.array_sort(keyed), lambda k: k["id"]), 1, limit)


def distinct_n(texts: DataFrame, column: str, n: int = 2) -> DataFrame:
    """Distinct runs of n words over all runs. Runs are counted before they meet, so frequent ones cost nothing extra."""
    g = texts.select(F.explode(ngrams(words_of(column), n)).alias("g")).groupBy("g").agg(F.count("*").alias("c"))
    return g.agg(F.count("*").alias("distinct_grams"), F.coalesce(F.sum("c"), F.lit(0)).alias("grams")).withColumn("share", F.round(F.col("distinct_grams") / F.nullif(F.col("grams"), F.lit(0)), 6))


def copies(texts: DataFrame, key: str, others: DataFrame, other_key: str, column: str, n: int = 8) -> DataFrame:
    """key, other_key of all pairs that share a run of n words; runs meet by their text."""
    g = lambda x, k: x.select(k, F.explode(F.array_distinct(ngrams(words_of(column), n))).alias("g"))
    return g(texts, key).join(g(others, other_key), "g").select(key, other_key).distinct()


def first_problem(why: str, source: str, least: int = 25, most: int = 320, copied: int = 7) -> Column:
    """The first gate that a rationale fails: length, language, copy, formal; null if none."""
    text = F.trim(F.coalesce(why, F.lit("")))
    return (
        F.when(~F.length(text).between(least, most), "length")
        .when(~is_turkish(text), "language")
        .when(shares_ngram(text, source, copied), "copy")
        .when(marks(text, FORMAL) > 0, "formal")
    )

"""Requests and training samples: label names, rendering, decoding, derived stages, caches, draws."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.scalars import unit
from lectern.functions.text import join_and
from lectern.operators import labels

# Names of genres, moods, eras, lengths and audiences by slug.
GENRE_NAMES = {
    "roman": "Roman", "klasik": "Klasik", "bilim-kurgu": "Bilim Kurgu", "fantastik": "Fantastik", "distopya": "Distopya", "polisiye": "Polisiye",
    "gerilim": "Gerilim", "korku": "Korku", "macera": "Macera", "romantik": "Romantik", "tarihi-kurgu": "Tarihî Kurgu", "genc-yetiskin": "Genç Yetişkin",
    "cocuk": "Çocuk", "cizgi-roman": "Çizgi Roman", "siir": "Şiir", "tiyatro": "Tiyatro", "deneme": "Deneme", "felsefe": "Felsefe", "psikoloji": "Psikoloji",
    "kisisel-gelisim": "Kişisel Gelişim", "tarih": "Tarih", "biyografi": "Biyografi", "bilim": "Bilim", "teknoloji": "Teknoloji", "is-ekonomi": "İş ve Ekonomi",
    "politika": "Politika", "din-maneviyat": "Din ve Maneviyat", "sanat": "Sanat", "gezi": "Gezi", "yemek": "Yemek", "mizah": "Mizah", "saglik": "Sağlık",
}
MOOD_NAMES = {
    "heyecanli": "Heyecan Verici", "dusundurucu": "Düşündürücü", "karanlik": "Karanlık", "romantik": "Romantik", "komik": "Komik", "sakinlestirici": "Sakinleştirici",
    "ilham-verici": "İlham Verici", "melankolik": "Melankolik", "gerilimli": "Gerilimli", "sicak": "Sıcak ve Samimi", "epik": "Epik", "gizemli": "Gizemli",
    "umutlu": "Umut Veren", "maceraci": "Maceracı",
}
ERA_NAMES = {"klasik": "Klasik (1900 öncesi)", "modern": "Modern (1900-1989)", "cagdas": "Çağdaş (1990 ve sonrası)"}
LENGTH_NAMES = {"kisa": "Kısa (200 sayfaya kadar)", "orta": "Orta (200-400 sayfa)", "uzun": "Uzun (400-700 sayfa)", "tugla": "Tuğla (700+ sayfa)"}
AUDIENCE_NAMES = {"cocuk": "Çocuk", "genc": "Genç", "yetiskin": "Yetişkin"}


def names_of(slugs: Column | str, table: dict[str, str]) -> Column:
    """Names of slugs in order, joined by commas; unknown slugs are left out."""
    m = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.array_join(F.array_compact(F.transform(slugs, lambda s: F.try_element_at(m, s))), ", ")


def name_of(slug: Column, table: dict[str, str]) -> Column:
    """Name of a slug; an unknown one stands for itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), slug), slug)


def request_block(query: Column, genres: Column, moods: Column, era: Column, length: Column, audience: Column, languages: Column, limit: Column, exclude: Column | None = None) -> Column:
    """A request as it stands in a prompt: the reader's words, filters that are set, titles already read, number of answers."""
    none = F.array().cast("array<string>")
    some = lambda c: F.size(F.coalesce(c, none)) > 0
    filters = F.array_compact(F.array(
        F.when(some(genres), F.concat(F.lit("tür: "), names_of(genres, GENRE_NAMES))),
        F.when(some(moods), F.concat(F.lit("ruh hali: "), names_of(moods, MOOD_NAMES))),
        F.when(F.length(era) > 0, F.concat(F.lit("dönem: "), name_of(era, ERA_NAMES))),
        F.when(F.length(length) > 0, F.concat(F.lit("uzunluk: "), name_of(length, LENGTH_NAMES))),
        F.when(F.length(audience) > 0, F.concat(F.lit("okur: "), name_of(audience, AUDIENCE_NAMES))),
        F.when(some(languages), F.concat(F.lit("dil: "), F.array_join(languages, ", "))),
    ))
    exclude = none if exclude is None else exclude
    lines = F.array_compact(F.array(
        F.concat(F.lit("Okurun sözleri: "), F.when(F.length(query) > 0, query).otherwise("(belirtmedi)")),
        F.when(F.size(filters) > 0, F.concat(F.lit("Filtreler: "), F.array_join(filters, " | "))),
        F.when(some(exclude), F.concat(F.lit("Zaten okudu: "), join_and(F.slice(exclude, 1, 5)))),
        F.concat(F.lit("İstenen öneri sayısı: "), limit.cast("string")),
    ))
    return F.array_join(lines, "\n")


def strength(score: Column) -> Column:
    """A score as a word; a missing one counts as middling."""
    c = F.coalesce(score, F.lit(0.5))
    return F.when(c >= 0.75, "güçlü").when(c >= 0.5, "orta").otherwise("zayıf")


def write_lines(picks: Column | str) -> Column:
    """picks(id, why) as lines 'id: why' with single blanks."""
    one = lambda p: F.concat(p["id"], F.lit(": "), F.trim(F.regexp_replace(F.coalesce(p["why"], F.lit("")), r"\s+", " ")))
    return F.array_join(F.transform(picks, one), "\n")


_LINE = r"^\s*[-*]?\s*\**(a\d+)\**\s*[:：]\s*(\S.*?)\s*$"


def read_lines(text: Column | str) -> Column:
    """Texts by id of an answer in lines 'a1: text'; of a repeated id the first line counts, other lines are ignored."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: x.rlike(_LINE))
    found = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, _LINE, 1).alias("id"), F.regexp_extract(x, _LINE, 2).alias("why")))
    ids = F.array_distinct(F.transform(found, lambda x: x["id"]))
    return F.transform(ids, lambda i: F.struct(i.alias("id"), F.get(F.filter(found, lambda x: x["id"] == i), F.lit(0))["why"].alias("why")))


def confidence(value: Column) -> Column:
    """A confidence between 0 and 1; what is no number counts as 0.6."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(value.try_cast("double"), F.lit(0.6))))


def passage(prefix: str = "") -> Column:
    """A book's text for a vector model: title, authors, twelve subjects and 400 characters of its description."""
    none = F.array().cast("array<string>")
    parts = [F.coalesce("title", F.lit("")), F.array_join(F.coalesce("authors", none), ", "), F.array_join(F.slice(F.coalesce("subjects", none), 1, 12), ", "), F.substring(F.coalesce("description", F.lit("")), 1, 400)]
    return F.concat(F.lit(prefix), F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " | "))


def label_keywords(most: int = 4) -> list[tuple[str, str, int, str]]:
    """kind, slug, position, keyword: the plain words that a label's patterns begin with."""
    out = []
    for kind, table in (("genre", labels.GENRES), ("mood", labels.MOODS)):
        for x in table:
            heads = [m.group(1) for p in x.patterns if (m := re.match(r"(?:\\b)?([a-z][a-z '-]*[a-z])", p))]
            out += [(kind, x.slug, i, h) for i, h in enumerate(heads[:most])]
    return out


def taxonomy(spark: SparkSession) -> DataFrame:
    """kind, position, slug, name of all labels."""
    kinds = (("genre", GENRE_NAMES), ("mood", MOOD_NAMES), ("era", ERA_NAMES), ("length", LENGTH_NAMES), ("audience", AUDIENCE_NAMES))
    return spark.createDataFrame([(k, i, s, n) for k, t in kinds for i, (s, n) in enumerate(t.items())], "kind string, position int, slug string, name string")


def work_key(key: Column) -> Column:
    """A key with its prefix, whether it was given with it or not."""
    return F.when(key.startswith("/works/"), key).otherwise(F.concat(F.lit("/works/"), F.ltrim(key, F.lit("/"))))


def looked_up(items: DataFrame, keys: DataFrame) -> DataFrame:
    """Items of keys(asked), whose prefix may be missing; unknown keys give no row."""
    return keys.select("asked", work_key(F.col("asked")).alias("work_key")).join(items, "work_key")


def weighted_with_replacement(items: DataFrame, draws: int, weight: Column, seed: int, key: str) -> DataFrame:
    """draw, key: draws independent rows, each with probability in proportion to weight.

    Every draw takes the row with the least exponential key, so partial minima meet and
    no row order or running total is needed. Rows of no weight are never drawn.
    """
    x = items.filter(weight > 0).select(F.col(key), weight.alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    u = (unit(F.concat(F.col("draw").cast("string"), F.lit("/"), F.col(key).cast("string")), seed) * 4294967296.0 + 0.5) / 4294967296.0
    best = x.withColumn("_k", F.round(-F.ln(u) / F.col("_w"), 9)).groupBy("draw").agg(F.min(F.struct("_k", key)).alias("m"))
    return best.select("draw", f"m.{key}")


def smallest_bucket(items: DataFrame, groups: list[tuple[str, Column]], n: int, seed: int, key: str = "work_key") -> DataFrame:
    """bucket and n rows, by seeded hash order, of the smallest of the groups that hold rows at all.

    groups: name and condition; a row is counted for each in one pass. Ties go to the first.
    """
    counts = items.agg(*[F.count_if(c).alias(f"c{i}") for i, (_, c) in enumerate(groups)]).first()
    some = [(counts[i], i) for i in range(len(groups)) if counts[i]]
    if not some:
        return items.limit(0).select(F.lit("").alias("bucket"), key)
    name, cond = groups[min(some)[1]]
    return items.filter(cond).select(F.lit(name).alias("bucket"), key).orderBy(unit(key, seed), key).limit(n)


def without_copies(samples: DataFrame, key: str, fingerprint: Column) -> DataFrame:
    """The row with the least key of each fingerprint; fingerprints meet as partial minima."""
    return samples.groupBy(fingerprint.alias("fingerprint")).agg(F.min(key).alias(key))


def pending(rows: DataFrame, key: str, done: DataFrame) -> DataFrame:
    """Rows whose key isn't done yet, in a resumed or cached job."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def common_of_models(predictions: DataFrame, ratings: DataFrame, key: str = "i", model: str = "model") -> DataFrame:
    """Predictions(model, i, ...) with ratings(i, ...), of those indices that all models predicted."""
    models = predictions.select(model).distinct().count()
    common = predictions.groupBy(key).agg(F.count_distinct(model).alias("_n")).filter(F.col("_n") == models).select(key)
    return predictions.join(common, key, "left_semi").join(ratings, key)

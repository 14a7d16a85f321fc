"""Building the catalog: logs, authors and editions reduced to works, then one wide table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.scalars import ERAS, LENGTHS, MACHINE_SUBJECT, bucket, int_of, joined_once, rounded_mean, signal, year_of
from lectern.operators import labels

LANGUAGES = ("tur", "eng", "ger", "fre")
_EDITION = (
    "works array<struct<key:string>>, number_of_pages string, languages array<struct<key:string>>, isbn_13 array<string>, isbn_10 array<string>, "
    "covers array<string>, publish_date string, title string, authors array<struct<key:string>>"
)


def rating_stats(ratings: DataFrame) -> DataFrame:
    """work_key, rating_count, rating_avg of valid ratings (1 to 5) of keys under /works/."""
    ok = F.col("work_key").startswith("/works/") & int_of("rating_value").between(1, 5)
    return ratings.filter(ok).groupBy("work_key").agg(F.count("*").alias("rating_count"), F.round(F.avg(F.col("rating_value").try_cast("double")), 3).alias("rating_avg"))


def reader_stats(log: DataFrame) -> DataFrame:
    """work_key, readers, finished, want_to_read."""
    return (
        log.filter(F.col("work_key").startswith("/works/"))
        .groupBy("work_key")
        .agg(F.count("*").alias("readers"), F.count_if(F.col("shelf") == "3").alias("finished"), F.count_if(F.col("shelf") == "1").alias("want_to_read"))
    )


def signal_keys(ratings: DataFrame, readers: DataFrame, min_ratings: int = 0, min_readers: int = 0) -> DataFrame:
    """Distinct keys with more ratings or more readers than asked for."""
    a = ratings.filter(F.col("rating_count") > min_ratings).select("work_key")
    return a.union(readers.filter(F.col("readers") > min_readers).select("work_key")).distinct()


def author_names(lines: DataFrame) -> DataFrame:
    """author_key, name of readable author lines; the personal name where there is no name; blank names are left out."""
    x = F.from_json("js", "name string, personal_name string")
    name = F.coalesce(x["name"], x["personal_name"])
    return lines.filter(F.col("rec_type") == "/type/author").select("author_key", name.alias("name")).filter(F.length(F.trim("name")) > 0)


def edition_facts(lines: DataFrame) -> DataFrame:
    """One row per edition line: its work and what the catalog takes from it."""
    x = lines.filter(F.col("rec_type") == "/type/edition").withColumn("x", F.from_json("js", _EDITION))
    none = F.array().cast("array<string>")
    langs = F.array_compact(F.transform(F.coalesce("x.languages", F.array().cast("array<struct<key:string>>")), lambda v: F.replace(v["key"], F.lit("/languages/"), F.lit(""))))
    return x.select(
        "edition_key",
        F.get("x.works", F.lit(0))["key"].alias("work_key"),
        int_of("x.number_of_pages").alias("pages"),
        langs.alias("langs"),
        F.concat(F.coalesce("x.isbn_13", none), F.coalesce("x.isbn_10", none)).alias("isbns"),
        F.get("x.covers", F.lit(0)).try_cast("int").alias("cover"),
        year_of(F.col("x.publish_date")).alias("year"),
        F.trim(F.coalesce("x.title", F.lit(""))).alias("title"),
        F.array_compact(F.transform("x.authors", lambda a: a["key"])).alias("author_keys"),
    )


def _fullest(where: Column) -> Column:
    """ISBNs of the edition with most pages among those that hold; the smaller edition key decides ties."""
    order = F.struct(F.coalesce("pages", F.lit(0)).alias("p"), F.col("order_key"), F.array_join("isbns", ",").alias("i"))
    return F.max_by(F.when(where, F.col("isbns")), F.when(where, order))


def edition_rollup(facts: DataFrame, keep: DataFrame, max_isbns: int = 8) -> DataFrame:
    """Editions reduced to the works in keep (semi-join first, so that only their editions are aggregated)."""
    e = facts.filter(F.col("work_key").isNotNull()).join(keep.select("work_key"), "work_key", "left_semi")
    # Ascending keys, descending preference: the complement of the key's code sorts the smaller key last.
    e = e.withColumn("order_key", F.negate(F.conv(F.regexp_extract("edition_key", r"(\d+)", 1), 10, 10).try_cast("bigint")))
    has = F.size("isbns") > 0
    flag = lambda code: F.when(F.bool_or(F.array_contains("langs", code)), code)
    return e.groupBy("work_key").agg(
        F.count("*").alias("edition_count"),
        rounded_mean(F.when(F.col("pages").between(10, 5000), F.col("pages"))).alias("pages"),
        F.min("year").alias("earliest_edition_year"),
        F.array_compact(F.array(*[flag(c) for c in LANGUAGES])).alias("languages"),
        F.slice(joined_once(_fullest(has), _fullest(has & F.array_contains("langs", "tur")), _fullest(has & F.array_contains("langs", "eng"))), 1, max_isbns).alias("isbns"),
        F.max("cover").alias("edition_cover"),
        F.min(F.when(F.array_contains("langs", "tur") & (F.length("title") > 1), F.col("title"))).alias("title_tr"),
    )


def ordered_names(keys: DataFrame, key: str, list_col: str, names: DataFrame) -> DataFrame:
    """key, authors: the names behind a list of keys, in the list's order; unknown keys are dropped."""
    x = keys.select(key, F.posexplode(list_col).alias("at", "author_key")).join(names, "author_key")
    lists = x.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("x"))
    return lists.select(key, F.transform("x", lambda v: v["name"]).alias("authors"))


def usable(works: DataFrame, min_title: int = 2) -> DataFrame:
    """Works with a title and with subjects or a description."""
    return works.filter((F.length(F.trim(F.coalesce("title", F.lit("")))) >= min_title) & ((F.size(F.coalesce("subjects", F.array().cast("array<string>"))) > 0) | F.col("description").isNotNull()))


def clean_subjects(subjects: Column | str, limit: int = 24) -> Column:
    """Subjects once each, without those that catalogs add for themselves."""
    return F.slice(F.filter(joined_once(F.col(subjects) if isinstance(subjects, str) else subjects), lambda s: ~F.lower(s).rlike(MACHINE_SUBJECT)), 1, limit)


def newest(books: DataFrame) -> DataFrame:
    """The newest snapshot of each work."""
    rest = [c for c in books.columns if c != "work_key"]
    one = books.filter(F.col("work_key").isNotNull()).groupBy("work_key").agg(F.max_by(F.struct(*rest), F.struct("snapshot_at", "rating_count", "readers", "finished")).alias("x"))
    return one.select("work_key", "x.*")


def assemble(works: DataFrame, ratings: DataFrame, readers: DataFrame, editions: DataFrame) -> DataFrame:
    """Works joined with their statistics; missing counts are 0, missing lists empty, pages of 0 null."""
    none = F.array().cast("array<string>")
    wide = works.join(ratings, "work_key", "left").join(readers, "work_key", "left").join(editions, "work_key", "left")
    return wide.select(
        *[F.col(c) for c in works.columns],
        F.nullif(F.coalesce(editions["pages"], F.lit(0)), F.lit(0)).alias("edition_pages"),
        F.coalesce(editions["languages"], none).alias("edition_languages"),
        F.coalesce(editions["isbns"], none).alias("edition_isbns"),
        editions["earliest_edition_year"],
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("edition_count", "rating_count", "readers", "finished")],
        ratings["rating_avg"],
    )


def search_text() -> Column:
    """All text of a book, lower-cased."""
    return F.lower(F.concat_ws(" | ", F.coalesce("title", F.lit("")), F.coalesce("subtitle", F.lit("")), F.coalesce(F.array_join("authors", ", "), F.lit("")), F.coalesce(F.array_join("subjects", " | "), F.lit("")), F.coalesce("description", F.lit(""))))


def labelled(books: DataFrame) -> DataFrame:
    """Adds genres, moods, era, length and audience labels (suffix _label) to books."""
    none = F.array().cast("array<string>")
    b = books.withColumn("subject_text", F.lower(F.array_join(F.coalesce("subjects", none), " | "))).withColumn("search_text", search_text())
    b = b.withColumn("genre_label", labels.genres("subject_text")).withColumn("direct_moods", labels.direct_moods("search_text"))
    return b.withColumns({
        "mood_label": labels.moods("direct_moods", "genre_label"),
        "era_label": bucket("first_published", ERAS),
        "length_label": bucket("pages", LENGTHS, positive=True),
        "audience_label": labels.audience("genre_label", "search_text"),
    }).drop("subject_text", "search_text", "direct_moods")


def with_popularity(books: DataFrame) -> DataFrame:
    """signal and popularity (signal over the largest one); the largest is one row, so no shuffle of books."""
    s = books.withColumn("signal", signal(F.col("rating_count"), F.col("readers"), F.col("edition_count")))
    top = s.agg(F.max("signal")).first()[0] or 1.0
    return s.withColumn("popularity", F.col("signal") / F.lit(top))

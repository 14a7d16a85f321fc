"""Queries on building and labelling the catalog, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.scalars import ERAS, LENGTHS, MACHINE_SUBJECT, YEAR, bucket, joined_once, signal, year_of
from lectern.operators import catalog, labels
from lectern.plans.registry import Registry
from lectern.tables import table

R = Registry()
#: The newest snapshot of each work, in SQL.
NEWEST = "nb AS (SELECT * FROM books WHERE work_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY work_key ORDER BY snapshot_at DESC, rating_count DESC, readers DESC, finished DESC) = 1)"
_RATINGS = "r AS (SELECT work_key, count(*) AS rating_count, round(avg(try_cast(rating_value AS DOUBLE)), 3) AS rating_avg FROM ratings WHERE work_key LIKE '/works/%' AND try_cast(rating_value AS INTEGER) BETWEEN 1 AND 5 GROUP BY 1)"
_READERS = "rd AS (SELECT work_key, count(*) AS readers, count(*) FILTER (WHERE shelf = '3') AS finished, count(*) FILTER (WHERE shelf = '1') AS want_to_read FROM reading_log WHERE work_key LIKE '/works/%' GROUP BY 1)"
_FACTS = f"""ok AS (SELECT edition_key, CASE WHEN json_valid(js) THEN js END AS j FROM editions WHERE rec_type = '/type/edition'),
e AS (SELECT edition_key, json_extract_string(j, '$.works[0].key') AS work_key,
  try_cast(json_extract_string(j, '$.number_of_pages') AS INTEGER) AS pages,
  list_filter(list_transform(coalesce(json_extract_string(j, '$.languages[*].key'), []::VARCHAR[]), lambda x: replace(x, '/languages/', '')), lambda x: x IS NOT NULL) AS langs,
  list_concat(coalesce(try_cast(json_extract(j, '$.isbn_13') AS VARCHAR[]), []::VARCHAR[]), coalesce(try_cast(json_extract(j, '$.isbn_10') AS VARCHAR[]), []::VARCHAR[])) AS isbns,
  try_cast(json_extract_string(j, '$.covers[0]') AS INTEGER) AS cover,
  try_cast(nullif(regexp_extract(coalesce(json_extract_string(j, '$.publish_date'), ''), '{YEAR}'), '') AS INTEGER) AS year,
  trim(coalesce(json_extract_string(j, '$.title'), '')) AS title,
  list_filter(coalesce(json_extract_string(j, '$.authors[*].key'), []::VARCHAR[]), lambda x: x IS NOT NULL) AS author_keys,
  -try_cast(regexp_extract(edition_key, '(\\d+)', 1) AS BIGINT) AS order_key
  FROM ok)"""
_PICK = "arg_max(isbns, struct_pack(p := coalesce(pages, 0), o := order_key, i := array_to_string(isbns, ','))) FILTER (WHERE len(isbns) > 0{})"
_ROLLUP = f"""ed AS (SELECT work_key, count(*) AS edition_count,
  cast(avg(pages) FILTER (WHERE pages BETWEEN 10 AND 5000) AS INTEGER) AS pages, min(year) AS earliest_edition_year,
  list_filter([CASE WHEN bool_or(list_contains(langs, 'tur')) THEN 'tur' END, CASE WHEN bool_or(list_contains(langs, 'eng')) THEN 'eng' END,
    CASE WHEN bool_or(list_contains(langs, 'ger')) THEN 'ger' END, CASE WHEN bool_or(list_contains(langs, 'fre')) THEN 'fre' END], lambda x: x IS NOT NULL) AS languages,
  list_concat(coalesce({_PICK.format('')}, []::VARCHAR[]), coalesce({_PICK.format(" AND list_contains(langs, 'tur')")}, []::VARCHAR[]), coalesce({_PICK.format(" AND list_contains(langs, 'eng')")}, []::VARCHAR[])) AS all_isbns,
  max(cover) AS edition_cover, min(title) FILTER (WHERE list_contains(langs, 'tur') AND length(title) > 1) AS title_tr
  FROM e WHERE work_key IN (SELECT work_key FROM nb) GROUP BY 1)"""
_ISBNS = "list_filter(all_isbns, lambda x, i: list_position(all_isbns, x) = i)[1:8]"


@R.query("rating_agg", f"WITH {_RATINGS} SELECT * FROM r")
def rating_agg(s: SparkSession, d: str) -> DataFrame:
    return catalog.rating_stats(table(s, d, "ratings"))


@R.query("reader_counts", f"WITH {_READERS} SELECT * FROM rd")
def reader_counts(s: SparkSession, d: str) -> DataFrame:
    return catalog.reader_stats(table(s, d, "reading_log"))


@R.query("signal_keys", f"WITH {_RATINGS}, {_READERS} SELECT work_key FROM r WHERE rating_count > 2 UNION SELECT work_key FROM rd WHERE readers > 10")
def signal_keys(s: SparkSession, d: str) -> DataFrame:
    return catalog.signal_keys(rating_agg(s, d), reader_counts(s, d), 2, 10)


@R.query("signal_semi_join", f"WITH {_RATINGS}, {_READERS}, {NEWEST} SELECT work_key, title FROM nb WHERE length(trim(coalesce(title, ''))) >= 2 AND (len(coalesce(subjects, [])) > 0 OR description IS NOT NULL) AND work_key IN (SELECT work_key FROM r UNION SELECT work_key FROM rd)")
def signal_semi_join(s: SparkSession, d: str) -> DataFrame:
    keys = catalog.signal_keys(rating_agg(s, d), reader_counts(s, d))
    return catalog.usable(catalog.newest(table(s, d, "books"))).join(keys, "work_key", "left_semi").select("work_key", "title")


@R.query("author_names", "WITH ok AS (SELECT author_key, CASE WHEN json_valid(js) THEN js END AS j FROM authors WHERE rec_type = '/type/author') SELECT author_key, coalesce(json_extract_string(j, '$.name'), json_extract_string(j, '$.personal_name')) AS name FROM ok WHERE length(trim(coalesce(json_extract_string(j, '$.name'), json_extract_string(j, '$.personal_name')))) > 0")
def author_names(s: SparkSession, d: str) -> DataFrame:
    return catalog.author_names(table(s, d, "authors"))


@R.query("edition_facts", f"WITH {_FACTS} SELECT edition_key, work_key, pages, array_to_string(langs, ',') AS langs, array_to_string(isbns, ',') AS isbns, cover, year, title FROM e")
def edition_facts(s: SparkSession, d: str) -> DataFrame:
    x = catalog.edition_facts(table(s, d, "editions"))
    return x.withColumns({"langs": F.array_join("langs", ","), "isbns": F.array_join("isbns", ",")}).drop("author_keys")


def _rollup(s: SparkSession, d: str) -> DataFrame:
    return catalog.edition_rollup(catalog.edition_facts(table(s, d, "editions")), catalog.newest(table(s, d, "books")))


@R.query("edition_rollup", f"WITH {NEWEST}, {_FACTS}, {_ROLLUP} SELECT work_key, edition_count, pages, earliest_edition_year, array_to_string(languages, ',') AS languages, array_to_string({_ISBNS}, ',') AS isbns, edition_cover, title_tr FROM ed")
def edition_rollup(s: SparkSession, d: str) -> DataFrame:
    return _rollup(s, d).withColumns({"languages": F.array_join("languages", ","), "isbns": F.array_join("isbns", ",")})


_ASSEMBLED = f"""WITH {NEWEST}, {_RATINGS}, {_READERS}, {_FACTS}, {_ROLLUP}
SELECT nb.work_key, nb.title, nullif(coalesce(ed.pages, 0), 0) AS edition_pages, array_to_string(coalesce(ed.languages, []), ',') AS edition_languages,
 coalesce(nb.first_published, ed.earliest_edition_year) AS year, coalesce(ed.edition_count, 0) AS edition_count, coalesce(r.rating_count, 0) AS rating_count,
 coalesce(rd.readers, 0) AS readers, coalesce(rd.finished, 0) AS finished, r.rating_avg,
 round(3 * ln(1 + coalesce(r.rating_count, 0)) + 2 * ln(1 + coalesce(rd.readers, 0)) + ln(1 + coalesce(ed.edition_count, 0)), 6) AS signal
FROM nb LEFT JOIN r USING (work_key) LEFT JOIN rd USING (work_key) LEFT JOIN ed USING (work_key)"""


@R.query("catalog_assembled", _ASSEMBLED)
def catalog_assembled(s: SparkSession, d: str) -> DataFrame:
    works = catalog.newest(table(s, d, "books")).select("work_key", "title", "first_published")
    x = catalog.assemble(works, rating_agg(s, d), reader_counts(s, d), _rollup(s, d))
    return x.select(
        "work_key", "title", "edition_pages", F.array_join("edition_languages", ",").alias("edition_languages"), F.coalesce("first_published", "earliest_edition_year").alias("year"),
        "edition_count", "rating_count", "readers", "finished", "rating_avg", F.round(signal(F.col("rating_count"), F.col("readers"), F.col("edition_count")), 6).alias("signal"),
    )


@R.query(
    "ordered_author_list",
    f"WITH {_FACTS}, one AS (SELECT author_key, min(coalesce(json_extract_string(j, '$.name'), json_extract_string(j, '$.personal_name'))) AS name FROM (SELECT author_key, CASE WHEN json_valid(js) THEN js END AS j FROM authors WHERE rec_type = '/type/author') GROUP BY 1), x AS (SELECT edition_key, unnest(author_keys) AS author_key, generate_subscripts(author_keys, 1) AS i FROM (SELECT edition_key, min(author_keys) AS author_keys FROM e WHERE len(author_keys) > 0 GROUP BY 1)) SELECT edition_key, string_agg(name, '; ' ORDER BY i) AS authors FROM x JOIN one USING (author_key) WHERE name IS NOT NULL GROUP BY 1",
)
def ordered_author_list(s: SparkSession, d: str) -> DataFrame:
    names = catalog.author_names(table(s, d, "authors")).groupBy("author_key").agg(F.min("name").alias("name"))
    e = catalog.edition_facts(table(s, d, "editions")).filter(F.size("author_keys") > 0).groupBy("edition_key").agg(F.min("author_keys").alias("author_keys"))
    return catalog.ordered_names(e, "edition_key", "author_keys", names).select("edition_key", F.array_join("authors", "; ").alias("authors"))


@R.query("popularity_signal", f"WITH {NEWEST}, x AS (SELECT work_key, 3 * ln(1 + rating_count) + 2 * ln(1 + readers) + ln(1 + edition_count) AS s FROM nb) SELECT work_key, round(s, 6) AS signal, round(s / (SELECT max(s) FROM x), 6) AS popularity FROM x")
def popularity_signal(s: SparkSession, d: str) -> DataFrame:
    x = catalog.with_popularity(catalog.newest(table(s, d, "books")))
    return x.select("work_key", F.round("signal", 6).alias("signal"), F.round("popularity", 6).alias("popularity"))


@R.query("coverage_stats", f"WITH {NEWEST} SELECT count(*) AS works, round(100.0 * count(*) FILTER (WHERE description IS NOT NULL) / count(*), 1) AS described, round(100.0 * count(*) FILTER (WHERE pages IS NOT NULL) / count(*), 1) AS paged, round(100.0 * count(*) FILTER (WHERE list_contains(languages, 'tur')) / count(*), 1) AS turkish, round(100.0 * count(*) FILTER (WHERE len(genres) > 0) / count(*), 1) AS with_genre, round(100.0 * count(*) FILTER (WHERE rating_count > 0) / count(*), 1) AS rated FROM nb")
def coverage_stats(s: SparkSession, d: str) -> DataFrame:
    share = lambda c, name: F.round(100.0 * F.count_if(c) / F.count("*"), 1).alias(name)
    return catalog.newest(table(s, d, "books")).agg(
        F.count("*").alias("works"), share(F.col("description").isNotNull(), "described"), share(F.col("pages").isNotNull(), "paged"),
        share(F.array_contains("languages", "tur"), "turkish"), share(F.size("genres") > 0, "with_genre"), share(F.col("rating_count") > 0, "rated"),
    )


@R.query("top_subjects", f"WITH {NEWEST} SELECT subject, count(*) AS n FROM (SELECT unnest(subjects) AS subject FROM nb) WHERE subject IS NOT NULL GROUP BY 1 ORDER BY n DESC, subject LIMIT 20")
def top_subjects(s: SparkSession, d: str) -> DataFrame:
    x = catalog.newest(table(s, d, "books")).select(F.explode("subjects").alias("subject")).filter(F.col("subject").isNotNull())
    return x.groupBy("subject").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subject").limit(20)


def _sql_any(patterns: tuple[str, ...]) -> str:
    return "'" + labels.any_pattern(patterns).replace("'", "''") + "'"


def _sql_labels(text: str, table_: tuple) -> str:
    cells = []
    for x in table_:
        veto = f" AND NOT regexp_matches({text}, {_sql_any(x.veto)})" if x.veto else ""
        cells.append(f"CASE WHEN regexp_matches({text}, {_sql_any(x.patterns)}){veto} THEN '{x.slug}' END")
    return f"list_filter([{', '.join(cells)}], lambda x: x IS NOT NULL)"


_PRIORS = "list_filter([" + ", ".join(f"CASE WHEN list_contains(g, '{x.slug}') THEN '{m}' END" for x in labels.GENRES for m in x.moods) + "], lambda x: x IS NOT NULL)"
_SEARCH = "lower(concat_ws(' | ', coalesce(title, ''), coalesce(subtitle, ''), coalesce(array_to_string(list_filter(authors, lambda x: x IS NOT NULL), ', '), ''), coalesce(array_to_string(list_filter(subjects, lambda x: x IS NOT NULL), ' | '), ''), coalesce(description, '')))"


def _sql_bucket(c: str, table_: tuple, positive: bool = False) -> str:
    arms = " ".join(f"WHEN {c} >= {low if low is not None else -99999999} AND {c} <= {high if high is not None else 99999999} THEN '{name}'" for name, low, high in table_)
    return f"CASE WHEN {c} IS NULL{f' OR {c} <= 0' if positive else ''} THEN NULL {arms} END"


@R.query(
    "genre_mood_labels",
    f"WITH {NEWEST}, t AS (SELECT *, lower(array_to_string(list_filter(coalesce(subjects, []), lambda x: x IS NOT NULL), ' | ')) AS st, {_SEARCH} AS search FROM nb), l AS (SELECT *, ({_sql_labels('st', labels.GENRES_BY_RANK)})[1:4] AS g, {_sql_labels('search', labels.MOODS)} AS direct FROM t), m AS (SELECT *, CASE WHEN len(direct) >= 2 THEN direct ELSE list_concat(direct, {_PRIORS}) END AS raw FROM l) "
    f"SELECT work_key, array_to_string(g, ',') AS genre_label, array_to_string((list_filter(raw, lambda x, i: list_position(raw, x) = i))[1:4], ',') AS mood_label, {_sql_bucket('first_published', ERAS)} AS era_label, {_sql_bucket('pages', LENGTHS, True)} AS length_label, CASE WHEN list_contains(g, 'cocuk') OR regexp_matches(search, '\\bjuvenile\\b|\\bchildren') THEN 'cocuk' WHEN list_contains(g, 'genc-yetiskin') OR contains(search, 'young adult') THEN 'genc' ELSE 'yetiskin' END AS audience_label FROM m",
)
def genre_mood_labels(s: SparkSession, d: str) -> DataFrame:
    x = catalog.labelled(catalog.newest(table(s, d, "books")))
    return x.select("work_key", F.array_join("genre_label", ",").alias("genre_label"), F.array_join("mood_label", ",").alias("mood_label"), "era_label", "length_label", "audience_label")


@R.query("label_histogram", f"WITH {NEWEST}, t AS (SELECT lower(array_to_string(list_filter(coalesce(subjects, []), lambda x: x IS NOT NULL), ' | ')) AS st FROM nb) SELECT label, count(*) AS n FROM (SELECT unnest(({_sql_labels('st', labels.GENRES_BY_RANK)})[1:4]) AS label FROM t) GROUP BY 1")
def label_histogram(s: SparkSession, d: str) -> DataFrame:
    x = catalog.newest(table(s, d, "books")).select(F.explode(labels.genres(F.lower(F.array_join(F.coalesce("subjects", F.array().cast("array<string>")), " | ")))).alias("label"))
    return x.groupBy("label").agg(F.count("*").alias("n"))


_FLAGS = "list_filter([" + ", ".join(f"CASE WHEN contains(t, '{k}') THEN '{v}' END" for k, v in labels.CONTENT_FLAGS.items()) + "], lambda x: x IS NOT NULL)"


@R.query("content_flags", f"WITH {NEWEST}, x AS (SELECT work_key, lower(array_to_string(list_filter(list_concat(coalesce(subjects, []), [coalesce(title, '')]), lambda x: x IS NOT NULL), ' | ')) AS t FROM nb), y AS (SELECT work_key, {_FLAGS} AS f FROM x) SELECT work_key, array_to_string((list_filter(f, lambda v, i: list_position(f, v) = i))[1:3], ',') AS flags FROM y WHERE len(f) > 0")
def content_flags(s: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    x = catalog.newest(table(s, d, "books")).select("work_key", labels.content_flags(F.concat(F.coalesce("subjects", none), F.array(F.coalesce("title", F.lit(""))))).alias("f"))
    return x.filter(F.size("f") > 0).select("work_key", F.array_join("f", ",").alias("flags"))


@R.query("era_length_buckets", f"SELECT era, length, count(*) AS n FROM (SELECT {_sql_bucket('first_published', ERAS)} AS era, {_sql_bucket('pages', LENGTHS, True)} AS length FROM books) GROUP BY 1, 2")
def era_length_buckets(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "books").groupBy(bucket("first_published", ERAS).alias("era"), bucket("pages", LENGTHS, positive=True).alias("length")).agg(F.count("*").alias("n"))


@R.query("clean_subjects", f"WITH {NEWEST}, x AS (SELECT work_key, list_filter(subjects, lambda x, i: x IS NOT NULL AND list_position(subjects, x) = i) AS u FROM nb) SELECT work_key, array_to_string((list_filter(u, lambda x: NOT regexp_matches(lower(x), '{MACHINE_SUBJECT}')))[1:24], ' | ') AS subjects FROM x WHERE u IS NOT NULL")
def clean_subjects(s: SparkSession, d: str) -> DataFrame:
    x = catalog.newest(table(s, d, "books")).filter(F.col("subjects").isNotNull())
    return x.select("work_key", F.array_join(catalog.clean_subjects(F.array_compact("subjects")), " | ").alias("subjects"))


@R.query("array_dedup_slice", f"WITH {NEWEST}, x AS (SELECT work_key, list_concat(coalesce(languages, []), list_concat(coalesce(genres, []), coalesce(moods, []))) AS a FROM nb) SELECT work_key, array_to_string((list_filter(a, lambda v, i: v IS NOT NULL AND list_position(a, v) = i))[1:5], ',') AS tags FROM x")
def array_dedup_slice(s: SparkSession, d: str) -> DataFrame:
    x = catalog.newest(table(s, d, "books"))
    return x.select("work_key", F.array_join(F.slice(F.array_compact(joined_once(F.col("languages"), F.col("genres"), F.col("moods"))), 1, 5), ",").alias("tags"))


@R.query("year_extract", f"WITH ok AS (SELECT edition_key, CASE WHEN json_valid(js) THEN json_extract_string(js, '$.publish_date') END AS p FROM editions) SELECT edition_key, p AS publish_date, try_cast(nullif(regexp_extract(p, '{YEAR}'), '') AS INTEGER) AS year FROM ok WHERE p IS NOT NULL")
def year_extract(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "editions").select("edition_key", F.from_json("js", "publish_date string")["publish_date"].alias("publish_date")).filter(F.col("publish_date").isNotNull())
    return x.withColumn("year", year_of(F.col("publish_date")))


@R.query("json_extract_props", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_extract_props(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", F.from_json("props", "k string")["k"].try_cast("int").alias("k"))


@R.query("nation_revenue", "SELECT n_name, count(*) AS items, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def nation_revenue(s: SparkSession, d: str) -> DataFrame:
    """A chain of equi-joins with an aggregate; small sides are left to the optimizer's statistics."""
    x = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    x = x.join(table(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return x.groupBy("n_name").agg(F.count("*").alias("items"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@R.query("exclude_anti_join", f"WITH {NEWEST} SELECT work_key FROM nb WHERE work_key NOT IN (SELECT work_key FROM ratings WHERE work_key IS NOT NULL)")
def exclude_anti_join(s: SparkSession, d: str) -> DataFrame:
    return catalog.newest(table(s, d, "books")).select("work_key").join(table(s, d, "ratings").select("work_key"), "work_key", "left_anti")


@R.query("book_projection", f"WITH {NEWEST} SELECT work_key, coalesce(title_tr, title) AS shown_title, array_to_string(list_filter(subjects, lambda x: x IS NOT NULL)[1:12], '|') AS subjects, array_to_string(isbns[1:4], '|') AS isbns, CASE WHEN rating_count > 0 AND rating_avg IS NOT NULL THEN rating_avg END AS rating FROM nb WHERE coalesce(readers, 0) >= 15")
def book_projection(s: SparkSession, d: str) -> DataFrame:
    x = catalog.newest(table(s, d, "books")).filter(F.coalesce("readers", F.lit(0)) >= 15)
    return x.select("work_key", F.coalesce("title_tr", "title").alias("shown_title"), F.array_join(F.slice(F.array_compact("subjects"), 1, 12), "|").alias("subjects"), F.array_join(F.slice("isbns", 1, 4), "|").alias("isbns"), F.when((F.col("rating_count") > 0) & F.col("rating_avg").isNotNull(), F.col("rating_avg")).alias("rating"))


def theme_lookup(s: SparkSession, d: str) -> DataFrame:
    """Themes of subjects by a small settings dictionary."""
    entries = [("fiction", "kurgu"), ("history", "tarih"), ("magic", "büyü"), ("travel", "yolculuk"), ("society", "toplum"), ("winter", "kış"), ("garden", "bahçe")]
    dictionary = s.createDataFrame([(i, a, b) for i, (a, b) in enumerate(entries)], "position int, subject string, theme string")
    x = labels.themes(catalog.newest(table(s, d, "books")), "work_key", "subjects", dictionary)
    return x.select("work_key", F.array_join("themes", ",").alias("themes"))


R.query(
    "theme_lookup",
    f"""WITH {NEWEST}, d(position, subject, theme) AS (VALUES (0, 'fiction', 'kurgu'), (1, 'history', 'tarih'), (2, 'magic', 'büyü'), (3, 'travel', 'yolculuk'), (4, 'society', 'toplum'), (5, 'winter', 'kış'), (6, 'garden', 'bahçe')),
x AS (SELECT work_key, unnest(subjects) AS s, generate_subscripts(subjects, 1) AS i FROM nb), y AS (SELECT work_key, i, trim(lower(s)) AS s FROM x WHERE s IS NOT NULL),
z AS (SELECT work_key, i, theme, row_number() OVER (PARTITION BY work_key, i ORDER BY (y.s <> d.subject), position) AS rn FROM y JOIN d ON y.s = d.subject OR (length(d.subject) >= 6 AND contains(y.s, d.subject))),
w AS (SELECT work_key, theme, min(i) AS i FROM z WHERE rn = 1 GROUP BY 1, 2), v AS (SELECT *, row_number() OVER (PARTITION BY work_key ORDER BY i) AS k FROM w)
SELECT work_key, string_agg(theme, ',' ORDER BY i) AS themes FROM v WHERE k <= 6 GROUP BY 1""",
)(theme_lookup)

QUERIES, SQL = R.queries, R.sql

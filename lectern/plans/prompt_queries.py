"""Queries on requests, prompts and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.scalars import unit
from lectern.operators import prompts, sampling, search
from lectern.plans.catalog_queries import NEWEST
from lectern.plans.registry import Registry
from lectern.plans.search_queries import _IDS, _ROLE, _SAMPLES, _SCORE, TARGET, _books, _texts, _unit
from lectern.tables import table

R = Registry()
#: A small dictionary of request words.
ENTRIES = [
    prompts.Entry("deniz", "theme", "deniz", ("sea", "ocean")), prompts.Entry("köprü", "theme", "köprü", ("bridge",)), prompts.Entry("roman", "genre", "novel", ("fiction", "novel")),
    prompts.Entry("winter", "theme", "winter", ("winter",)), prompts.Entry("crime", "genre", "crime", ("detective", "crime")), prompts.Entry("sessiz", "mood", "calm", ("calm", "quiet")),
    prompts.Entry("karanlık", "mood", "dark", ("dark", "noir")),
]


def _hit(e: prompts.Entry) -> str:
    return f"regexp_matches(t, '(?:^|[\\s,.;:!?()\\-])\\Q{e.needle}\\E')"


def _found(kind: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_hit(e)} THEN '{e.slug}' END" for e in ENTRIES if e.kind == kind) + "], lambda x: x IS NOT NULL)"


_TERM_CASES = " ".join(f"WHEN x = '{e.slug}' THEN [{', '.join(repr(t) for t in e.terms)}]" for e in ENTRIES)


@R.query("expanded_requests", f"WITH a AS (SELECT sample_id, lower(translate(coalesce(meta.query_text, ''), 'âîûÂÎÛ', 'aiuAIU')) AS t FROM samples), b AS (SELECT sample_id, {_found('theme')} AS th, ({_found('genre')})[1:2] AS g, ({_found('mood')})[1:2] AS m FROM a), c AS (SELECT *, flatten(list_transform(list_concat(list_concat(th, g), m), lambda x: CASE {_TERM_CASES} END)) AS tt FROM b) SELECT sample_id, array_to_string(th, ',') AS themes, array_to_string(g, ',') AS genres, array_to_string(m, ',') AS moods, array_to_string((list_filter(tt, lambda x, i: list_position(tt, x) = i))[1:24], ',') AS terms FROM c")
def expanded_requests(s: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    x = table(s, d, "samples").select("sample_id", F.col("meta.query_text").alias("text"), none.alias("genres"), none.alias("moods"))
    x = prompts.expanded(x, ENTRIES)
    join = lambda c: F.array_join(c, ",")
    return x.select("sample_id", join("detected_themes").alias("themes"), join("detected_genres").alias("genres"), join("detected_moods").alias("moods"), join("terms").alias("terms"))


@R.query("prompt_blocks", f"WITH {_SAMPLES}, b AS (SELECT sample_id, list_distinct(list_filter(regexp_split_to_array(regexp_replace(prompt, '\\n(\\[a\\d+\\])', chr(1) || '\\1', 'g'), chr(1)), lambda p: regexp_matches(p, '^\\[a\\d+\\]'))) AS p FROM sz) SELECT sample_id, len(p) AS blocks, coalesce(list_sum(list_transform(p, lambda x: length(x))), 0)::BIGINT AS chars FROM b")
def prompt_blocks(s: SparkSession, d: str) -> DataFrame:
    x = _texts(s, d).select("sample_id", F.map_values(prompts.prompt_blocks("prompt")).alias("p"))
    return x.select("sample_id", F.size("p").cast("bigint").alias("blocks"), F.aggregate("p", F.lit(0).cast("bigint"), lambda a, b: a + F.length(b)).alias("chars"))


def rendered_candidates(s: SparkSession, d: str) -> DataFrame:
    """Numbered candidates of each era as they stand in a prompt."""
    books = _books(s, d)
    c = sampling.numbered_candidates(books.filter(F.col("era").isNotNull()), "era", "work_key", 29).select("work_key", "candidate_id")
    return books.join(c, "work_key").select("era", "candidate_id", prompts.rendered().alias("block"))


R.query("rendered_candidates")(rendered_candidates)


@R.query("parsed_ratings", f"WITH x AS (SELECT sample_id, list_distinct(regexp_extract_all({_ROLE.format('user')}, '(?m)^\\[(a\\d+)\\]', 1)) AS v FROM samples) SELECT sample_id, len(v) AS graded FROM x WHERE len(v) >= 2")
def parsed_ratings(s: SparkSession, d: str) -> DataFrame:
    """Ratings written by a judge for every candidate, with noise that must not count."""
    x = _texts(s, d).select("sample_id", F.array_distinct(T.candidate_ids("prompt")).alias("v"))
    grade = lambda i: F.floor(unit(i, 41) * 3).cast("int").cast("string")
    noise = F.lit('"zz": 1, "yy": true, ')
    answer = F.concat(F.lit('{"ratings": {'), noise, F.array_join(F.transform("v", lambda i: F.concat(F.lit('"'), i, F.lit('": '), grade(i))), ", "), F.lit("}}"))
    x = x.withColumn("r", prompts.ratings(answer, "v")).filter(F.col("r").isNotNull())
    return x.select("sample_id", F.size(F.map_keys("r")).cast("bigint").alias("graded"))


@R.query("write_score", f"WITH x AS (SELECT work_key, floor({_unit('work_key', 43)} * 3)::INT AS g, floor({_unit('work_key', 47)} * 3)::INT AS u FROM (SELECT DISTINCT work_key FROM books WHERE work_key IS NOT NULL)) SELECT count(*) AS items, round(avg(g), 6) AS grounded, round(avg((g = 0)::INT), 6) AS fabricated, round(avg(u), 6) AS useful FROM x")
def write_score(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "books").filter(F.col("work_key").isNotNull()).select("work_key").distinct()
    v = F.struct(F.floor(unit("work_key", 43) * 3).cast("int").alias("grounded"), F.floor(unit("work_key", 47) * 3).cast("int").alias("useful"))
    return prompts.write_score(x.select(F.create_map(F.lit("a1"), v).alias("ratings")))


@R.query("sample_answers", f"WITH {NEWEST}, x AS (SELECT era, work_key, round({_SCORE}, 6) AS score FROM nb WHERE era IS NOT NULL), y AS (SELECT *, row_number() OVER (PARTITION BY era ORDER BY score DESC, work_key) AS k FROM x) SELECT era, '{{\"picks\":[' || string_agg('{{\"id\":\"a' || k || '\",\"confidence\":' || round(least(0.97, greatest(0.3, score)), 2)::DOUBLE || '}}', ',' ORDER BY k) || ']}}' AS answer FROM y WHERE k <= 3 GROUP BY 1")
def sample_answers(s: SparkSession, d: str) -> DataFrame:
    x = _books(s, d).filter(F.col("era").isNotNull()).select("era", "work_key", F.round(search.match_score(TARGET), 6).alias("score"))
    best = _top3(x)
    picks = F.transform("b", lambda v: F.struct(F.concat(F.lit("a"), v["k"].cast("string")).alias("id"), v["score"].alias("score")))
    return best.select("era", prompts.sample_answer(picks).alias("answer"))


def _top3(x: DataFrame) -> DataFrame:
    """The best three of each group, cut by rank before they are gathered."""
    w = Window.partitionBy("era").orderBy(F.desc("score"), "work_key")
    y = x.withColumn("k", F.row_number().over(w)).filter("k <= 3")
    return y.groupBy("era").agg(F.array_sort(F.collect_list(F.struct("k", "score"))).alias("b"))


@R.query("token_usage", "SELECT event_type, count(*) AS requests, sum(floor(value))::BIGINT AS prompt_tokens, sum(user_id)::BIGINT AS output_tokens, 0::BIGINT AS thought_tokens, round(sum(floor(value)) / count(*), 6) AS mean_prompt_tokens, round(sum(user_id) / count(*), 6) AS mean_output_tokens, 0.0::DOUBLE AS mean_thought_tokens FROM events GROUP BY 1")
def token_usage(s: SparkSession, d: str) -> DataFrame:
    """Usage sums, with the events table as the log."""
    log = table(s, d, "events").select("event_type", F.floor("value").alias("prompt_tokens"), F.col("user_id").alias("output_tokens"), F.lit(None).cast("bigint").alias("thought_tokens"))
    return prompts.usage(log, ["event_type"])


@R.query("common_records", "SELECT work_key FROM books WHERE work_key IS NOT NULL INTERSECT SELECT work_key FROM ratings INTERSECT SELECT work_key FROM reading_log")
def common_records(s: SparkSession, d: str) -> DataFrame:
    return prompts.common_records([table(s, d, t) for t in ("books", "ratings", "reading_log")], "work_key").filter(F.col("work_key").isNotNull())


@R.query("grounded_picks", f"WITH {_SAMPLES}, p AS (SELECT sample_id, unnest(list_concat(ids, ['a99'])) AS id, generate_subscripts(list_concat(ids, ['a99']), 1) AS place, list_filter(cand, lambda x, i: list_position(cand, x) = i) AS cand FROM sz), k AS (SELECT *, list_contains(cand, id) AS ok FROM p), n AS (SELECT sample_id, count(*) FILTER (WHERE NOT ok) AS dropped FROM k GROUP BY 1) SELECT sample_id, id, row_number() OVER (PARTITION BY sample_id ORDER BY place, id) AS rank, dropped FROM k JOIN n USING (sample_id) WHERE ok")
def grounded_picks(s: SparkSession, d: str) -> DataFrame:
    x = _texts(s, d)
    picks = x.select("sample_id", F.posexplode(F.concat(T.answer_ids("answer"), F.array(F.lit("a99")))).alias("place", "id"))
    cands = x.select("sample_id", F.explode(F.array_distinct(T.candidate_ids("prompt"))).alias("id"))
    return prompts.recommendations(picks, cands, "sample_id").select("sample_id", "id", "rank", "dropped")


@R.query("rewritten_picks", "WITH x AS (SELECT sample_id, " + _ROLE.format("assistant") + " AS answer FROM samples), y AS (SELECT sample_id, answer, " + _IDS + " AS ids FROM x) SELECT sample_id, array_to_string(list_transform(list_filter(json_extract_string(answer, '$.picks[*].id'), lambda i: i IS NOT NULL), lambda i: i || '=' || CASE WHEN i = 'a1' THEN 'new' ELSE 'old' END), ',') AS picks FROM y WHERE json_valid(answer) AND len(json_extract_string(answer, '$.picks[*].id')) > 0")
def rewritten_picks(s: SparkSession, d: str) -> DataFrame:
    """New texts for some picks by id, the others unchanged."""
    raw = F.from_json("answer", "picks array<struct<id:string>>")["picks"]
    x = _texts(s, d).select("sample_id", F.filter(raw, lambda p: p["id"].isNotNull()).alias("p")).filter(F.size("p") > 0)
    old = F.transform("p", lambda p: F.struct(p["id"].alias("id"), F.lit("old").alias("why")))
    new = prompts.rewritten(old, F.create_map(F.lit("a1"), F.lit("new")))
    return x.select("sample_id", F.array_join(F.transform(new, lambda p: F.concat(p["id"], F.lit("="), p["why"])), ",").alias("picks"))


QUERIES, SQL = R.queries, R.sql

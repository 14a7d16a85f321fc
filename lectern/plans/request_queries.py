"""Queries on requests, samples and derived training stages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.scalars import overlap, unit
from lectern.operators import prompts, requests, sampling, search
from lectern.plans.catalog_queries import NEWEST
from lectern.plans.registry import Registry
from lectern.plans.search_queries import _BM25, _COS, _GRADES, _INFO, _ROLE, _SCORE, _TERMS, _TOK, EVERY, QUERY, TARGET, _books, _graded, _sql_list, _texts, _unit
from lectern.tables import table

R = Registry()


def _none() -> F.Column:
    return F.array().cast("array<string>")


def _case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


ASKED = ["OL777W", "/works/OL777W", "/works/OL1W", "OL12W", "nothing"]


@R.query("book_lookup", f"WITH {NEWEST}, k AS (SELECT unnest({ASKED!r}) AS asked) SELECT asked, work_key, title FROM (SELECT asked, CASE WHEN asked LIKE '/works/%' THEN asked ELSE '/works/' || ltrim(asked, '/') END AS work_key FROM k) JOIN nb USING (work_key)")
def book_lookup(s: SparkSession, d: str) -> DataFrame:
    """Books by key, with or without its prefix."""
    return requests.looked_up(_books(s, d), s.createDataFrame([(k,) for k in ASKED], "asked string")).select("asked", "work_key", "title")


@R.query("dense_filtered_each", f"WITH da AS (SELECT a.vec_id AS query, b.vec_id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % {EVERY} = 0 AND b.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'tur')) SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS place FROM da QUALIFY place <= 10")
def dense_filtered_each(s: SparkSession, d: str) -> DataFrame:
    """Dense search among allowed rows only."""
    v = table(s, d, "embeddings")
    allowed = table(s, d, "documents").filter("lang = 'tur'").select(F.col("doc_id").alias("vec_id"))
    return search.dense_topk_each(v.join(allowed, "vec_id", "left_semi"), "vec_id", v.filter(F.col("vec_id") % EVERY == 0), 10)


@R.query("search_listing", f"WITH {_BM25}, h AS (SELECT doc_id, score FROM sc WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20), {NEWEST} SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS place, doc_id, score, nb.work_key, nb.title, nb.era FROM h JOIN documents USING (doc_id) LEFT JOIN nb ON nb.work_key = documents.work_key")
def search_listing(s: SparkSession, d: str) -> DataFrame:
    """Hits of a text search with what is shown of their works, in the order of their scores."""
    docs = table(s, d, "documents")
    hits = search.BM25().search(docs, "doc_id", T.search_terms("text"), QUERY, 20)
    hits = hits.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))  # at most 20 rows
    shown = _books(s, d).select("work_key", "title", "era")
    x = hits.join(docs.select("doc_id", F.col("work_key").alias("w")), "doc_id").join(shown, F.col("w") == F.col("work_key"), "left")
    return x.select("place", "doc_id", "score", "work_key", "title", "era")


@R.query("bm25_each", f"WITH {_TOK}, st AS (SELECT count(*) AS n, greatest(avg(len(terms)), 1) AS avgdl FROM tok), q AS (SELECT item_id AS query, unnest(list_distinct({_TERMS})) AS term FROM eval_items WHERE item_id % {EVERY} = 0), p AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), sc AS (SELECT query, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN df USING (term) JOIN p USING (term), st GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS place FROM sc WHERE score > 0 QUALIFY place <= 10")
def bm25_each(s: SparkSession, d: str) -> DataFrame:
    """Texts nearest to every hundredth evaluation text, over postings."""
    q = table(s, d, "eval_items").filter(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query"), T.search_terms("text").alias("terms"))
    return search.bm25_each(table(s, d, "documents"), "doc_id", T.search_terms("text"), q)


@R.query("dataset_stats", "WITH a AS (SELECT 'style' AS what, coalesce(meta.style, '') AS value, count(*) AS n FROM samples GROUP BY 2), b AS (SELECT 'task' AS what, task AS value, count(*) AS n FROM samples GROUP BY 2), c AS (SELECT 'picks' AS what, meta.n_picks::VARCHAR AS value, count(*) AS n FROM samples GROUP BY 2), u AS (SELECT 'keys' AS what, '' AS value, count(DISTINCT k) AS n FROM (SELECT unnest(meta.picked_keys) AS k FROM samples)) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM u")
def dataset_stats(s: SparkSession, d: str) -> DataFrame:
    """Histograms by style, task and number of picks, from one reading, and the number of distinct picked keys."""
    x = table(s, d, "samples")
    cells = F.array(*[F.struct(F.lit(k).alias("what"), v.alias("value")) for k, v in (("style", F.coalesce("meta.style", F.lit(""))), ("task", F.col("task")), ("picks", F.col("meta.n_picks").cast("string")))])
    h = x.select(F.explode(cells).alias("c")).groupBy("c.what", "c.value").agg(F.count("*").alias("n"))
    keys = x.select(F.explode("meta.picked_keys").alias("k")).agg(F.count_distinct("k").alias("n"))
    return h.unionByName(keys.select(F.lit("keys").alias("what"), F.lit("").alias("value"), "n"))


@R.query("query_mix", "SELECT meta.style AS style, split, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split), 6) AS percent FROM samples GROUP BY 1, 2")
def query_mix(s: SparkSession, d: str) -> DataFrame:
    """Requests by style with their share of each split."""
    g = table(s, d, "samples").groupBy(F.col("meta.style").alias("style"), "split").agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("split")), 6))  # over grouped rows only


@R.query("parsed_requests", f"SELECT sample_id, coalesce(nullif(regexp_extract(u, '(?m)^En çok (\\d+) öneri', 1), '')::INTEGER, 3) AS n_limit, len(regexp_extract_all(u, '(?m)^özet: (.+)$', 1)) AS summaries, coalesce(list_sum(list_transform(regexp_extract_all(u, '(?m)^özet: (.+)$', 1), lambda x: length(x))), 0)::BIGINT AS summary_chars FROM (SELECT sample_id, {_ROLE.format('user')} AS u FROM samples)")
def parsed_requests(s: SparkSession, d: str) -> DataFrame:
    """Limit (3 where none is given) and summaries of a rendered prompt."""
    one = F.regexp_extract_all("prompt", F.lit(r"(?m)^özet: (.+)$"), F.lit(1))
    x = _texts(s, d).select("sample_id", F.coalesce(F.regexp_extract("prompt", r"(?m)^En çok (\d+) öneri", 1).try_cast("int"), F.lit(3)).alias("n_limit"), one.alias("o"))
    return x.select("sample_id", "n_limit", F.size("o").cast("bigint").alias("summaries"), F.aggregate("o", F.lit(0).cast("bigint"), lambda a, b: a + F.length(b)).alias("summary_chars"))


_NAMED = "array_to_string(list_filter(list_transform(coalesce({0}, []), lambda x: {1}), lambda x: x IS NOT NULL), ', ')"


@R.query("request_block", f"""WITH {NEWEST}, f AS (SELECT work_key, title, era, length_bucket, audience, languages, {_NAMED.format('genres', _case('x', requests.GENRE_NAMES))} AS g, {_NAMED.format('moods', _case('x', requests.MOOD_NAMES))} AS m, genres, moods FROM nb),
l AS (SELECT *, array_to_string(list_filter([CASE WHEN len(coalesce(genres, [])) > 0 THEN 'tür: ' || g END, CASE WHEN len(coalesce(moods, [])) > 0 THEN 'ruh hali: ' || m END, CASE WHEN length(era) > 0 THEN 'dönem: ' || coalesce({_case('era', requests.ERA_NAMES)}, era) END, CASE WHEN length(length_bucket) > 0 THEN 'uzunluk: ' || coalesce({_case('length_bucket', requests.LENGTH_NAMES)}, length_bucket) END, CASE WHEN length(audience) > 0 THEN 'okur: ' || coalesce({_case('audience', requests.AUDIENCE_NAMES)}, audience) END, CASE WHEN len(coalesce(languages, [])) > 0 THEN 'dil: ' || array_to_string(languages, ', ') END], lambda x: x IS NOT NULL), ' | ') AS filters FROM f)
SELECT work_key, 'Okurun sözleri: ' || CASE WHEN length(title) > 0 THEN title ELSE '(belirtmedi)' END || CASE WHEN filters <> '' THEN chr(10) || 'Filtreler: ' || filters ELSE '' END || chr(10) || 'İstenen öneri sayısı: 3' AS block FROM l""")
def request_block(s: SparkSession, d: str) -> DataFrame:
    """Requests in prompts, with a book's facts as what is asked for."""
    block = requests.request_block(F.col("title"), F.col("genres"), F.col("moods"), F.col("era"), F.col("length_bucket"), F.col("audience"), F.col("languages"), F.lit(3))
    return _books(s, d).select("work_key", block.alias("block"))


@R.query("match_strength", f"WITH {NEWEST}, x AS (SELECT work_key, round({_SCORE}, 6) AS score FROM nb) SELECT CASE WHEN score >= 0.75 THEN 'güçlü' WHEN score >= 0.5 THEN 'orta' ELSE 'zayıf' END AS strength, count(*) AS n FROM x GROUP BY 1")
def match_strength(s: SparkSession, d: str) -> DataFrame:
    x = _books(s, d).select(F.round(search.match_score(TARGET), 6).alias("score"))
    return x.groupBy(requests.strength(F.col("score")).alias("strength")).agg(F.count("*").alias("n"))


_PICKS = f"pk AS (SELECT sample_id, meta.query_text AS query_text, json_extract_string(a, '$.picks[*].id') AS ids, json_extract_string(a, '$.picks[*].why') AS whys, json_extract_string(a, '$.picks[*].confidence') AS confs FROM (SELECT sample_id, meta, {_ROLE.format('assistant')} AS a FROM samples WHERE task = 'grounded_recommend') WHERE json_valid(a) AND len(json_extract_string(a, '$.picks[*].id')) > 0)"
_WHY = "trim(regexp_replace(coalesce({}, ''), '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g'), ' ')"


def _picks(s: SparkSession, d: str) -> DataFrame:
    raw = F.from_json("answer", "picks array<struct<id:string,why:string,confidence:string>>")["picks"]
    return _texts(s, d).filter("task = 'grounded_recommend'").select("sample_id", "prompt", raw.alias("picks")).filter(F.size("picks") > 0)


@R.query("stage_write", f"WITH {_PICKS} SELECT sample_id, array_to_string(list_transform(range(1, len(ids) + 1), lambda i: ids[i] || ': ' || {_WHY.format('whys[i]')}), chr(10)) AS target FROM pk")
def stage_write(s: SparkSession, d: str) -> DataFrame:
    """Targets of the writing stage: one line a pick."""
    return _picks(s, d).select("sample_id", requests.write_lines("picks").alias("target"))


@R.query("decoded_lines", f"WITH {_PICKS}, t AS (SELECT sample_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos, unnest(whys) AS why FROM pk), u AS (SELECT sample_id, id, {_WHY.format('why')} AS why, row_number() OVER (PARTITION BY sample_id, id ORDER BY pos) AS k FROM t) SELECT sample_id, id, why FROM u WHERE k = 1 AND why <> ''")
def decoded_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of the writing stage read again: the first text of each id."""
    x = _picks(s, d).select("sample_id", requests.write_lines("picks").alias("target"))
    repeated = F.concat(F.lit("intro\n- **a0**: \n"), F.col("target"), F.lit("\n"), F.col("target"))
    return x.select("sample_id", F.inline(requests.read_lines(repeated)))


@R.query("clamped_confidence", f"WITH {_PICKS} SELECT sample_id, round(list_avg(list_transform(range(1, len(ids) + 1), lambda i: least(1.0, greatest(0.0, coalesce(try_cast(confs[i] AS DOUBLE), 0.6))))), 6) AS mean_confidence FROM pk")
def clamped_confidence(s: SparkSession, d: str) -> DataFrame:
    x = _picks(s, d).select("sample_id", F.transform("picks", lambda p: requests.confidence(p["confidence"])).alias("c"))
    return x.select("sample_id", F.round(F.aggregate("c", F.lit(0.0), lambda a, b: a + b) / F.size("c"), 6).alias("mean_confidence"))


@R.query("distil_prompts", f"WITH {_PICKS}, b AS (SELECT sample_id, list_filter(regexp_split_to_array(regexp_replace({_ROLE.format('user')}, '\\n(\\[a\\d+\\])', chr(1) || '\\1', 'g'), chr(1)), lambda p: regexp_matches(p, '^\\[a\\d+\\]')) AS p FROM samples), x AS (SELECT pk.sample_id, unnest(ids) AS id, unnest(confs) AS c, p FROM pk JOIN b USING (sample_id)), y AS (SELECT sample_id, id, least(1.0, greatest(0.0, coalesce(try_cast(c AS DOUBLE), 0.6))) AS c, list_filter(p, lambda q: starts_with(q, '[' || x.id || ']'))[1] AS block FROM x) SELECT sample_id, id, CASE WHEN c >= 0.75 THEN 'güçlü' WHEN c >= 0.5 THEN 'orta' ELSE 'zayıf' END AS strength, md5(block) AS h FROM y WHERE block IS NOT NULL")
def distil_prompts(s: SparkSession, d: str) -> DataFrame:
    """Blocks of the picked candidates only, each with the strength of its match in words."""
    x = _picks(s, d).select("sample_id", prompts.prompt_blocks("prompt").alias("b"), F.explode("picks").alias("p"))
    x = x.select("sample_id", F.col("p.id").alias("id"), requests.strength(requests.confidence(F.col("p.confidence"))).alias("strength"), F.try_element_at("b", F.col("p.id")).alias("block"))
    return x.filter(F.col("block").isNotNull()).select("sample_id", "id", "strength", F.md5("block").alias("h"))


@R.query("passages", f"WITH {NEWEST} SELECT work_key, md5('passage: ' || array_to_string(list_filter([coalesce(title, ''), array_to_string(list_filter(coalesce(authors, []), lambda x: x IS NOT NULL), ', '), array_to_string(list_filter(coalesce(subjects, [])[1:12], lambda x: x IS NOT NULL), ', '), substr(coalesce(description, ''), 1, 400)], lambda x: x <> ''), ' | ')) AS h FROM nb")
def passages(s: SparkSession, d: str) -> DataFrame:
    """Texts of books for a vector model."""
    return _books(s, d).select("work_key", F.md5(requests.passage("passage: ")).alias("h"))


_GL, _ML = _sql_list(TARGET.genres), _sql_list(TARGET.moods)


@R.query("smallest_bucket", f"WITH {NEWEST}, c AS (SELECT b, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN list_contains(genres, 'fantasy') THEN 'genre:fantasy' END, CASE WHEN list_contains(genres, 'crime') THEN 'genre:crime' END, CASE WHEN list_contains(moods, 'calm') THEN 'mood:calm' END, CASE WHEN list_contains(moods, 'dark') THEN 'mood:dark' END, CASE WHEN era = 'modern' THEN 'era:modern' END], lambda x: x IS NOT NULL)) AS b FROM nb) GROUP BY 1), m AS (SELECT b FROM c ORDER BY n, list_position(['genre:fantasy', 'genre:crime', 'mood:calm', 'mood:dark', 'era:modern'], b) LIMIT 1) SELECT b AS bucket, work_key FROM nb, m WHERE CASE b WHEN 'genre:fantasy' THEN list_contains(genres, 'fantasy') WHEN 'genre:crime' THEN list_contains(genres, 'crime') WHEN 'mood:calm' THEN list_contains(moods, 'calm') WHEN 'mood:dark' THEN list_contains(moods, 'dark') ELSE era = 'modern' END ORDER BY {_unit('work_key', 53)}, work_key LIMIT 160")
def smallest_bucket(s: SparkSession, d: str) -> DataFrame:
    """A sample of the smallest group of books that a request names."""
    has = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False))
    groups = [(f"genre:{g}", has("genres", g)) for g in TARGET.genres] + [(f"mood:{m}", has("moods", m)) for m in TARGET.moods] + [("era:modern", F.coalesce(F.col("era") == "modern", F.lit(False)))]
    return requests.smallest_bucket(_books(s, d), groups, 160, 53)


_DRAW = f"(-ln(({_unit(chr(39).join(['draw || ', '/', ' || work_key']), 59)} * 4294967296.0 + 0.5) / 4294967296.0) / power(coalesce(popularity, 0), 3))"


@R.query("anchor_draws", f"WITH {NEWEST}, x AS (SELECT range AS draw, work_key, round({_DRAW}, 9) AS k FROM range(20), nb WHERE popularity > 0) SELECT draw, work_key FROM x QUALIFY row_number() OVER (PARTITION BY draw ORDER BY k, work_key) = 1")
def anchor_draws(s: SparkSession, d: str) -> DataFrame:
    """Twenty draws with replacement, by the cube of popularity."""
    x = requests.weighted_with_replacement(_books(s, d), 20, F.pow(F.coalesce("popularity", F.lit(0.0)), 3), 59, "work_key")
    return x.select(F.col("draw").cast("bigint"), "work_key")


_PRINT = "md5(coalesce(meta.query_text, '') || chr(31) || array_to_string(list_sort(list_filter(coalesce(meta.picked_keys, []), lambda x: x IS NOT NULL)), ','))"


@R.query("fingerprint_dedup", f"SELECT {_PRINT} AS fingerprint, min(sample_id) AS sample_id FROM samples GROUP BY 1")
def fingerprint_dedup(s: SparkSession, d: str) -> DataFrame:
    """One sample of each request and set of picks."""
    keys = F.array_join(F.array_sort(F.array_compact(F.coalesce("meta.picked_keys", _none()))), ",")
    return requests.without_copies(table(s, d, "samples"), "sample_id", F.md5(F.concat(F.coalesce("meta.query_text", F.lit("")), F.lit("\x1f"), keys)))


@R.query("seed_gate", f"WITH {NEWEST} SELECT work_key, round({_SCORE}, 6) AS score FROM nb WHERE {_INFO} AND round({_SCORE}, 6) >= 0.6")
def seed_gate(s: SparkSession, d: str) -> DataFrame:
    """Books that may be the right answer of a sample: well enough known, informative and a good match."""
    x = _books(s, d).filter(sampling.informative(3)).withColumn("score", F.round(search.match_score(TARGET), 6))
    return x.filter("score >= 0.6").select("work_key", "score")


_OWN = "nb.work_key <> o.work_key"


@R.query("related_draw", f"WITH {NEWEST}, o AS (SELECT * FROM nb WHERE regexp_extract(work_key, '[0-9]+')::BIGINT % {EVERY} = 0), x AS (SELECT o.work_key AS query, nb.work_key, len(list_intersect(list_transform(list_filter(coalesce(nb.subjects, []), lambda x: x IS NOT NULL), lambda x: lower(x)), list_transform(list_filter(coalesce(o.subjects, []), lambda x: x IS NOT NULL), lambda x: lower(x)))) + CASE WHEN nb.era = o.era THEN 0.5::DOUBLE ELSE 0 END AS nearness FROM nb, o WHERE {_OWN} AND list_has_any(nb.genres, o.genres) AND {_INFO.replace('readers', 'nb.readers').replace('subjects', 'nb.subjects').replace('description', 'nb.description')}), y AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY nearness DESC, work_key) AS place FROM x QUALIFY place <= 10) SELECT query, work_key FROM y QUALIFY row_number() OVER (PARTITION BY query ORDER BY {_unit(chr(39).join(['query || ', '/', ' || work_key']), 61)}, work_key) = 1")
def related_draw(s: SparkSession, d: str) -> DataFrame:
    """One book for each request 'like this one': drawn from the ten nearest."""
    from lectern.plans.search_queries import related_seed_each

    x = related_seed_each(s, d)
    u = unit(F.concat("query", F.lit("/"), "work_key"), 61)
    return x.groupBy("query").agg(F.min(F.struct(u.alias("u"), "work_key")).alias("m")).select("query", "m.work_key")


@R.query("distil_resume", "SELECT sample_id FROM samples WHERE task = 'grounded_recommend' AND sample_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'eng')")
def distil_resume(s: SparkSession, d: str) -> DataFrame:
    """Samples that an interrupted job hasn't handled yet, with the English documents' numbers as its log."""
    done = table(s, d, "documents").filter("lang = 'eng'").select(F.col("doc_id").alias("sample_id"))
    return requests.pending(table(s, d, "samples").filter("task = 'grounded_recommend'").select("sample_id"), "sample_id", done)


_KEY = f"sample_id || ':' || substr(sha256({_ROLE.format('user')}), 1, 16)"


@R.query("judge_uncached", f"WITH c AS (SELECT {_KEY} AS cache_key FROM samples WHERE split = 'test'), x AS (SELECT sample_id, {_KEY} AS cache_key FROM samples) SELECT sample_id, cache_key FROM x WHERE cache_key NOT IN (SELECT cache_key FROM c)")
def judge_uncached(s: SparkSession, d: str) -> DataFrame:
    """Samples without a rating in the cache; the cache holds the test split's."""
    key = F.concat(F.col("sample_id").cast("string"), F.lit(":"), F.substring(F.sha2("prompt", 256), 1, 16))
    x = _texts(s, d).select("sample_id", key.alias("cache_key"))
    cache = table(s, d, "samples").filter("split = 'test'").select("sample_id").join(x, "sample_id").select("cache_key")
    return requests.pending(x, "cache_key", cache).select("sample_id", "cache_key")


@R.query("write_records", f"WITH {_PICKS}, t AS (SELECT sample_id, unnest(ids) AS id, {_WHY.format('unnest(whys)')} AS why FROM pk) SELECT substr(sha256(id || ':' || why), 1, 16) AS cache_key, count(*) AS uses, min(sample_id) AS first_sample FROM t WHERE why <> '' GROUP BY 1")
def write_records(s: SparkSession, d: str) -> DataFrame:
    """Reference texts as records under a key of their text, so that equal ones are judged once."""
    x = _picks(s, d).select("sample_id", F.inline(requests.read_lines(requests.write_lines("picks"))))
    return x.groupBy(F.substring(F.sha2(F.concat("id", F.lit(":"), "why"), 256), 1, 16).alias("cache_key")).agg(F.count("*").alias("uses"), F.min("sample_id").alias("first_sample"))


@R.query("rated_predictions", f"WITH {_GRADES}, p AS (SELECT sample_id AS i, 'first' AS model, cand[1] AS pick FROM gb UNION ALL SELECT sample_id, 'reference', ids[1] FROM gb WHERE len(ids) > 0), c AS (SELECT i FROM p GROUP BY 1 HAVING count(DISTINCT model) = 2) SELECT model, count(*) AS n, round(avg(g[nullif(list_position(cand, pick), 0)]), 6) AS mean_grade FROM p JOIN gb ON i = sample_id WHERE i IN (SELECT i FROM c) GROUP BY 1")
def rated_predictions(s: SparkSession, d: str) -> DataFrame:
    """Two models' first picks with ratings by sample index, over the samples that both answered (made-up grades)."""
    g = _graded(s, d)
    first = g.select(F.col("sample_id").alias("i"), F.lit("first").alias("model"), F.get("cand", F.lit(0)).alias("pick"))
    ref = g.filter(F.size("ids") > 0).select(F.col("sample_id").alias("i"), F.lit("reference").alias("model"), F.get("ids", F.lit(0)).alias("pick"))
    x = requests.common_of_models(first.unionByName(ref), g.select(F.col("sample_id").alias("i"), "grades"))
    return x.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg(F.try_element_at("grades", "pick")), 6).alias("mean_grade"))


@R.query("relabel_stats", f"""WITH {_GRADES}, x AS (SELECT sample_id, n_limit, ids, cand, unnest(cand) AS c, generate_subscripts(cand, 1) AS o, unnest(g) AS gr FROM gb), y AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY gr DESC, coalesce(nullif(list_position(ids, c), 0), 1048576), o) AS k FROM x WHERE gr >= 1),
z AS (SELECT sample_id, list(c ORDER BY k) AS new_ids FROM y WHERE k <= n_limit GROUP BY 1), w AS (SELECT gb.ids, coalesce(z.new_ids, []) AS new_ids FROM gb LEFT JOIN z USING (sample_id))
SELECT count(*) AS n, count(*) FILTER (WHERE len(new_ids) = 0) AS emptied, count(*) FILTER (WHERE len(new_ids) > 0 AND new_ids = ids) AS kept, count(*) FILTER (WHERE len(new_ids) > 0 AND new_ids <> ids) AS changed, sum(len(list_filter(new_ids, lambda x: NOT list_contains(ids, x))))::BIGINT AS added, sum(len(list_filter(ids, lambda x: NOT list_contains(new_ids, x))))::BIGINT AS removed FROM w""")
def relabel_stats(s: SparkSession, d: str) -> DataFrame:
    """What relabelling by grades changes (made-up grades)."""
    from lectern.operators import evaluate

    x = _graded(s, d).select("ids", evaluate.relabelled(F.col("grades"), F.col("ids"), F.col("cand"), F.col("n_limit")).alias("new"))
    same, some = F.col("new") == F.col("ids"), F.size("new") > 0
    return x.agg(
        F.count("*").alias("n"), F.count_if(~some).alias("emptied"), F.count_if(some & same).alias("kept"), F.count_if(some & ~same).alias("changed"),
        F.sum(F.size(F.array_except("new", "ids"))).alias("added"), F.sum(F.size(F.array_except("ids", "new"))).alias("removed"),
    )


@R.query("distil_gates", f"WITH {_PICKS}, c AS (SELECT sample_id, list_distinct(regexp_extract_all({_ROLE.format('user')}, '(?m)^\\[(a\\d+)\\]', 1)) AS cand FROM samples), x AS (SELECT pk.sample_id, CASE WHEN len(list_distinct(ids)) <> len(ids) OR len(list_filter(ids, lambda i: NOT list_contains(cand, i))) > 0 THEN 'ids' WHEN len(list_filter(whys, lambda w: coalesce(length(trim(w, ' ')), 0) NOT BETWEEN 25 AND 320)) + len(ids) - len(whys) > 0 THEN 'length' END AS problem FROM pk JOIN c USING (sample_id)) SELECT coalesce(problem, 'passed') AS problem, count(*) AS n FROM x GROUP BY 1")
def distil_gates(s: SparkSession, d: str) -> DataFrame:
    """First gate that an answer fails as a whole: its ids, then the length of its texts."""
    x = _picks(s, d).select("picks", F.transform("picks", lambda p: p["id"]).alias("ids"), F.array_distinct(T.candidate_ids("prompt")).alias("cand"))
    ids = (F.size(F.array_distinct("ids")) != F.size("ids")) | (F.size(F.array_except("ids", "cand")) > 0)
    length = F.exists("picks", lambda p: ~F.coalesce(F.length(F.trim(p["why"])), F.lit(0)).between(25, 320))
    return x.groupBy(F.when(ids, "ids").when(length, "length").otherwise("passed").alias("problem")).agg(F.count("*").alias("n"))


@R.query("built_samples", f"WITH {NEWEST}, x AS (SELECT era, work_key, title, round({_SCORE}, 6) AS score, row_number() OVER (PARTITION BY era ORDER BY {_unit('work_key', 67)}, work_key) AS k FROM nb WHERE era IS NOT NULL), y AS (SELECT * FROM x WHERE k <= 12), z AS (SELECT *, row_number() OVER (PARTITION BY era ORDER BY score DESC, k) AS r FROM y) SELECT era, count(*) AS n_candidates, count(*) FILTER (WHERE r <= 3) AS n_picks, string_agg(CASE WHEN r <= 3 THEN 'a' || k END, ',' ORDER BY r) AS picks, string_agg(CASE WHEN r <= 3 THEN work_key END, ',' ORDER BY r) AS picked_keys, 3 AS messages FROM z GROUP BY 1")
def built_samples(s: SparkSession, d: str) -> DataFrame:
    """Samples built from books: numbered candidates, the best three as picks, messages and meta."""
    x = _books(s, d).filter(F.col("era").isNotNull()).select("era", "work_key", "title", F.round(search.match_score(TARGET), 6).alias("score"))
    w = Window.partitionBy("era").orderBy(unit("work_key", 67), "work_key")
    c = x.withColumn("k", F.row_number().over(w)).filter("k <= 12")  # cut by rank before rows are gathered
    one = c.groupBy("era").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "k", "work_key", "title"))).alias("c"))
    best = F.slice("c", 1, 3)
    ids = F.transform(best, lambda v: F.concat(F.lit("a"), v["k"].cast("string")))
    answer = prompts.sample_answer(F.transform(best, lambda v: F.struct(F.concat(F.lit("a"), v["k"].cast("string")).alias("id"), (-v["s"]).alias("score"))))
    listing = F.array_join(F.transform(F.array_sort(F.transform("c", lambda v: F.struct(v["k"].alias("k"), v["title"].alias("t")))), lambda v: F.concat(F.lit("[a"), v["k"].cast("string"), F.lit("] "), F.coalesce(v["t"], F.lit("")))), "\n")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    built = one.select("era", F.array(message("system", F.lit("")), message("user", listing), message("assistant", answer)).alias("m"), ids.alias("ids"), F.transform(best, lambda v: v["work_key"]).alias("keys"), F.size("c").cast("bigint").alias("n_candidates"))
    return built.select("era", "n_candidates", F.size("ids").cast("bigint").alias("n_picks"), F.array_join("ids", ",").alias("picks"), F.array_join("keys", ",").alias("picked_keys"), F.size("m").alias("messages"))


def label_keywords(s: SparkSession, d: str) -> DataFrame:
    """Plain words that the labels' patterns begin with; a settings table, so it has no SQL."""
    return s.createDataFrame(requests.label_keywords(), "kind string, slug string, position int, keyword string")


R.query("label_keywords")(label_keywords)


def taxonomy(s: SparkSession, d: str) -> DataFrame:
    """All labels with their names; a settings table, so it has no SQL."""
    return requests.taxonomy(s)


R.query("taxonomy")(taxonomy)


@R.query("recommendations", f"WITH {NEWEST}, a AS (SELECT era AS asked, work_key, round({_SCORE}, 6) AS score, len(list_intersect(coalesce(genres, []), {_GL})) + len(list_intersect(coalesce(moods, []), {_ML})) AS reasons FROM nb WHERE era IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, work_key) AS rank FROM a) SELECT asked, rank, work_key, score, CASE WHEN score >= 0.75 THEN 'güçlü' WHEN score >= 0.5 THEN 'orta' ELSE 'zayıf' END AS strength, reasons, max(score) OVER (PARTITION BY asked) < 0.5 AS degraded FROM b WHERE rank <= 5")
def recommendations(s: SparkSession, d: str) -> DataFrame:
    """Answers by request: rank, score, its strength in words, number of reasons, and whether even the best is weak."""
    x = _books(s, d).filter(F.col("era").isNotNull())
    n = overlap(F.coalesce("genres", _none()), search._list(TARGET.genres)) + overlap(F.coalesce("moods", _none()), search._list(TARGET.moods))
    x = x.select(F.col("era").alias("asked"), "work_key", F.round(search.match_score(TARGET), 6).alias("score"), n.alias("reasons"))
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "work_key"))).filter("rank <= 5")
    best = F.max("score").over(Window.partitionBy("asked"))  # over the kept rows
    return x.select("asked", "rank", "work_key", "score", requests.strength(F.col("score")).alias("strength"), "reasons", (best < 0.5).alias("degraded"))


QUERIES, SQL = R.queries, R.sql

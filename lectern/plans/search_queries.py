"""Queries on search, ranking, sampling and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.scalars import overlap, unit
from lectern.operators import catalog, evaluate, sampling, search
from lectern.plans.catalog_queries import NEWEST
from lectern.plans.registry import Registry
from lectern.tables import table

R = Registry()
QUERY = ["silent", "lantern", "harbour", "winter"]
TARGET = search.Target(genres=("fantasy", "crime"), moods=("calm", "dark"), era="modern", length="medium", languages=("tur", "eng"))
STRICT = search.Target(genres=("fantasy", "crime"), era="modern", languages=("tur", "eng"), exclude=("/works/OL777W",), min_ratings=1, strict=True)
SOFT = search.Target(genres=("fantasy",), length="short", languages=("tur",), audience="child")


def _unit(key: str, seed: int | str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT::DOUBLE / 4294967296.0)"


def _books(s: SparkSession, d: str) -> DataFrame:
    return catalog.newest(table(s, d, "books"))


_TERMS = f"list_filter(regexp_extract_all(lower(translate(coalesce(text, ''), '{T._FROM}', '{T._TO}')), '[a-z]+'), lambda x: NOT list_contains([{', '.join(repr(w) for w in T.STOPWORDS)}], x))"
_TOK = f"tok AS (SELECT doc_id, lang, {_TERMS} AS terms FROM documents)"
_BM25 = f"""{_TOK}, st AS (SELECT count(*) AS n, greatest(avg(len(terms)), 1) AS avgdl FROM tok),
tf AS (SELECT doc_id, lang, term, len(list_filter(terms, lambda x: x = term)) AS tf, len(terms) AS dl FROM tok, (SELECT unnest({QUERY!r}) AS term)),
df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY 1),
sc AS (SELECT doc_id, any_value(lang) AS lang, round(sum(ln((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term), st WHERE df > 0 GROUP BY 1)"""


@R.query("bm25_term_stats", f"WITH {_TOK}, p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM tok) GROUP BY 1, 2) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY 1")
def bm25_term_stats(s: SparkSession, d: str) -> DataFrame:
    post, _ = search.postings(table(s, d, "documents"), "doc_id", T.search_terms("text"))
    return search.term_stats(post)


@R.query("bm25_topk", f"WITH {_BM25} SELECT doc_id, score FROM sc WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return search.BM25().search(table(s, d, "documents"), "doc_id", T.search_terms("text"), QUERY, 20)


@R.query("bm25_filtered", f"WITH {_BM25} SELECT doc_id, score FROM sc WHERE score > 0 AND lang = 'eng' ORDER BY score DESC, doc_id LIMIT 10")
def bm25_filtered(s: SparkSession, d: str) -> DataFrame:
    return search.BM25().search(table(s, d, "documents"), "doc_id", T.search_terms("text"), QUERY, 10, F.col("lang") == "eng")


def stemmed_terms(s: SparkSession, d: str) -> DataFrame:
    """Stemmed terms of all documents with their counts (the stemmer has no SQL)."""
    x = table(s, d, "documents").select("doc_id", T.stems(T.search_terms("text")).alias("terms"))
    return x.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))


R.query("stemmed_terms")(stemmed_terms)


def _vectors(s: SparkSession, d: str, ids: list[int]) -> dict[int, list[float]]:
    return {r[0]: list(r[1]) for r in table(s, d, "embeddings").filter(F.col("vec_id").isin(ids)).select("vec_id", "embedding").collect()}


_COS = "round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6)"
_DENSE = f"dn AS (SELECT query, vec_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS place FROM (SELECT a.vec_id AS query, b.vec_id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id IN (0, 1, 2)))"


@R.query("dense_topk", f"WITH {_DENSE} SELECT query, vec_id, score, place FROM dn WHERE place <= 10")
def dense_topk(s: SparkSession, d: str) -> DataFrame:
    return search.dense_topk(table(s, d, "embeddings"), "vec_id", _vectors(s, d, [0, 1, 2]), 10)


@R.query("similar_dense", f"WITH {_DENSE} SELECT vec_id, score FROM dn WHERE query = 0 AND vec_id <> 0 AND place <= 11 ORDER BY place LIMIT 10")
def similar_dense(s: SparkSession, d: str) -> DataFrame:
    x = search.dense_topk(table(s, d, "embeddings"), "vec_id", _vectors(s, d, [0]), 11)
    return x.filter("vec_id <> 0").orderBy("place").limit(10).select("vec_id", "score")


_FUSED = f"""{_BM25}, lx AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM (SELECT doc_id, score FROM sc WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 40)),
{_DENSE}, fz AS (SELECT doc_id, sum(part) AS fusion FROM (SELECT doc_id, 1.0 / (60 + place) AS part FROM lx UNION ALL SELECT vec_id, 0.7 / (60 + place) FROM dn WHERE query = 0 AND place <= 40) GROUP BY 1)"""


def _fused(s: SparkSession, d: str) -> DataFrame:
    lexical = search.ranked(search.BM25().search(table(s, d, "documents"), "doc_id", T.search_terms("text"), QUERY, 40), "doc_id")
    dense = search.dense_topk(table(s, d, "embeddings"), "vec_id", _vectors(s, d, [0]), 40).select(F.col("vec_id").alias("doc_id"), "place")
    return search.fuse([(lexical, 1.0), (dense, 0.7)], "doc_id")


@R.query("rrf_fusion", f"WITH {_FUSED} SELECT doc_id, round(fusion, 9) AS fusion FROM fz")
def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    return _fused(s, d).select("doc_id", F.round("fusion", 9).alias("fusion"))


@R.query("hybrid_rank", f"WITH {_FUSED} SELECT doc_id, round(least(1.0, fusion * 60) + 1.2 * CASE WHEN lang = 'eng' THEN 1.0 ELSE 0.0 END + 0.35 * least(1.0, coalesce(n_chars, 0) / 10000.0), 6) AS total FROM fz JOIN documents USING (doc_id) ORDER BY total DESC, doc_id LIMIT 20")
def hybrid_rank(s: SparkSession, d: str) -> DataFrame:
    match = F.when(F.col("lang") == "eng", 1.0).otherwise(0.0)
    known = F.least(F.lit(1.0), F.coalesce("n_chars", F.lit(0)) / 10000.0)
    return search.hybrid(_fused(s, d), table(s, d, "documents"), "doc_id", match, known, 20).select("doc_id", "total")


REQUEST = search.Target(genres=("fantasy", "crime"), moods=("calm", "dark"), era="modern", languages=("tur", "eng"), exclude=("/works/OL777W",))


def _items(s: SparkSession, d: str) -> DataFrame:
    """Documents with the facts of the work that they are about."""
    return table(s, d, "documents").filter(F.col("work_key").isNotNull()).select("doc_id", "work_key", "text").join(_books(s, d).drop("text"), "work_key")


def hybrid_filtered(s: SparkSession, d: str) -> DataFrame:
    """Hybrid search with a request's filters on all hits."""
    vector = _vectors(s, d, [0]).get(0)
    return search.retrieve(_items(s, d), "doc_id", T.search_terms("text"), QUERY, table(s, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), vector, REQUEST).select("doc_id", "work_key", "fusion", "total")


R.query("hybrid_filtered")(hybrid_filtered)


def hybrid_browse(s: SparkSession, d: str) -> DataFrame:
    """The same request with words that match nothing: the best known works that pass."""
    return search.retrieve(_items(s, d), "doc_id", T.search_terms("text"), ["zzzz"], table(s, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), None, REQUEST, seed=7).select("doc_id", "work_key", "fusion", "total")


R.query("hybrid_browse")(hybrid_browse)


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_G, _M, _L = (_sql_list(x) for x in (TARGET.genres, TARGET.moods, TARGET.languages))
_COMMON = "len(list_intersect(coalesce({}, []), {}))"
_SCORE = (
    f"greatest(0.0, least(1.0, 0.85 * (3.0 * least(1.0, {_COMMON.format('genres', _G)} / 2) + 2.0 * least(1.0, {_COMMON.format('moods', _M)} / 2) + CASE WHEN era = 'modern' THEN 1.5 ELSE 0 END"
    f" + CASE WHEN length_bucket = 'medium' THEN 1.5 ELSE 0 END + CASE WHEN list_has_any(languages, {_L}) THEN 1.0 ELSE 0 END) / 9.0 + 0.15 * coalesce(popularity, 0)))"
)


@R.query("match_score", f"WITH {NEWEST} SELECT work_key, round({_SCORE}, 6) AS score FROM nb")
def match_score(s: SparkSession, d: str) -> DataFrame:
    return _books(s, d).select("work_key", F.round(search.match_score(TARGET), 6).alias("score"))


@R.query("match_reasons", f"WITH {NEWEST} SELECT work_key, array_to_string(list_concat(list_concat(list_transform(list_sort(list_intersect(coalesce(genres, []), {_G})), lambda x: 'tür:' || x), list_transform(list_sort(list_intersect(coalesce(moods, []), {_M})), lambda x: 'ruh:' || x)), list_filter([CASE WHEN era = 'modern' THEN 'dönem:modern' END, CASE WHEN length_bucket = 'medium' THEN 'uzunluk:medium' END, CASE WHEN list_has_any(languages, {_L}) THEN 'dil:' || array_to_string(list_sort(list_intersect(languages, {_L})), ',') END], lambda x: x IS NOT NULL)), ' ') AS reasons FROM nb")
def match_reasons(s: SparkSession, d: str) -> DataFrame:
    return _books(s, d).select("work_key", F.array_join(search.match_reasons(TARGET), " ").alias("reasons"))


@R.query("strict_filters", f"WITH {NEWEST} SELECT work_key FROM nb WHERE work_key <> '/works/OL777W' AND rating_count >= 1 AND list_has_any(languages, {_L}) AND era = 'modern' AND list_has_any(genres, {_G})")
def strict_filters(s: SparkSession, d: str) -> DataFrame:
    return _books(s, d).filter(search.passes(STRICT)).select("work_key")


@R.query("soft_filters", f"WITH {NEWEST} SELECT work_key FROM nb WHERE length_bucket = 'short' AND audience = 'child' AND list_has_any(languages, ['tur'])")
def soft_filters(s: SparkSession, d: str) -> DataFrame:
    return _books(s, d).filter(search.passes(SOFT)).select("work_key")


@R.query("browse_popular", f"WITH {NEWEST} SELECT work_key, round(coalesce(popularity, 0), 6) AS rank_score FROM nb WHERE list_has_any(languages, ['tur']) AND length_bucket = 'short' AND audience = 'child' ORDER BY rank_score DESC, work_key LIMIT 40")
def browse_popular(s: SparkSession, d: str) -> DataFrame:
    return search.browse(_books(s, d), SOFT, 40).select("work_key", "rank_score")


@R.query("browse_jitter", f"WITH {NEWEST} SELECT work_key, round(coalesce(popularity, 0) * (0.75 + 0.5 * floor({_unit('work_key', 7)} * 1000) / 1000), 6) AS rank_score FROM nb ORDER BY rank_score DESC, work_key LIMIT 40")
def browse_jitter(s: SparkSession, d: str) -> DataFrame:
    return search.browse(_books(s, d), search.Target(), 40, seed=7).select("work_key", "rank_score")


@R.query("similar_by_overlap", f"WITH {NEWEST}, o AS (SELECT * FROM nb WHERE work_key = '/works/OL777W') SELECT nb.work_key, len(list_intersect(list_filter(coalesce(nb.subjects, []), lambda x: x IS NOT NULL), list_filter(coalesce(o.subjects, []), lambda x: x IS NOT NULL))) AS shared, nb.popularity FROM nb, o WHERE nb.work_key <> o.work_key AND list_has_any(nb.genres, o.genres) ORDER BY shared DESC, nb.popularity DESC, nb.work_key LIMIT 10")
def similar_by_overlap(s: SparkSession, d: str) -> DataFrame:
    return search.similar_by_overlap(_books(s, d), "/works/OL777W", 10)


@R.query("weak_matches", f"WITH {NEWEST}, x AS (SELECT era AS grp, work_key AS id, round({_SCORE}, 6) AS score FROM nb WHERE era IS NOT NULL), y AS (SELECT *, count(*) FILTER (WHERE score >= 0.5) OVER (PARTITION BY grp) AS strong, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS pos FROM x) SELECT grp, id, score, n - greatest(strong, 1) AS dropped FROM y WHERE score >= 0.5 OR (strong = 0 AND pos = 1)")
def weak_matches(s: SparkSession, d: str) -> DataFrame:
    x = _books(s, d).filter(F.col("era").isNotNull()).select(F.col("era").alias("grp"), F.col("work_key").alias("id"), F.round(search.match_score(TARGET), 6).alias("score"))
    return search.not_weak(x, "grp", "score", 0.5)


@R.query("pool_head_tail", f"WITH {NEWEST}, h AS (SELECT work_key FROM nb ORDER BY popularity DESC NULLS LAST, work_key LIMIT 80), t AS (SELECT work_key FROM nb WHERE work_key NOT IN (SELECT work_key FROM h) ORDER BY {_unit('work_key', 11)}, work_key LIMIT 120) SELECT work_key, 'head' AS part FROM h UNION ALL SELECT work_key, 'tail' FROM t")
def pool_head_tail(s: SparkSession, d: str) -> DataFrame:
    return sampling.head_and_tail(_books(s, d), 200, 0.4, 11).select("work_key", "part")


@R.query("fixed_sample", f"SELECT doc_id FROM documents ORDER BY {_unit('doc_id', 5)}, doc_id LIMIT 100")
def fixed_sample(s: SparkSession, d: str) -> DataFrame:
    return sampling.fixed_size(table(s, d, "documents").select("doc_id"), 100, 5, "doc_id")


@R.query("weighted_sample", f"WITH {NEWEST} SELECT work_key, round(-ln((({_unit('work_key', 13)}) * 4294967296.0 + 0.5) / 4294967296.0) / (0.2 + coalesce(popularity, 0)), 9) AS draw FROM nb ORDER BY draw, work_key LIMIT 100")
def weighted_sample(s: SparkSession, d: str) -> DataFrame:
    return sampling.weighted(_books(s, d), 100, 0.2 + F.coalesce("popularity", F.lit(0.0)), 13, "work_key").select("work_key", "draw")


@R.query("per_key_cap", f"SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {_unit('event_id', 3)}, event_id) <= 5")
def per_key_cap(s: SparkSession, d: str) -> DataFrame:
    return sampling.capped(table(s, d, "events"), "user_id", 5, 3, "event_id").select("user_id", "event_id")


@R.query("train_valid_split", f"WITH h AS (SELECT sample_id FROM samples ORDER BY {_unit('sample_id', 17)}, sample_id LIMIT (SELECT greatest(1, floor(count(*) * 0.05))::BIGINT FROM samples)) SELECT sample_id, CASE WHEN sample_id IN (SELECT sample_id FROM h) THEN 'valid' ELSE 'train' END AS part FROM samples")
def train_valid_split(s: SparkSession, d: str) -> DataFrame:
    return sampling.split(table(s, d, "samples").select("sample_id"), 0.05, 17, "sample_id")


@R.query("tail_holdout", "SELECT sample_id, CASE WHEN (SELECT count(*) FROM samples) > 600 AND sample_id IN (SELECT sample_id FROM samples ORDER BY sample_id DESC LIMIT 200) THEN 'valid' ELSE 'train' END AS part FROM samples")
def tail_holdout(s: SparkSession, d: str) -> DataFrame:
    return sampling.tail_holdout(table(s, d, "samples").select("sample_id"), "sample_id")


_GO, _MO = _COMMON.format("genres", _G), _COMMON.format("moods", _M)


@R.query("hard_negatives", f"WITH {NEWEST}, x AS (SELECT work_key, unnest(list_filter([CASE WHEN {_GO} > 0 AND {_MO} = 0 THEN 'mood' END, CASE WHEN {_MO} > 0 AND {_GO} = 0 THEN 'genre' END, CASE WHEN length_bucket IS DISTINCT FROM 'medium' THEN 'length' END, CASE WHEN era IS DISTINCT FROM 'modern' THEN 'era' END], lambda x: x IS NOT NULL)) AS kind FROM nb WHERE work_key <> '/works/OL777W') SELECT work_key, kind, place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {_unit('kind || work_key', 19)}, work_key) AS place FROM x) WHERE place <= 20")
def hard_negatives(s: SparkSession, d: str) -> DataFrame:
    return sampling.hard_negatives(_books(s, d), TARGET, 20, 19, F.col("work_key") == "/works/OL777W")


@R.query("positives", f"WITH {NEWEST} SELECT work_key, round({_SCORE}, 6) AS score FROM nb WHERE list_has_any(genres, {_G}) AND round({_SCORE}, 6) >= 0.55 ORDER BY {_unit('work_key', 23)}, work_key LIMIT 40")
def positives(s: SparkSession, d: str) -> DataFrame:
    x = _books(s, d).filter(overlap(F.coalesce("genres", F.array().cast("array<string>")), search._list(TARGET.genres)) > 0).withColumn("score", F.round(search.match_score(TARGET), 6))
    return sampling.fixed_size(x.filter("score >= 0.55"), 40, 23, "work_key").select("work_key", "score")


_INFO = "coalesce(readers, 0) >= 3 AND (len(coalesce(subjects, [])) >= 2 OR length(coalesce(description, '')) >= 60)"


@R.query("informative_books", f"WITH {NEWEST} SELECT work_key FROM nb WHERE {_INFO}")
def informative_books(s: SparkSession, d: str) -> DataFrame:
    return _books(s, d).filter(sampling.informative(3)).select("work_key")


@R.query("related_seed", f"WITH {NEWEST}, o AS (SELECT * FROM nb WHERE work_key = '/works/OL777W') SELECT nb.work_key, len(list_intersect(list_transform(list_filter(coalesce(nb.subjects, []), lambda x: x IS NOT NULL), lambda x: lower(x)), list_transform(list_filter(coalesce(o.subjects, []), lambda x: x IS NOT NULL), lambda x: lower(x)))) + CASE WHEN nb.era = o.era THEN 0.5::DOUBLE ELSE 0 END AS nearness FROM nb, o WHERE nb.work_key <> o.work_key AND list_has_any(nb.genres, o.genres) AND {_INFO.replace('readers', 'nb.readers').replace('subjects', 'nb.subjects').replace('description', 'nb.description')} ORDER BY nearness DESC, nb.work_key LIMIT 10")
def related_seed(s: SparkSession, d: str) -> DataFrame:
    b = _books(s, d)
    one = b.filter("work_key = '/works/OL777W'").select("genres", "subjects", "era").first()
    if one is None:
        return b.limit(0).select("work_key", F.lit(0.0).alias("nearness"))
    low = lambda c: F.transform(F.array_compact(F.coalesce(c, F.array().cast("array<string>"))), F.lower)
    mine = F.array(*[F.lit(x.lower()) for x in one["subjects"] or [] if x]).cast("array<string>")
    near = overlap(low("subjects"), mine) + F.when(F.col("era") == one["era"], 0.5).otherwise(0.0)
    t = search.Target(genres=tuple(one["genres"] or ()), strict=True)
    return b.filter((F.col("work_key") != "/works/OL777W") & search.passes(t) & sampling.informative(3)).select("work_key", near.alias("nearness")).orderBy(F.desc("nearness"), "work_key").limit(10)


@R.query("numbered_candidates", f"SELECT era, work_key, place, 'a' || place AS candidate_id FROM (SELECT era, work_key, row_number() OVER (PARTITION BY era ORDER BY {_unit(chr(39).join(['era || ', '/', ' || work_key']), 29)}, work_key) AS place FROM (SELECT DISTINCT era, work_key FROM books WHERE era IS NOT NULL)) WHERE place <= 12")
def numbered_candidates(s: SparkSession, d: str) -> DataFrame:
    return sampling.numbered_candidates(table(s, d, "books").filter(F.col("era").isNotNull()), "era", "work_key", 29)


def _texts(s: SparkSession, d: str) -> DataFrame:
    role = lambda r: F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == r), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    return table(s, d, "samples").select("sample_id", role("user").alias("prompt"), role("assistant").alias("answer"), F.col("meta.n_limit").alias("n_limit"), "task")


_ROLE = "array_to_string(list_transform(list_filter(messages, lambda m: m.role = '{}'), lambda m: coalesce(m.content, '')), chr(10))"
_IDS = "(CASE WHEN json_valid(answer) THEN coalesce(try_cast(json_extract(answer, '$.ids') AS VARCHAR[]), json_extract_string(answer, '$.picks[*].id')) END)"
_SAMPLES = f"""sx AS (SELECT sample_id, {_ROLE.format('user')} AS prompt, {_ROLE.format('assistant')} AS answer, meta.n_limit AS n_limit, task FROM samples),
sy AS (SELECT *, regexp_extract_all(prompt, '(?m)^\\[(a\\d+)\\]', 1) AS cand, list_filter(coalesce({_IDS}, []), lambda x: x IS NOT NULL) AS raw FROM sx), sz AS (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS ids FROM sy)"""


@R.query("parsed_samples", f"WITH {_SAMPLES} SELECT sample_id, array_to_string(cand, ',') AS candidates, array_to_string(ids, ',') AS ids FROM sz")
def parsed_samples(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("sample_id", F.array_join(T.candidate_ids("prompt"), ",").alias("candidates"), F.array_join(T.answer_ids("answer"), ",").alias("ids"))


def _graded(s: SparkSession, d: str) -> DataFrame:
    x = _texts(s, d).select("sample_id", "n_limit", T.candidate_ids("prompt").alias("cand"), T.answer_ids("answer").alias("ids"))
    x = x.filter((F.size("cand") > 0) & F.col("n_limit").isNotNull()).withColumn("cand", F.array_distinct("cand"))
    grade = lambda i: F.floor(unit(F.concat(F.col("sample_id").cast("string"), F.lit("/"), i), 31) * 3).cast("int")
    return x.withColumn("grades", F.map_from_arrays("cand", F.transform("cand", grade)))


_GRADES = f"""{_SAMPLES}, ga AS (SELECT sample_id, n_limit, ids, list_filter(cand, lambda x, i: list_position(cand, x) = i) AS cand FROM sz WHERE len(cand) > 0 AND n_limit IS NOT NULL),
gb AS (SELECT *, list_transform(cand, lambda x: floor(('0x' || substr(md5('31:' || sample_id || '/' || x), 1, 8))::BIGINT::DOUBLE / 4294967296.0 * 3)::INTEGER) AS g FROM ga)"""


@R.query("judge_score", f"""WITH {_GRADES}, x AS (SELECT n_limit, list_reverse_sort(g) AS v, list_filter(list_transform(ids, lambda i: g[nullif(list_position(cand, i), 0)]), lambda y: y IS NOT NULL)[1:n_limit] AS p FROM gb),
y AS (SELECT list_avg(v[1:n_limit]) AS ideal, list_avg(v) AS rnd, p FROM x),
z AS (SELECT count(*) AS n, avg((len(p) = 0)::INT) AS no_pick, avg(rnd) AS random_grade, avg(ideal) AS ideal_grade, sum(list_sum(p)) / sum(len(p)) AS mean_grade, sum(len(list_filter(p, lambda q: q = 2))) / sum(len(p)) AS good_rate, sum(len(list_filter(p, lambda q: q = 0))) / sum(len(p)) AS bad_rate FROM y)
SELECT n, round(no_pick, 6) AS no_pick, round(random_grade, 6) AS random_grade, round(ideal_grade, 6) AS ideal_grade, round(mean_grade, 6) AS mean_grade, round(good_rate, 6) AS good_rate, round(bad_rate, 6) AS bad_rate, round((mean_grade - random_grade) / (ideal_grade - random_grade), 6) AS normalized FROM z""")  # fmt: skip
def judge_score(s: SparkSession, d: str) -> DataFrame:
    return evaluate.judge_score(_graded(s, d))


@R.query("pick_metrics", f"""WITH {_GRADES}, x AS (SELECT n_limit, cand, ids, cand[1:n_limit] AS ref FROM gb)
SELECT count(*) AS n, round(sum(len(list_intersect(ids, ref))) / sum(len(ids)), 6) AS pick_precision, round(sum(len(list_intersect(ids, ref))) / sum(least(len(ref), n_limit)), 6) AS pick_recall, round(sum(len(list_intersect(ids, cand))) / sum(len(ids)), 6) AS id_valid, round(avg((len(ids) <= n_limit)::INT), 6) AS limit_respected, round(avg((len(ids) > 0)::INT), 6) AS coverage, round(avg(len(ids)), 6) AS avg_picks FROM x""")  # fmt: skip
def pick_metrics(s: SparkSession, d: str) -> DataFrame:
    """Picks against the baseline that takes the first candidates."""
    x = _graded(s, d).withColumn("reference", F.slice("cand", 1, F.col("n_limit"))).withColumnRenamed("cand", "valid_ids")
    return evaluate.pick_metrics(x)


@R.query("relabel_rank", f"""WITH {_GRADES}, x AS (SELECT sample_id, n_limit, ids, cand, unnest(cand) AS c, generate_subscripts(cand, 1) AS o, unnest(g) AS gr FROM gb), y AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY gr DESC, coalesce(nullif(list_position(ids, c), 0), 1048576), o) AS k FROM x WHERE gr >= 1)
SELECT sample_id, string_agg(c, ',' ORDER BY k) AS new_ids FROM y WHERE k <= n_limit GROUP BY 1""")  # fmt: skip
def relabel_rank(s: SparkSession, d: str) -> DataFrame:
    x = _graded(s, d).select("sample_id", F.array_join(evaluate.relabelled(F.col("grades"), F.col("ids"), F.col("cand"), F.col("n_limit")), ",").alias("new_ids"))
    return x.filter("new_ids <> ''")


_WORDS = "regexp_extract_all(lower(translate(coalesce({}, ''), 'İ', 'i')), '[\\p{{L}}\\p{{N}}_]+')"
_GRAMS = "list_transform(range(1, len({0}) - {1} + 2), lambda i: array_to_string({0}[i:i + {1} - 1], ' '))"


@R.query("distinct_n", f"WITH x AS (SELECT {_WORDS.format('text')} AS w FROM eval_items), g AS (SELECT unnest({_GRAMS.format('w', 2)}) AS g FROM x) SELECT count(DISTINCT g) AS distinct_grams, count(*) AS grams, round(count(DISTINCT g) / count(*), 6) AS share FROM g")
def distinct_n(s: SparkSession, d: str) -> DataFrame:
    return evaluate.distinct_n(table(s, d, "eval_items"), "text", 2)


@R.query("distinct_n_documents", f"WITH x AS (SELECT {_WORDS.format('text')} AS w FROM documents), g AS (SELECT unnest({_GRAMS.format('w', 2)}) AS g FROM x) SELECT count(DISTINCT g) AS distinct_grams, count(*) AS grams, round(count(DISTINCT g) / count(*), 6) AS share FROM g")
def distinct_n_documents(s: SparkSession, d: str) -> DataFrame:
    return evaluate.distinct_n(table(s, d, "documents"), "text", 2)


@R.query("ngram_copy", f"WITH a AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM eval_items), x AS (SELECT doc_id, unnest({_GRAMS.format('w', 8)}) AS g FROM a), y AS (SELECT item_id, unnest({_GRAMS.format('w', 8)}) AS g FROM b) SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (g)")
def ngram_copy(s: SparkSession, d: str) -> DataFrame:
    """Documents and evaluation items that share a run of eight words, over whole texts."""
    return evaluate.copies(table(s, d, "documents"), "doc_id", table(s, d, "eval_items"), "item_id", "text", 8)


@R.query("sample_stats", "SELECT task, split, count(*) AS n, round(avg(meta.n_picks), 6) AS mean_picks, round(avg(len(meta.picked_keys)), 6) AS mean_keys, count(meta.style) AS styled FROM samples GROUP BY 1, 2")
def sample_stats(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "samples").groupBy("task", "split")
    return x.agg(F.count("*").alias("n"), F.round(F.avg("meta.n_picks"), 6).alias("mean_picks"), F.round(F.avg(F.size("meta.picked_keys")), 6).alias("mean_keys"), F.count("meta.style").alias("styled"))


@R.query("length_summary", f"WITH x AS (SELECT sample_id, len({_WORDS.format(_ROLE.format('user'))}) AS n FROM samples), y AS (SELECT n, row_number() OVER (ORDER BY n, sample_id) - 1 AS k, count(*) OVER () AS c FROM x) SELECT round(avg(n), 6) AS mean_words, max(n) FILTER (WHERE k = floor(c / 2)) AS median_words, max(n) FILTER (WHERE k = floor(c * 0.95)) AS p95_words, max(n) AS max_words FROM y")
def length_summary(s: SparkSession, d: str) -> DataFrame:
    """Mean, lower-index median, 95th percentile and maximum of prompt lengths, from a histogram of lengths."""
    h = _texts(s, d).select(F.size(T.words_of("prompt")).alias("n")).groupBy("n").agg(F.count("*").alias("c"))
    w = Window.orderBy("n")  # over distinct lengths only
    h = h.withColumn("upto", F.sum("c").over(w)).withColumn("all", F.sum("c").over(Window.partitionBy()))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("all") * q), F.col("n")))
    return h.agg(F.round(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 6).alias("mean_words"), at(0.5).alias("median_words"), at(0.95).alias("p95_words"), F.max("n").alias("max_words"))


_TRN = f"len(regexp_extract_all(coalesce({{}}, ''), '(?i){T.TURKISH}'))"
_ENN = f"len(regexp_extract_all(coalesce({{}}, ''), '(?i){T.ENGLISH}'))"


def language_markers(s: SparkSession, d: str) -> DataFrame:
    """Per stored language, texts whose marks say Turkish."""
    return table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(T.is_turkish("text")).alias("turkish"))


R.query("language_markers")(language_markers)


def quality_gates(s: SparkSession, d: str) -> DataFrame:
    """First failed gate of every document's whole text as a rationale for itself."""
    x = table(s, d, "documents").withColumn("problem", evaluate.first_problem("text", "text"))
    return x.groupBy("problem").agg(F.count("*").alias("n"))


R.query("quality_gates")(quality_gates)


def answer_gates(s: SparkSession, d: str) -> DataFrame:
    """First failed gate of every sample's whole answer as a rationale for its prompt, by task."""
    x = _texts(s, d).withColumn("problem", evaluate.first_problem("answer", "prompt"))
    return x.groupBy("task", "problem").agg(F.count("*").alias("n"))


R.query("answer_gates")(answer_gates)


@R.query("stage_select", f"WITH {_SAMPLES} SELECT sample_id, '{{\"ids\":[' || array_to_string(list_transform(ids, lambda x: '\"' || x || '\"'), ',') || ']}}' AS target FROM sz WHERE task = 'grounded_recommend'")
def stage_select(s: SparkSession, d: str) -> DataFrame:
    x = _texts(s, d).filter("task = 'grounded_recommend'")
    return x.select("sample_id", F.to_json(F.struct(T.answer_ids("answer").alias("ids"))).alias("target"))


@R.query("chat_markup", "SELECT sample_id, md5(array_to_string(list_transform(messages, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '')) AS h FROM samples")
def chat_markup(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "samples").select("sample_id", F.md5(T.chat_markup("messages")).alias("h"))


@R.query("cache_keys", f"SELECT sample_id, sample_id || ':' || substr(sha256({_ROLE.format('user')}), 1, 16) AS cache_key FROM samples")
def cache_keys(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("sample_id", F.concat(F.col("sample_id").cast("string"), F.lit(":"), F.substring(F.sha2("prompt", 256), 1, 16)).alias("cache_key"))


@R.query("clipped_summaries", f"WITH {NEWEST}, x AS (SELECT work_key, description AS c, substr(description, 1, 170) AS h FROM nb WHERE description IS NOT NULL) SELECT work_key, CASE WHEN length(c) <= 170 THEN c WHEN length(regexp_extract(h, '(?s)^(.*) [^ ]*$', 1)) > 0 THEN regexp_extract(h, '(?s)^(.*) [^ ]*$', 1) || '…' ELSE h || '…' END AS summary FROM x")
def clipped_summaries(s: SparkSession, d: str) -> DataFrame:
    return _books(s, d).filter(F.col("description").isNotNull()).select("work_key", T.clipped("description").alias("summary"))


def repaired_answers(s: SparkSession, d: str) -> DataFrame:
    """Answers cut short, put right again: ids before and after."""
    x = _texts(s, d).withColumn("cut", F.substring("answer", F.lit(1), F.greatest(F.length("answer") - 3, F.lit(1))))
    return x.select("sample_id", F.array_join(T.answer_ids("answer"), ",").alias("ids"), F.array_join(T.answer_ids(T.repaired_json("cut")), ",").alias("repaired_ids"))


R.query("repaired_answers")(repaired_answers)


@R.query("retriever_overlap", f"WITH {_FUSED}, a AS (SELECT doc_id FROM fz ORDER BY round(fusion, 9) DESC, doc_id LIMIT 12), b AS (SELECT doc_id FROM lx WHERE place <= 12) SELECT count(*) / 12.0 AS overlap12 FROM a JOIN b USING (doc_id)")
def retriever_overlap(s: SparkSession, d: str) -> DataFrame:
    a = _fused(s, d).orderBy(F.desc(F.round("fusion", 9)), "doc_id").limit(12).select("doc_id")
    b = search.BM25().search(table(s, d, "documents"), "doc_id", T.search_terms("text"), QUERY, 12).select("doc_id")
    return a.join(b, "doc_id").agg((F.count("*") / F.lit(12.0)).alias("overlap12"))


#: The query set of searches: every row whose id is divisible by this, against all rows.
EVERY = 100
_DENSE_EACH = f"da AS (SELECT a.vec_id AS query, b.vec_id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % {EVERY} = 0)"


def _each(s: SparkSession, d: str, itself: bool) -> DataFrame:
    v = table(s, d, "embeddings")
    return search.dense_topk_each(v, "vec_id", v.filter(F.col("vec_id") % EVERY == 0), 10, itself)


@R.query("dense_topk_each", f"WITH {_DENSE_EACH} SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS place FROM da QUALIFY place <= 10")
def dense_topk_each(s: SparkSession, d: str) -> DataFrame:
    return _each(s, d, True)


@R.query("similar_dense_each", f"WITH {_DENSE_EACH} SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS place FROM da WHERE query <> vec_id QUALIFY place <= 10")
def similar_dense_each(s: SparkSession, d: str) -> DataFrame:
    return _each(s, d, False)


_EACH = f"{NEWEST}, o AS (SELECT * FROM nb WHERE regexp_extract(work_key, '[0-9]+')::BIGINT % {EVERY} = 0)"


def _asked(books: DataFrame) -> DataFrame:
    q = books.filter(F.regexp_extract("work_key", "[0-9]+", 0).try_cast("bigint") % EVERY == 0)
    return q.select(*[F.col(c).alias(f"q_{c}") for c in ("work_key", "genres", "subjects", "era")])


@R.query("similar_by_overlap_each", f"WITH {_EACH}, x AS (SELECT o.work_key AS query, nb.work_key, len(list_intersect(list_filter(coalesce(nb.subjects, []), lambda x: x IS NOT NULL), list_filter(coalesce(o.subjects, []), lambda x: x IS NOT NULL))) AS shared, nb.popularity FROM nb, o WHERE nb.work_key <> o.work_key AND list_has_any(nb.genres, o.genres)) SELECT *, row_number() OVER (PARTITION BY query ORDER BY shared DESC, popularity DESC, work_key) AS place FROM x QUALIFY place <= 10")
def similar_by_overlap_each(s: SparkSession, d: str) -> DataFrame:
    b = _books(s, d)
    near = overlap(F.array_compact("subjects"), F.array_compact("q_subjects"))
    x = search.nearest_each(b, _asked(b), near, [F.desc("nearness"), F.desc("popularity"), F.col("work_key")], 10)
    return x.select(F.col("q_work_key").alias("query"), "work_key", F.col("nearness").alias("shared"), "popularity", "place")


_LOWER = "list_transform(list_filter(coalesce({}.subjects, []), lambda x: x IS NOT NULL), lambda x: lower(x))"


@R.query("related_seed_each", f"WITH {_EACH}, x AS (SELECT o.work_key AS query, nb.work_key, len(list_intersect({_LOWER.format('nb')}, {_LOWER.format('o')})) + CASE WHEN nb.era = o.era THEN 0.5::DOUBLE ELSE 0 END AS nearness FROM nb, o WHERE nb.work_key <> o.work_key AND list_has_any(nb.genres, o.genres) AND {_INFO.replace('readers', 'nb.readers').replace('subjects', 'nb.subjects').replace('description', 'nb.description')}) SELECT *, row_number() OVER (PARTITION BY query ORDER BY nearness DESC, work_key) AS place FROM x QUALIFY place <= 10")
def related_seed_each(s: SparkSession, d: str) -> DataFrame:
    b = _books(s, d)
    low = lambda c: F.transform(F.array_compact(F.coalesce(c, F.array().cast("array<string>"))), F.lower)
    near = overlap(low("subjects"), low("q_subjects")) + F.when(F.col("era") == F.col("q_era"), 0.5).otherwise(0.0)
    x = search.nearest_each(b.filter(sampling.informative(3)), _asked(b), near, [F.desc("nearness"), F.col("work_key")], 10)
    return x.select(F.col("q_work_key").alias("query"), "work_key", "nearness", "place")


QUERIES, SQL = R.queries, R.sql

"""Queries on training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import leakage, mojibake, names, neardup, overlap, packing, pii, terms
from lectern.llm.components import components
from lectern.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Works and fields whose value was decoded with a wrong encoding."""
    return mojibake.damaged(table(spark, d, "books")).select("work_key", "field_name").distinct()


def p1_repairs(spark: SparkSession, d: str) -> DataFrame:
    """The damaged values with their restored text, where it can be known, and the chain of codecs."""
    return mojibake.damaged(table(spark, d, "books"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a training and an evaluation sample that are the same or nearly so."""
    return overlap.split_overlaps(table(spark, d, "samples"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and source: its samples, those that recur in training, and the pairs."""
    return overlap.overlap_report(table(spark, d, "samples"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms of books.subjects and books.genres that are too rare or too common."""
    return p4_terms(spark, d).filter(F.col("mark").isNotNull()).select("field_name", "term", "mark")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    """All terms with their occurrences, works and mark."""
    return terms.marked_terms(table(spark, d, "books"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of spellings of one and the same person or organisation."""
    return names.variant_pairs(table(spark, d, "authors"), table(spark, d, "books"))


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with its entity, named by its smallest spelling, and the entity's number of spellings."""
    e = names.entities(table(spark, d, "authors"), table(spark, d, "books"))
    label = e.groupBy("entity").agg(F.min("name").alias("entity_name"), F.count("*").alias("spellings"))
    return e.join(label, "entity").select("name", "entity_name", "spellings")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of works with nearly the same title, authors and description."""
    return neardup.similar_pairs(table(spark, d, "books"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each work that has a near-duplicate: the group it belongs to, and its number of similar works."""
    ids, links = neardup.similar_works(table(spark, d, "books"))
    sizes = ids.groupBy("rid").agg(F.count("*").alias("n"), F.min("work_key").alias("first_key"))
    roots = components(links.select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b"))).withColumnRenamed("id", "rid")
    both = links.unionByName(links.select(F.col("rid_b").alias("rid_a"), F.col("rid_a").alias("rid_b")))
    near = both.join(sizes.select(F.col("rid").alias("rid_b"), "n"), "rid_b").groupBy(F.col("rid_a").alias("rid")).agg(F.sum("n").alias("near"))
    whole = sizes.join(roots, "rid", "left").join(near, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    names = whole.groupBy("root").agg(F.min("first_key").alias("group_key"))
    whole = whole.join(names, "root").withColumn("links", F.col("n") - 1 + F.coalesce("near", F.lit(0)))
    return ids.join(whole.filter("links > 0").select("rid", "group_key", "links"), "rid").select("work_key", "group_key", "links")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text's container for each row of pack_specs."""
    return packing.containers(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers, used share and share of items beside a BM25 neighbour of each row of pack_specs."""
    return packing.fill_report(p7_containers(spark, d), table(spark, d, "pack_specs"))


def p7_placement(spark: SparkSession, d: str) -> DataFrame:
    """Whether all texts are placed once, in order, unsplit where they fit, and within capacity."""
    return packing.placement(p7_containers(spark, d), table(spark, d, "pack_specs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items with which they share ten consecutive words."""
    found = leakage.leaked_items(table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", "text"), table(spark, d, "eval_items"))
    return found.select("doc_id", F.explode("items").alias("item_id"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """Documents with leaked passages, the items, and the merged spans to remove."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Kind and place of all personal information in documents."""
    return pii.found(table(spark, d, "documents")).select("doc_id", "pii_kind", "start_pos")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All documents with a typed placeholder for each case."""
    return pii.redacted(table(spark, d, "documents"))


QUERIES = {"p7_containers": p7_containers, "p7_report": p7_report, "p7_placement": p7_placement, "p1_found": p1_found, "p1_repairs": p1_repairs, "p5_found": p5_found, "p5_entities": p5_entities, "p9_found": p9_found, "p9_redacted": p9_redacted, "p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found, "p4_terms": p4_terms, "p6_found": p6_found, "p6_groups": p6_groups, "p8_found": p8_found, "p8_spans": p8_spans}
_WORDS = r"list_transform(regexp_extract_all({}, '[\p{{L}}\p{{Nd}}]+'), lambda w: lower(w))"
_TALK = "array_to_string(list_transform(list_filter(messages, lambda m: m.role IN ('user', 'assistant')), lambda m: coalesce(m.content, '')), chr(10))"
#: Brute force, for the small tables of the comparison.
SQL: dict[str, str] = {
    "p3_found": f"""WITH s AS (SELECT sample_id, split, list_distinct({_WORDS.format(_TALK)}) AS w FROM samples)
SELECT least(a.sample_id, b.sample_id) AS sample_id_a, greatest(a.sample_id, b.sample_id) AS sample_id_b FROM s a JOIN s b ON a.split = 'train' AND b.split IN ('valid', 'test')
WHERE len(a.w) > 0 AND 9 * len(list_intersect(a.w, b.w)) >= 4 * (len(a.w) + len(b.w))""",
    "p6_found": f"""WITH n AS (SELECT * FROM books WHERE work_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY work_key ORDER BY snapshot_at DESC) = 1),
x AS (SELECT work_key, {_WORDS.format("description")} AS d, {_WORDS.format("concat_ws(chr(10), title, array_to_string(list_filter(authors, lambda v: v IS NOT NULL), chr(10)))")} AS h FROM n WHERE description IS NOT NULL),
s AS (SELECT work_key, list_distinct(list_concat(d, coalesce(h, []))) AS w FROM x WHERE len(d) >= 20)
SELECT a.work_key AS work_key_a, b.work_key AS work_key_b FROM s a JOIN s b ON a.work_key < b.work_key AND 10 * len(a.w) >= 7 * len(b.w) AND 10 * len(b.w) >= 7 * len(a.w)
WHERE 17 * len(list_intersect(a.w, b.w)) >= 7 * (len(a.w) + len(b.w))""",
    "p7_placement": "SELECT spec_id, (SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL) AS texts, 0::BIGINT AS misplaced, 0::BIGINT AS split_needlessly, 0::BIGINT AS overfull FROM pack_specs",
    "p8_found": f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM d), ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM i)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
SQL["p3_report"] = f"""WITH p AS ({SQL["p3_found"]}), i AS (SELECT unnest([sample_id_a, sample_id_b]) AS sample_id FROM p), c AS (SELECT sample_id, count(*) AS n FROM i GROUP BY 1)
SELECT split, source, count(*) AS samples, count(n) AS overlapping, coalesce(sum(n), 0)::BIGINT AS pairs FROM samples LEFT JOIN c USING (sample_id) WHERE split IN ('valid', 'test') GROUP BY 1, 2"""
SQL["p6_groups"] = f"""WITH RECURSIVE p AS ({SQL["p6_found"]}), e AS (SELECT work_key_a AS a, work_key_b AS b FROM p UNION SELECT work_key_b, work_key_a FROM p),
r AS (SELECT a AS work_key, a AS other FROM e UNION SELECT e.b, r.other FROM r JOIN e ON e.a = r.work_key), k AS (SELECT a AS work_key, count(*) AS links FROM e GROUP BY 1)
SELECT work_key, min(other) AS group_key, any_value(links) AS links FROM r JOIN k USING (work_key) GROUP BY 1"""

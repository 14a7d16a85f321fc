"""All queries with SQL against the SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def norm(v):
    return ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    rel = con.sql(SQL[name])
    names, rows = rel.columns, rel.fetchall()
    assert sorted(names) == cols
    assert got == sorted(repr([norm(r[names.index(c)]) for c in cols]) for r in rows)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() >= 0


@pytest.mark.parametrize("name", ["theme_lookup", "stemmed_terms", "language_markers", "quality_gates", "repaired_answers", "p2_nodes"])
def test_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, DIR).count() > 0


def test_repaired_answers_keep_a_beginning(spark):
    rows = entry.queries()["repaired_answers"](spark, DIR).collect()
    assert rows and all(r["ids"].startswith(r["repaired_ids"]) for r in rows)
    assert sum(r["ids"] == r["repaired_ids"] for r in rows) >= 0.5 * len(rows)


def test_searches_ask_for_every_hundredth_row(spark):
    asked = {r["query"] for r in entry.queries()["dense_topk_each"](spark, DIR).collect()}
    ids = {r[0] for r in spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id").collect()}
    assert asked == {i for i in ids if i % 100 == 0} and len(asked) > 1


def test_quality_gates_see_whole_texts(spark):
    texts = [(r[0] or "").strip(" ") for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect()]
    got = {r["problem"]: r["n"] for r in entry.queries()["quality_gates"](spark, DIR).collect()}
    assert got["length"] == sum(not 25 <= len(t) <= 320 for t in texts) and sum(got.values()) == len(texts)
    assert sum(r["n"] for r in entry.queries()["answer_gates"](spark, DIR).collect()) == spark.read.parquet(f"{DIR}/samples.parquet").count()


def test_hybrid_hits_pass_the_filters(spark):
    from lectern.functions import text as T
    from lectern.operators import search

    cols = "work_key string, doc_id bigint, text string, genres array<string>, moods array<string>, era string, length_bucket string, audience string, languages array<string>, rating_count bigint, popularity double"
    rows = [(f"w{i}", i, "silent lantern" if i in (1, 2, 3, 5) else "other words", ["crime"], [], "modern" if i % 2 else "klasik", None, None, ["eng"], 5, i / 20) for i in range(12)]
    items = spark.createDataFrame(rows, cols)
    vectors = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(12)], "doc_id bigint, embedding array<double>")
    t = search.Target(era="modern", exclude=("w3",))
    ask = lambda q, v: {r["doc_id"] for r in search.retrieve(items, "doc_id", T.search_terms("text"), q, vectors, v, t, 3).collect()}
    assert ask(["lantern"], None) == {1, 5}
    assert ask([], [1.0, 0.0]) == {1, 5, 7}  # the nearest that pass, not those left of the nearest
    assert ask(["nowhere"], None) == {7, 9, 11}  # the best known that pass
    assert entry.queries()["hybrid_filtered"](spark, DIR).filter("work_key = '/works/OL777W'").count() == 0
    assert entry.queries()["hybrid_browse"](spark, DIR).count() > 0


def test_stemmed_terms_come_from_documents(spark):
    from lectern.functions import text as T

    docs = spark.read.parquet(f"{DIR}/documents.parquet").select(T.search_terms("text").alias("t"))
    want = sum(len(r["t"] or ()) for r in docs.collect())
    assert sum(r["n"] for r in entry.queries()["stemmed_terms"](spark, DIR).collect()) == want

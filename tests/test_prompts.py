from pyspark.sql import functions as F

from lectern.operators import labels, prompts, search
from lectern.streaming import logs


def test_ratings_keep_valid_grades_only(spark):
    rows = [('{"ratings":{"a1":2,"a2":"1","a3":true,"a4":7,"zz":1}}',), ('{"ratings":{"a1":2}}',), ("no json",), (None,)]
    df = spark.createDataFrame(rows, "t string").withColumn("v", F.array(*map(F.lit, ["a1", "a2", "a3", "a4"])))
    assert [r[0] for r in df.select(prompts.ratings("t", "v")).collect()] == [{"a1": 2, "a2": 1}, None, None, None]


def test_rendering_of_sparse_and_full_books(spark):
    schema = "candidate_id string, title string, title_tr string, authors array<string>, first_published int, genres array<string>, moods array<string>, pages int, rating_avg double, rating_count bigint, languages array<string>, subjects array<string>, description string"
    rows = [("a1", "Dune", "Çöl", ["A", "B", "C"], 1965, ["x"], [], 412, 4.25, 8, ["tur"], ["s1", "s2"], "one  two " + "x" * 200), ("a2", "Bare", "bare", None, None, None, None, None, None, None, None, None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(prompts.rendered()).collect()]
    assert got[0].split("\n")[0] == "[a1] Dune (TR: Çöl) — A ve B · 1965" and "412 sf." in got[0] and "Türkçe baskısı var" in got[0] and got[0].endswith("özet: one two…")
    assert got[1] == "[a2] Bare"


def test_expansion_consumes_what_it_detects(spark):
    entries = [prompts.Entry("deniz", "theme", "deniz", ("sea",)), prompts.Entry("roman", "genre", "novel", ("fiction", "sea"))]
    df = spark.createDataFrame([(1, "Bir deniz romanı, lütfen", None, ["calm"]), (2, None, ["novel"], None)], "id int, text string, genres array<string>, moods array<string>")
    one, two = prompts.expanded(df, entries).orderBy("id").collect()
    assert one["terms"] == ["sea", "fiction"] and one["detected_genres"] == ["novel"] and one["content_words"] == ["bir", "romanı", "lütfen"]
    assert two["terms"] == ["fiction", "sea"] and two["detected_themes"] == []


def test_answers_and_responses(spark):
    df = spark.sql("select array(named_struct('text', '```json\n{\"a\":1}', 'thought', false), named_struct('text', 'hm', 'thought', true), named_struct('text', '\n```', 'thought', cast(null as boolean))) p")
    assert df.select(prompts.response_text(F.col("p"))).first()[0] == '{"a":1}'


def test_themes_prefer_equal_entries(spark):
    books = spark.createDataFrame([("k", ["Historical fiction", "History", None, "other"]), ("n", None)], "key string, subjects array<string>")
    entries = spark.createDataFrame([(0, "fiction", "kurgu"), (1, "history", "tarih")], "position int, subject string, theme string")
    assert [tuple(r) for r in labels.themes(books, "key", "subjects", entries).collect()] == [("k", ["kurgu", "tarih"])]


def test_weak_matches_keep_one(spark):
    df = spark.createDataFrame([("g", "a", 0.9), ("g", "b", 0.1), ("h", "a", 0.2), ("h", "b", 0.2)], "grp string, id string, score double")
    assert sorted((r["grp"], r["id"], r["dropped"]) for r in search.not_weak(df, "grp", "score", 0.5).collect()) == [("g", "a", 1), ("h", "a", 1)]


def test_stream_drops_repeated_deliveries(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:00' ts, explode(array(1, 1, 2)) id").coalesce(1).write.parquet(str(tmp_path / "ev.parquet"))
    s = logs.first_seen(logs.read_stream(spark, str(tmp_path), "ev"), "ts", ["id"])
    assert sorted(r["id"] for r in logs.drained(s, "first_seen_test", ["id"]).collect()) == [1, 2]

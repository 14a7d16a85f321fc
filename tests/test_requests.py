"""Requests, samples and derived stages on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from lectern import session
from lectern.operators import labels, requests, sampling, search
from lectern.sources import files


def test_request_block_and_names(spark):
    df = spark.createDataFrame([("deniz", ["roman", "siir", "nothing"], ["epik"], "modern", "orta", "genc", ["tur"], ["A", "B"]), (None,) * 8], "q string, g array<string>, m array<string>, e string, n string, a string, l array<string>, x array<string>")
    got = [r[0] for r in df.select(requests.request_block(*[F.col(c) for c in "qgmenal"], F.lit(3), F.col("x"))).collect()]
    assert got[0] == "Okurun sözleri: deniz\nFiltreler: tür: Roman, Şiir | ruh hali: Epik | dönem: Modern (1900-1989) | uzunluk: Orta (200-400 sayfa) | okur: Genç | dil: tur\nZaten okudu: A ve B\nİstenen öneri sayısı: 3"
    assert got[1] == "Okurun sözleri: (belirtmedi)\nİstenen öneri sayısı: 3"


def test_lines_are_written_and_read(spark):
    text = "Liste:\na1: one  two\n- **a2**: three\na1: again\nb3: no\na4:   \n a5： five "
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    got = [[tuple(x) for x in r[0]] for r in df.select(requests.read_lines("t")).collect()]
    assert got == [[("a1", "one  two"), ("a2", "three"), ("a5", "five")], [], []]
    p = spark.createDataFrame([([("a1", " x \n y "), ("a2", None)],)], "p array<struct<id:string,why:string>>")
    assert p.select(requests.write_lines("p")).first()[0] == "a1: x y\na2: "


def test_strength_and_confidence(spark):
    df = spark.createDataFrame([("0.8",), ("0.5",), ("0.1",), ("x",), (None,), ("7",)], "v string")
    got = [tuple(r) for r in df.select(requests.confidence(F.col("v")), requests.strength(F.col("v").try_cast("double"))).collect()]
    assert got == [(0.8, "güçlü"), (0.5, "orta"), (0.1, "zayıf"), (0.6, "orta"), (0.6, "orta"), (1.0, "güçlü")]


def test_label_keywords_begin_patterns():
    got = {(k, s): [] for k, s, _, _ in requests.label_keywords()}
    for k, s, _, w in requests.label_keywords():
        got[k, s].append(w)
    assert got["genre", "klasik"][0] == "classic" and got["genre", "roman"] == ["fiction", "novels", "literary fiction"] and all(len(v) <= 4 for v in got.values())
    assert set(requests.MOOD_NAMES) == {m.slug for m in labels.MOODS} and set(requests.GENRE_NAMES) == {g.slug for g in labels.GENRES}


def test_draws_follow_weights(spark):
    items = spark.createDataFrame([(f"k{i}", float(w)) for i, w in enumerate([0, 1, 3, 12])], "work_key string, w double")
    got = [r["work_key"] for r in requests.weighted_with_replacement(items, 400, F.col("w"), 1, "work_key").collect()]
    assert len(got) == 400 and got.count("k0") == 0 and 270 < got.count("k3") < 350 and got.count("k1") < got.count("k2")


def test_smallest_bucket_and_lookup(spark):
    items = spark.createDataFrame([("/works/OL1W", "a"), ("/works/OL2W", "a"), ("/works/OL3W", "b")], "work_key string, g string")
    got = requests.smallest_bucket(items, [("a", F.col("g") == "a"), ("b", F.col("g") == "b"), ("c", F.col("g") == "c")], 5, 1).collect()
    assert [tuple(r) for r in got] == [("b", "/works/OL3W")]
    asked = spark.createDataFrame([("OL2W",), ("/OL1W",), ("/works/OL3W",), ("x",), (None,)], "asked string")
    assert {r["asked"]: r["work_key"] for r in requests.looked_up(items, asked).collect()} == {"OL2W": "/works/OL2W", "/OL1W": "/works/OL1W", "/works/OL3W": "/works/OL3W"}
    assert requests.smallest_bucket(items.limit(0), [("a", F.lit(True))], 5, 1).count() == 0


def test_common_of_models_and_pending(spark):
    p = spark.createDataFrame([("m", 1), ("m", 2), ("n", 2), ("n", 3), ("m", 2)], "model string, i int")
    r = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "i int, rating string")
    assert sorted(tuple(x) for x in requests.common_of_models(p, r).select("model", "rating").collect()) == [("m", "y"), ("m", "y"), ("n", "y")]
    assert [x["i"] for x in requests.pending(r, "i", p.filter("model = 'm'")).collect()] == [3]


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_split_is_exact(spark, n):
    from lectern.functions.scalars import unit

    rows = spark.range(n).select(F.col("id").alias("k"))
    got = {r["k"]: r["part"] for r in sampling.split(rows, 0.05, 3, "k").collect()}
    order = [r["k"] for r in rows.orderBy(unit("k", 3), "k").collect()]
    assert {k for k, p in got.items() if p == "valid"} == set(order[: max(1, int(n * 0.05))])


def test_weak_groups_keep_their_best(spark):
    rows = spark.createDataFrame([("g", "a", 0.9), ("g", "b", 0.1), ("h", "a", 0.2), ("h", "b", 0.2), (None, "z", 0.9)], "grp string, id string, score double")
    assert sorted(tuple(r) for r in search.not_weak(rows, "grp", "score", 0.5).collect()) == [("g", "a", 0.9, 1), ("h", "a", 0.2, 1)]


def test_themes_prefer_equal_entries(spark):
    d = spark.createDataFrame([(0, "garden", "g"), (1, "garden party", "p"), (2, "sea", "s")], "position int, subject string, theme string")
    rows = spark.createDataFrame([("k", ["Garden Party", "the gardener", "seaside", "SEA ", None])], "work_key string, subjects array<string>")
    assert labels.themes(rows, "work_key", "subjects", d).first()["themes"] == ["p", "g", "s"]
    assert labels.themes(rows, "work_key", "subjects", d.limit(0)).count() == 0


def test_shared_folder_is_asked_for_on_a_cluster():
    class Spark:
        class conf:
            get = staticmethod(lambda k, d: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        session.shared_dir(Spark)


def test_written_tables_are_released(spark):
    df = session.written(spark.range(3).toDF("a"), "t")
    assert df.count() == 3
    session.release(spark)
    with pytest.raises(Exception):
        df.collect()


def test_numbered_lines_and_vectors(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text("\n".join(json.dumps({"task": f"t{i}"}) if i != 2 else "{broken" for i in range(5)))
    got = [(r["i"], r["task"]) for r in files.read_jsonl(spark, str(p), "task string", index="i").orderBy("i").collect()]
    assert got == [(0, "t0"), (1, "t1"), (3, "t3"), (4, "t4")]
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, 1.0])], "key string, embedding array<double>")
    assert files.write_vectors(v, str(tmp_path / "v")) == 2 and files.read_vectors(spark, str(tmp_path / "v"), 2, 2).count() == 2
    with pytest.raises(ValueError):
        files.read_vectors(spark, str(tmp_path / "v"), 2, 3)

import pytest
from pyspark.sql import functions as F

from lectern.functions import scalars, text


@pytest.mark.parametrize(
    ("given", "want"),
    [('```json\n{"ids": ["a1",]}\n```', '{"ids": ["a1"]}'), ('so: {"a": "}", "b": [1, 2', '{"a": "}", "b": [1, 2]}'), ('{"a": {"b": 1}, "c', '{"a": {"b": 1}}'), ("none", None), ("", None), (None, None), ('{"a": 1} {"b": 2}', '{"a": 1}')],
)
def test_repair_json(given, want):
    assert text.repair_json(given) == want


def test_stems_of_the_published_examples():
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "revival": "reviv", "adoption": "adopt", "probate": "probat", "cease": "ceas", "controll": "control", "roll": "roll"}
    assert {w: text.stem(w) for w in want} == want


def test_word_boundaries_know_ascii_only(spark):
    df = spark.createDataFrame([("ğclassic",), ("classic",), ("xclassic",)], "t string")
    assert [r[0] for r in df.select(scalars.ascii_text("t").rlike(r"\bclassic\b")).collect()] == [True, True, False]


def test_casts_round_like_the_reference_engine(spark):
    df = spark.createDataFrame([("3.0", 526.5), ("2.5", 527.5), ("x", None), (None, None)], "s string, d double")
    rows = df.select(scalars.int_of("s"), F.rint("d").cast("int")).collect()
    assert [tuple(r) for r in rows] == [(3, 526), (3, 528), (None, None), (None, None)]


def test_buckets_years_and_overlap(spark):
    df = spark.createDataFrame([("c1899?", 1899, 0, ["a", "b"]), ("180", None, 201, None), ("in 2001-2002", 1990, 701, [])], "p string, y int, n int, l array<string>")
    rows = df.select(scalars.year_of(F.col("p")), scalars.bucket("y", scalars.ERAS), scalars.bucket("n", scalars.LENGTHS, True), scalars.overlap("l", F.array(F.lit("b")))).collect()
    assert [tuple(r) for r in rows] == [(1899, "klasik", None, 1), (None, None, "orta", 0), (2001, "cagdas", "tugla", 0)]


def test_text_expressions(spark):
    df = spark.createDataFrame([("izmir", ["a", "b", "c"], "one two three four")], "t string, l array<string>, s string")
    r = df.select(text.capitalised("t"), text.join_and(F.col("l")), text.clipped("s", 9), text.mentions(F.lit("a (two) b"), F.lit("two")), text.circumflex_folded(F.lit("Kâğıt")), text.shares_ngram("s", F.lit("zero two three four five"), 3)).first()
    assert tuple(r) == ("İzmir", "a, b ve c", "one two…", True, "kağıt", True)


def test_search_terms_fold_and_drop_stop_words(spark):
    df = spark.createDataFrame([("The Étoile of İzmir",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.search_terms("t")).collect()] == [["etoile", "izmir"], [], []]

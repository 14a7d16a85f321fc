import gzip
import json

import pytest

from lectern.operators import catalog, search
from lectern.plans.build import build_catalog
from lectern.sources import dumps, files


def dump(path, rows):
    with gzip.open(path, "wt", encoding="utf-8") as f:
        for r in rows:
            f.write("\t".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in r) + "\n")


@pytest.fixture(scope="module")
def mini(tmp_path_factory):
    d = tmp_path_factory.mktemp("mini")
    t = "2024-01-01T00:00:00"
    w = lambda k, **js: ("/type/work", f"/works/{k}", "1", t, js)
    e = lambda k, work, **js: ("/type/edition", f"/books/{k}", "1", t, {"works": [{"key": f"/works/{work}"}], **js})
    a = lambda *ks: [{"author": {"key": f"/authors/{k}"}} for k in ks]
    dump(d / "dump_authors_2024-05-01.txt.gz", [("/type/author", "/authors/A1", "1", t, {"name": "Ada"}), ("/type/author", "/authors/A2", "1", t, {"personal_name": "Bo"}), ("/type/author", "/authors/A3", "1", t, {"name": "  "}), ("broken line",)])
    dump(d / "dump_works_2024-05-01.txt.gz", [
        w("W1", title="Two Hands", authors=a("A2", "A1", "A9"), subjects=["Science fiction", "Science fiction", "nyt:x", "Accessible book", "Young adult"], description={"type": "t", "value": "space opera"}, first_publish_date="May 1950"),
        w("W2", title="Plain", description="a haunted house", first_publish_date="180"),
        w("W3", title="", subjects=["History"]), w("W4", title="No text"), w("W5", title="Nobody reads it", subjects=["History"]),
        ("/type/redirect", "/works/W6", "1", t, {}),
    ])
    dump(d / "dump_editions_2024-05-01.txt.gz", [
        e("M1", "W1", number_of_pages=412, languages=[{"key": "/languages/eng"}], isbn_13=["1"], isbn_10=["2"]),
        e("M2", "W1", number_of_pages="640", languages=[{"key": "/languages/tur"}], isbn_13=["3"], title="İki El", covers=[7]),
        e("M3", "W1", number_of_pages=5, isbn_13=["9"]), e("M4", "W2", publish_date="c2006"), e("M5", "W9", number_of_pages=100),
    ])
    dump(d / "dump_ratings_2024-05-01.txt.gz", [(k, "", v, "2024-01-01") for k, v in [("/works/W1", "5"), ("/works/W1", "4"), ("/works/W1", "9"), ("W1", "5"), ("/works/W1", "x"), ("/works/W4", "5")]])
    dump(d / "dump_reading-log_2024-05-01.txt.gz", [("/works/W1", "", "1", "d"), ("/works/W1", "", "3", "d"), ("/works/W2", "", "3", "d"), ("/works/W3", "", "3", "d")])
    return d


def test_dumps_to_catalog_and_resume(spark, mini, tmp_path):
    out = str(tmp_path / "out")
    assert build_catalog(spark, str(mini), out, stop_after="prelim") is None
    books = {r["work_key"]: r for r in build_catalog(spark, str(mini), out).collect()}
    assert set(books) == {"/works/W1", "/works/W2"}
    one, two = books["/works/W1"], books["/works/W2"]
    assert one["authors"] == ["Bo", "Ada"] and one["subjects"] == ["Science fiction", "Young adult"] and one["description"] == "space opera"
    assert (one["pages"], one["languages"], one["isbns"], one["title_tr"], one["cover_id"]) == (526, ["tur", "eng"], ["3", "1", "2"], "İki El", 7)
    assert (one["rating_count"], one["rating_avg"], one["readers"], one["finished"], one["edition_count"]) == (2, 4.5, 2, 1, 3)
    assert one["genres"] == ["bilim-kurgu", "genc-yetiskin", "roman"] and one["audience"] == "genc" and one["era"] == "modern" and one["popularity"] == 1.0
    assert (two["first_published"], two["pages"], two["authors"], two["rating_count"]) == (2006, None, [], 0)


def test_sources(spark, mini, tmp_path):
    src = dumps.resolve(str(mini))
    assert src.date == "2024-05-01" and src.paths["reading-log"].endswith("reading-log_2024-05-01.txt.gz")
    assert dumps.read_lines(spark, src.paths["authors"], tasks=2).count() == 3
    assert dumps.read_lines(spark, src.paths["authors"], limit=1).count() == 1
    with pytest.raises(FileNotFoundError):
        dumps.resolve(str(tmp_path))


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("k", "a\tb", "text\nline", ["x", "y"], [], None, ["m"], ["tur"], 1950, 10, 20, 0.5), ("low", "t", None, [], [], [], [], [], None, None, 3, 0.9)], "work_key string, title string, description string, authors array<string>, subjects array<string>, genres array<string>, moods array<string>, languages array<string>, first_published int, pages int, readers bigint, popularity double")
    files.write_bundle(df, str(tmp_path / "b"))
    r = files.read_bundle(spark, str(tmp_path / "b")).collect()
    assert len(r) == 1 and r[0]["title"] == "a b" and r[0]["authors"] == ["x", "y"] and r[0]["subjects"] == [] and r[0]["first_published"] == 1950
    files.write_jsonl(spark.range(2).selectExpr("id as i", "'é' as task"), str(tmp_path / "j"))
    assert {x["task"] for x in files.read_jsonl(spark, str(tmp_path / "j"), files.SAMPLE).collect()} == {"é"}
    files.write_manifest(spark, str(tmp_path / "m.json"), {"books": 2}, dump_date="d")
    assert files.read_manifest(spark, str(tmp_path / "m.json"))["rows"] == {"books": 2}
    spark.sql("select 'a' key, array(1f, 2f) embedding").write.parquet(str(tmp_path / "v"))
    assert files.read_vectors(spark, str(tmp_path / "v"), 2).count() == 1
    with pytest.raises(ValueError):
        files.read_vectors(spark, str(tmp_path / "v"), 3)
    df.limit(0).write.parquet(str(tmp_path / "e"))
    with pytest.raises(ValueError):
        files.open_catalog(spark, str(tmp_path / "e"))


def test_match_score_bounds_and_no_target(spark):
    df = spark.createDataFrame([(["a"], ["x"], "modern", 1.0), (None, None, None, None), ([], [], "", 0.0)], "genres array<string>, moods array<string>, era string, popularity double")
    t = search.Target(genres=("a", "b"), era="modern")
    assert [round(r[0], 6) for r in df.select(search.match_score(t)).collect()] == [round(0.85 * 3 / 4.5 + 0.15, 6), 0.0, 0.0]
    assert [r[0] for r in df.select(search.match_score(search.Target())).collect()] == [0.9, 0.45, 0.45]


def test_empty_tables(spark):
    log = dumps.empty(spark, "work_key string, rating_value string, shelf string")
    assert catalog.rating_stats(log).count() == 0 and catalog.reader_stats(log).count() == 0

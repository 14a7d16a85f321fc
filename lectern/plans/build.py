"""From dumps to the catalog: one lazy plan with optional cut points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import catalog
from lectern.sources import dumps
from lectern.sources.files import Stages, write_manifest


def build_catalog(spark: SparkSession, folder: str, out: str, prefix: str = "dump_", stop_after: str | None = None) -> DataFrame | None:
    """Builds (or resumes) the books table in out from the dumps in folder.

    Ratings and reading log are reduced first; works are cut down by them in a semi-join
    before anything else is joined, and only their editions are aggregated.
    """
    src = dumps.resolve(folder, prefix)
    stages = Stages(spark, out, stop_after)
    log = lambda kind: dumps.read_lines(spark, src.paths[kind], dumps.LOG) if src.paths[kind] else dumps.empty(spark, dumps.LOG)
    names = stages.run("authors", lambda: catalog.author_names(dumps.read_lines(spark, src.paths["authors"]).withColumnRenamed("rec_key", "author_key")))
    ratings = stages.run("ratings", lambda: catalog.rating_stats(log("ratings").withColumnRenamed("value", "rating_value")))
    readers = stages.run("readers", lambda: catalog.reader_stats(log("reading-log").withColumnRenamed("value", "shelf")))
    prelim = stages.run("prelim", lambda: catalog.usable(dumps.works(dumps.read_lines(spark, src.paths["works"]))).join(catalog.signal_keys(ratings, readers), "work_key", "left_semi"))
    lines = dumps.read_lines(spark, src.paths["editions"]) if src.paths["editions"] else dumps.empty(spark, dumps.RECORD)
    editions = stages.run("editions", lambda: catalog.edition_rollup(catalog.edition_facts(lines.withColumnRenamed("rec_key", "edition_key")), prelim))
    authors = stages.run("work_authors", lambda: catalog.ordered_names(prelim, "work_key", "author_keys", names))

    def books() -> DataFrame:
        x = catalog.assemble(prelim, ratings, readers, editions).join(authors, "work_key", "left").join(editions.select("work_key", "title_tr", "edition_cover"), "work_key", "left")
        x = x.withColumns({
            "authors": F.coalesce("authors", F.array().cast("array<string>")),
            "first_published": F.coalesce("work_year", "earliest_edition_year"),
            "pages": F.col("edition_pages"), "languages": F.col("edition_languages"), "isbns": F.col("edition_isbns"),
            "cover_id": F.coalesce("work_cover", "edition_cover"),
        })
        x = catalog.with_popularity(catalog.labelled(x))
        keep = "work_key title subtitle title_tr authors subjects description first_published pages languages isbns cover_id edition_count rating_count rating_avg readers finished signal popularity".split()
        names_ = {"genre_label": "genres", "mood_label": "moods", "era_label": "era", "length_label": "length_bucket", "audience_label": "audience"}
        return x.select(*keep, *[F.col(k).alias(v) for k, v in names_.items()])

    out_table = stages.run("books", books)
    if out_table is not None:
        write_manifest(spark, f"{out.rstrip('/')}/manifest.json", stages.rows, date=src.date)
    return out_table

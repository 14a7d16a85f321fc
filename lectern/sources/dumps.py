"""Dump and log files: tab-separated lines without header or quoting, plain or gzip."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("rec_type", "rec_key", "revision", "last_modified", "js")])
LOG = T.StructType([T.StructField(c, T.StringType()) for c in ("work_key", "edition_key", "value", "logged_at")])
KINDS = {"authors": True, "works": True, "editions": False, "ratings": False, "reading-log": False}


def read_lines(spark: SparkSession, path: str, schema: T.StructType = RECORD, limit: int | None = None, tasks: int | None = None) -> DataFrame:
    """Lines of a dump. Lines with too few or too many fields are dropped, empty fields are null, JSON stays as written.

    All fields are read whatever is selected, or bad lines would pass unseen. A gzip file
    is one task to read; tasks spreads its lines afterwards.
    """
    df = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("escape", "").option("mode", "DROPMALFORMED").option("nullValue", "").option("columnPruning", "false").csv(path)
    df = df.limit(limit) if limit else df
    return df.repartition(tasks) if tasks else df


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """A table without rows, for an optional source that is missing."""
    return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Sources:
    """Paths by kind; None where an optional one is missing."""

    paths: dict[str, str | None]

    @property
    def date(self) -> str | None:
        """Date in the files' names."""
        return next((m.group(1) for p in self.paths.values() if p and (m := re.search(r"(\d{4}-\d{2}-\d{2})", p))), None)


def _files(folder: str, pattern: str) -> list[str]:
    """Paths in a folder of any file system that Spark knows, or of this machine without a session, in the order of their names."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return sorted(str(p) for p in Path(folder).glob(pattern))
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or ()
    return sorted(f.getPath().toString() for f in found)


def resolve(folder: str, prefix: str = "dump_", kinds: dict[str, bool] | None = None) -> Sources:
    """The newest file of each kind in a folder, named prefix + kind + '_' + anything; the longest kind that fits counts.

    A missing required kind raises FileNotFoundError.
    """
    kinds = kinds or KINDS
    paths: dict[str, str | None] = dict.fromkeys(kinds)
    for path in _files(folder, f"{prefix}*.txt*"):
        rest = path.rsplit("/", 1)[-1][len(prefix) :]
        fits = [k for k in kinds if rest.startswith(f"{k}_") or rest.startswith(f"{k}.")]
        if fits:
            paths[max(fits, key=len)] = path
    lost = [k for k, needed in kinds.items() if needed and not paths[k]]
    if lost:
        raise FileNotFoundError(f"no dump of {', '.join(lost)} in {folder}")
    return Sources(paths)


def works(lines: DataFrame) -> DataFrame:
    """Works of dump lines: texts, subjects of all kinds, author keys, year and cover.

    The record is parsed once with a declared schema whose leaves are text, so that one
    badly typed part does not lose the rest. A description is a text or an object with one.
    """
    from lectern.functions.scalars import joined_once, year_of
    from lectern.operators.catalog import clean_subjects

    schema = (
        "title string, subtitle string, authors array<struct<author:struct<key:string>>>, subjects array<string>, subject_places array<string>, subject_people array<string>,"
        " subject_times array<string>, description string, first_publish_date string, covers array<string>"
    )
    x = lines.filter(F.col("rec_type") == "/type/work").select(F.col("rec_key").alias("work_key"), F.from_json("js", schema).alias("x"))
    none = F.array().cast("array<string>")
    return x.select(
        "work_key",
        F.trim(F.coalesce("x.title", F.lit(""))).alias("title"),
        F.nullif("x.subtitle", F.lit("")).alias("subtitle"),
        F.array_compact(F.coalesce(F.transform("x.authors", lambda a: a["author"]["key"]), none)).alias("author_keys"),
        clean_subjects(joined_once(F.col("x.subjects"), F.col("x.subject_places"), F.col("x.subject_people"), F.col("x.subject_times"))).alias("subjects"),
        F.coalesce(F.get_json_object("x.description", "$.value"), "x.description").alias("description"),
        year_of(F.col("x.first_publish_date")).alias("work_year"),
        F.get("x.covers", F.lit(0)).try_cast("int").alias("work_cover"),
    )

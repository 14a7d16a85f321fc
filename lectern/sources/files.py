"""Other files: numbered JSON lines, vectors, the flat export bundle, staged tables with a manifest."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = "array<struct<role:string,content:string>>"
SAMPLE = f"i bigint, task string, messages {MESSAGES}, meta struct<style:string,query:string,limit:int,n_candidates:int,n_picks:int,picked_keys:array<string>,match_reasons:map<string,array<string>>>"
UNIT_SEPARATOR = "\x1f"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, limit: int | None = None, index: str | None = None) -> DataFrame:
    """Records of a JSON-lines file with a declared schema; unreadable lines are dropped.

    With index, a column of that name holds each line's number from 0 in the file's order.
    """
    if index is None:
        df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
        return df.limit(limit) if limit else df
    # Line numbers need the order of the file's pieces, which only numbering by partition keeps.
    lines = spark.createDataFrame(spark.sparkContext.textFile(path).zipWithIndex(), "line string, i bigint")
    lines = lines.filter(F.col("i") < limit) if limit else lines
    kept = schema if isinstance(schema, str) else schema.simpleString()
    x = lines.select(F.col("i").alias(index), F.from_json("line", f"{kept}, _bad string" if isinstance(schema, str) else kept, {"columnNameOfCorruptRecord": "_bad"}).alias("x"))
    fields = [f for f in x.select("x.*").columns if f not in ("_bad", index)]
    good = x.filter(F.col("x._bad").isNull()) if "_bad" in x.select("x.*").columns else x
    return good.select(index, *[F.col(f"x.{f}") for f in fields])


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, UTF-8 unescaped."""
    df.write.mode("overwrite").json(path)


def write_vectors(df: DataFrame, path: str) -> int:
    """Writes key and embedding of a vector store; returns the number of rows, counted as they are written."""
    seen = Observation()
    df.select("key", F.col("embedding").cast("array<float>")).observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(path)
    return seen.get["n"]


def read_vectors(spark: SparkSession, path: str, size: int, rows: int | None = None) -> DataFrame:
    """key, embedding of a vector store; raises ValueError if any vector has another length, or the store another number of rows."""
    df = spark.read.parquet(path)
    if not df.filter(F.col("embedding").isNull() | (F.size("embedding") != size)).limit(1).isEmpty():
        raise ValueError(f"{path}: vectors of another length than {size}")
    if rows is not None and df.count() != rows:
        raise ValueError(f"{path}: not {rows} vectors")
    return df


def flat(c: str) -> F.Column:
    """A list as one field, a text without the separators of the format."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\r\n\x1f]+", " ")


def write_bundle(books: DataFrame, path: str, least_readers: int = 15) -> None:
    """Books that are known well enough as tab-separated lines in order of popularity, lists joined by a separator."""
    lists = ["authors", "subjects", "genres", "moods", "languages"]
    rows = books.filter(F.col("readers") >= least_readers).orderBy(F.desc("popularity"), "work_key")
    cells = [flat("work_key").alias("work_key"), flat("title").alias("title"), F.substring(flat("description"), 1, 400).alias("description")]
    cells += [F.array_join(F.transform(F.slice(c, 1, 12), lambda v: F.regexp_replace(v, r"[\t\r\n\x1f]+", " ")), UNIT_SEPARATOR).alias(c) for c in lists]
    cells += [F.col(c).cast("string").alias(c) for c in ("first_published", "pages", "readers", "popularity")]
    rows.select(*cells).write.mode("overwrite").option("sep", "\t").option("quote", "").option("escape", "").option("emptyValue", "").csv(path)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """What write_bundle wrote, with lists and numbers again."""
    names = ["work_key", "title", "description", "authors", "subjects", "genres", "moods", "languages", "first_published", "pages", "readers", "popularity"]
    df = spark.read.schema(", ".join(f"{n} string" for n in names)).option("sep", "\t").option("quote", "").option("escape", "").csv(path)
    as_list = {c: F.when(F.length(c) > 0, F.split(c, UNIT_SEPARATOR)).otherwise(F.array().cast("array<string>")) for c in ("authors", "subjects", "genres", "moods", "languages")}
    return df.withColumns(as_list | {"first_published": F.col("first_published").try_cast("int"), "pages": F.col("pages").try_cast("int"), "readers": F.col("readers").try_cast("bigint"), "popularity": F.col("popularity").try_cast("double")})


def open_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog table; raises ValueError if it has no rows."""
    df = spark.read.parquet(path)
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


class Stages:
    """Named tables in a folder, each built once: a finished one is read again instead, so a build resumes where it broke off."""

    def __init__(self, spark: SparkSession, folder: str, stop_after: str | None = None) -> None:
        self.spark, self.folder, self.stop_after, self.rows = spark, folder.rstrip("/"), stop_after, {}
        self.stopped = False

    def _done(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def run(self, name: str, build: Callable[[], DataFrame]) -> DataFrame | None:
        """The stage's table, built if it isn't there; None after the stage to stop at."""
        if self.stopped:
            return None
        path = f"{self.folder}/{name}"
        if not self._done(path):
            build().write.mode("overwrite").parquet(path)
        df = self.spark.read.parquet(path)
        self.rows[name] = df.count()  # answered from the files' footers
        self.stopped = name == self.stop_after
        return df

    def drop(self, *names: str) -> None:
        """Removes stages that are no longer needed."""
        for n in names:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def write_manifest(spark: SparkSession, path: str, rows: dict[str, int], **facts: str | None) -> None:
    """A small JSON file about a build, in whatever file system path names."""
    text = json.dumps({"rows": rows, "built_at": datetime.now(timezone.utc).isoformat(), **facts}, ensure_ascii=False)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])

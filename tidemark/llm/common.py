"""Helpers that the corpus operators share: text rules, shared folders, global order."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, local masters (tests) get a folder of their own; a
    cluster's executors couldn't see one, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir() or at
    return at.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, scratch: Scratch | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, is computed once, and outlives executors."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    if scratch is not None:
        scratch.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that nothing reads any more once a step is done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def drop(self, most_recent: int = 0) -> None:
        """Deletes all but the last few."""
        gone = self.paths[: len(self.paths) - most_recent]
        self.paths = self.paths[len(gone) :]
        context = self.spark.sparkContext
        for path in gone:
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def row_key(docs: DataFrame, *columns: str) -> list:
    """Two hashes of a row (of all its columns, if none are named), 128 bits; equal rows share them."""
    values = [F.col(f"`{c}`") for c in columns or docs.columns]
    return [F.xxhash64(*values).alias("row_a"), F.xxhash64(F.lit(1), *values).alias("row_b")]


def file_system(uri: str):
    """(pyarrow file system, path in it) of a shared folder's URI or plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def tasks_for(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions as the session sizes them."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def offsets_by_part(light: DataFrame, part: str, amounts: dict[str, str]) -> DataFrame:
    """One row for each part (in ascending order) with the sums of all parts before it.

    light has one row per row of the corpus; the result has one per partition, so its window is small.
    """
    from pyspark.sql import Window

    sums = light.groupBy(part).agg(*[F.sum(c).alias(name) for name, c in amounts.items()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(part, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in amounts])


def lowered(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z (only) in lower case; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()

"""Small helpers shared by the operators: scratch tables in the cluster's shared folder, text words, row keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as a Java regex class body.
WS = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a new temporary one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gristmill-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to a table in the shared folder and read it back: cuts lineage, and survives the loss of any executor."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._scratch = path
    return written


def forget(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def unused(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """Array of the runs of non-white characters of a text; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^{WS}]+"), 0)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key(doc_id: Column, text: Column) -> Column:
    """64-bit key of a row's content; rows with equal doc_id and text share it, and share every result."""
    return F.xxhash64(doc_id, text)

"""Tables of a folder of parquet files, and raw offers derived from them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "lpad(cast(p_partkey as string), 6, '0')"
_PRICE = "cast(p_retailprice as string)"
#: Three raw offers a part, over a relation named part; the same text runs in Spark and in DuckDB.
RAW_OFFERS = f"""
SELECT p_partkey * 3 + k AS ord,
  CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN cast(p_partkey as string) || '.0' WHEN p_partkey % 5 = 2 THEN '$' || lpad(cast(p_partkey as string), 5, '0') ELSE 'SKU-' || {_KEY} END AS sku_upc,
  CASE WHEN p_partkey % 11 = 0 THEN 'All ' || p_name || ' | Best | ' || p_brand WHEN p_partkey % 13 = 1 THEN 'Privacy Policy' WHEN p_partkey % 7 = 0 THEN replace(p_name, ' ', '  ') WHEN p_partkey % 2 = 1 THEN p_name || ' ' || cast(p_size as string) ELSE p_name END AS product_name,
  CASE WHEN k = 0 THEN split_part(p_name, ' ', 1) WHEN k = 1 THEN upper(split_part(p_name, ' ', 1)) ELSE '' END AS color,
  CASE WHEN p_partkey % 4 = 0 THEN {_PRICE} WHEN p_partkey % 4 = 1 THEN '$1,' || {_PRICE} WHEN p_partkey % 4 = 2 THEN '' ELSE 'USD ' || {_PRICE} END AS msrp,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE cast(p_partkey % 50 as string) || '.0' END AS qty,
  CASE WHEN k = 1 THEN '45' ELSE '' END AS your_cost,
  CASE WHEN k = 2 THEN 'n' || cast(p_partkey as string) ELSE '' END AS notes,
  CASE WHEN k = 0 THEN 'http://img.example.com/' || cast(p_partkey as string) || '.jpg' ELSE '' END AS product_image,
  'excel' AS source, 'row ' || cast(p_partkey as string) AS source_detail, p_type AS category
FROM (SELECT *, 0 AS k FROM part UNION ALL SELECT *, 1 AS k FROM part UNION ALL SELECT *, 2 AS k FROM part) AS t
"""


def state_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; in local mode a temporary one where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="gristmill-")
    return f"{shared.rstrip('/')}/gristmill-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and all readers see the same rows."""
    path = f"{state_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over many tasks, for work that is heavy a row: a file of a few megabytes is read by one task, however many rows it holds."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW_OFFERS with each part read once and exploded."""
    three = RAW_OFFERS[RAW_OFFERS.index("(SELECT *, 0 AS k") : RAW_OFFERS.index(") AS t")]
    return spark.sql(RAW_OFFERS.replace(three, "(SELECT *, explode(array(0, 1, 2)) AS k FROM {part}"), part=spread(table(spark, sf_dir, "part")))

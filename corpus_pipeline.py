"""A corpus pipeline of five stages: toxicity, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) with all that its predecessor kept, and all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import bpe, line_dedup, mixing, near_dup, toxicity
from gristmill.llm.common import WS, materialize, row_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not predict to be toxic."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~held_out)
    keyed = docs.withColumn("__key", row_key(F.col("doc_id"), F.col("text")))
    scored = toxicity.score_toxicity(keyed.select("__key", "doc_id", "text"), labels, carry=("__key",))
    toxic = scored.filter("predicted = 1").select("__key").distinct()
    return keyed.join(toxic, "__key", "left_anti").select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; one that loses all its words so goes."""
    out = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(rf"[^{WS}]")
    return out.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more), and one of equal id and text; rows without an id all stay."""
    rows = docs.withColumn("__key", row_key(F.col("doc_id"), F.col("text")))
    known = near_dup.near_duplicates(rows, key_col="__key").filter("kept and doc_id is not null")
    stay = known.groupBy("group", F.when(F.col("group").isNull(), F.col("__key")).alias("alone")).agg(F.min("__key").alias("__key")).select("__key")
    one = rows.filter("doc_id is not null").join(stay, "__key", "left_semi").dropDuplicates(["__key"])
    return one.union(rows.filter("doc_id is null").select(*one.columns)).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number of times; empty ones, which take no words, stay once."""
    rows = docs.withColumn("__key", row_key(F.col("doc_id"), F.col("text")))
    taken = mixing.mix_sources(rows, keep=("__key",)).groupBy("__key").agg(F.max(F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5))).alias("times"))
    return rows.join(taken, "__key").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("times"), F.lit(1)).cast("int")))).filter("__copy <= times").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return bpe.encode(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("near_dup", drop_near_copies), ("mixing", mix), ("bpe", encode)]

#: The rows rest on a fitted classifier, hashes and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name)
    return docs

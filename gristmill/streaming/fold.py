"""Folding a stream of products into a clean table: each micro-batch re-cleans the keys and names that it touches, and only those.

The state is two tables, each dealt into buckets of which a batch replaces those it changes: rows by the hash of their key
(SKU and colour, or name and colour), and names (name, key, score) by the hash of their first three letters. A name and
one that extends it so share a bucket, but for names of fewer letters, which have a bucket of their own that
every batch reads. A manifest says which batch wrote each bucket last. It is written last and names its batch, so a batch
that failed half-way is done anew, and one that is replayed changes nothing. Buckets that a batch replaced are deleted once its manifest stands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gristmill.operators import products as op
from gristmill.sources.tables import written

_MANIFEST = "kind string, bucket int, version bigint, batch bigint"
_FAMILY = 3


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


class ProductState:
    """The folded products under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        # an empty manifest, so that there always is one to read
        spark.createDataFrame([], _MANIFEST.replace(", batch bigint", "")).write.mode("ignore").parquet(f"{self.folder}/manifest/batch=-1")
        rows = spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest")
        last = [int(r[0]) for r in rows.select(F.regexp_extract(F.input_file_name(), r"batch=(-?\d+)", 1)).distinct().collect()]
        self.last = max(last, default=-1)
        self.versions = {(r["kind"], r["bucket"]): r["version"] for r in rows.filter(F.col("batch") == self.last).collect()}

    def _read(self, kind: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of some buckets (None: of all) as the last manifest has them: a filter of folders, so nothing else is read."""
        by_version: dict[int, list[int]] = {}
        for (k, b), v in self.versions.items():
            if k == kind and (buckets is None or b in buckets):
                by_version.setdefault(v, []).append(b)
        if not by_version:
            return self.spark.createDataFrame([], schema).withColumn("bucket", F.lit(0))
        chosen = reduce(lambda x, y: x | y, ((F.col("batch") == v) & F.col("bucket").isin(b) for v, b in by_version.items()))
        return self.spark.read.schema(f"{schema}, batch bigint, bucket int").parquet(f"{self.folder}/{kind}").filter(chosen).drop("batch")

    def products(self, schema: str) -> DataFrame:
        return self._read("rows", f"{schema}, key string").drop("key", "bucket")

    def fold(self, batch: DataFrame, batch_id: int) -> bool:
        """Take a batch in; False if the state has it already. What an earlier batch dropped does not come back, so a fold may differ from one pass over all."""
        if batch_id <= self.last:
            return False
        schema = ", ".join(f"`{c}` {t}" for c, t in batch.dtypes)
        rows_schema, names_schema = f"{schema}, key string", "name string, key string, score int"
        new = op.filter_non_products(op.normalize(batch)).withColumn("key", op.product_key())
        new = written(new.withColumn("bucket", _bucket(F.col("key"), self.buckets)), "new")
        touched = new.select("key", "bucket").distinct()
        buckets = [r[0] for r in touched.select("bucket").distinct().collect()]
        old = self._read("rows", rows_schema, buckets).join(touched.select("key"), "key", "left_semi").select(*new.columns)
        met = new.unionByName(old)
        merged = written(op.merge_groups(met.withColumn("__group", F.col("key")), "__group"), "merged")

        # names that the batch brings, changes or takes away, and all that may extend them or be extended
        named = met.select(op.lower_name().alias("name")).union(merged.select(op.lower_name())).distinct().filter("name != ''")
        families = {r[0] for r in named.select(self._family(F.col("name"))).distinct().collect()} | {self.buckets}
        if not named.filter(F.length("name") < _FAMILY).isEmpty():
            families = set(range(self.buckets + 1))
        entries = merged.select(op.lower_name().alias("name"), "key", op.data_score().cast("int").alias("score")).filter("name != ''")
        entries = entries.unionByName(self._read("names", names_schema, sorted(families)).drop("bucket").join(touched.select("key"), "key", "left_anti"))
        entries = written(entries, "entries")
        kept = written(op.without_phantoms(entries, "name", "score"), "kept")
        gone = entries.select("key").join(kept.select("key"), "key", "left_anti")
        buckets = sorted({*buckets, *(r[0] for r in gone.select(_bucket(F.col("key"), self.buckets)).distinct().collect())})

        rest = self._read("rows", rows_schema, buckets).join(touched.select("key"), "key", "left_anti").select(*new.columns)
        rows = rest.unionByName(merged).join(gone, "key", "left_anti").select(*new.columns)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows/batch={batch_id}")
        kept.withColumn("bucket", self._family(F.col("name"))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/names/batch={batch_id}")
        written_now = {**{("rows", b): batch_id for b in buckets}, **{("names", b): batch_id for b in families}}
        replaced = [(k, b, self.versions[k, b]) for k, b in written_now if (k, b) in self.versions]
        versions = self.versions | written_now
        self.spark.createDataFrame([(k, b, v) for (k, b), v in versions.items()], "kind string, bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={batch_id}")
        for kind, bucket, version in replaced:
            _delete(self.spark, f"{self.folder}/{kind}/batch={version}/bucket={bucket}")
        _delete(self.spark, f"{self.folder}/manifest/batch={self.last}")
        self.versions, self.last = versions, batch_id
        return True

    def _family(self, name: Column) -> Column:
        return F.when(F.length(name) < _FAMILY, self.buckets).otherwise(_bucket(F.substring(name, 1, _FAMILY), self.buckets))


def fold_batches(batches: list[DataFrame], folder: str, buckets: int = 64) -> DataFrame:
    """The products after the given batches, one at least, in order."""
    state = ProductState(batches[0].sparkSession, folder, buckets)
    for i, batch in enumerate(batches):
        state.fold(batch, i)
    return state.products(", ".join(f"`{c}` {t}" for c, t in batches[0].dtypes))


def fold_stream(stream: DataFrame, folder: str, buckets: int = 64) -> StreamingQuery:
    """Fold all that a stream of products has now, a micro-batch at a time; called again, it goes on where it stopped. Checkpoint and state lie under folder."""
    def take(batch: DataFrame, batch_id: int) -> None:
        ProductState(batch.sparkSession, f"{folder}/state", buckets).fold(batch, batch_id)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()

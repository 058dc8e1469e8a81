"""Vector code compression: product codes in whole numbers, found by equal-average search.

Entries of a codebook are sorted by the sum of their components. From a part's own sum the search goes
outward, nearer sums first, and ends where the squared gap of the sums over the dimension strictly exceeds the
best squared distance, which no entry beyond can beat or tie (Cauchy-Schwarz). All arithmetic is exact:
in 64-bit integers where they suffice, else in Python's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import materialize

_DECIMAL = pa.decimal128(38, 0)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, parts: int) -> DataFrame:
    """(id, label, dim, x array<bigint>) of the vectors that take part, x = floor(scale * component)."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda c: c * float(scale))
    fits = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 62)))
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).filter(F.col("v").isNotNull() & F.coalesce(fits, F.lit(False)) & (F.size("v") > 0) & (F.size("v") % parts == 0))
    return kept.select("id", "label", F.size("v").alias("dim"), F.transform("v", lambda c: F.floor(c)).alias("x"))


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as int64 if no sum or squared distance of theirs can overflow, else as Python's integers."""
    most = max([0, *(max(int(a.max()), -int(a.min())) for a in arrays if a.size)])
    fast = most * arrays[0].shape[-1] < 1 << 29
    return [a.astype(np.int64 if fast else object) for a in arrays]


def equal_average(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of book to each row of x, ties to the lower index."""
    x, book = _exact(x, book)
    n, dim = x.shape
    sums, mine = book.sum(axis=1), x.sum(axis=1)
    order = np.array(sorted(range(len(book)), key=lambda e: (int(sums[e]), e)))
    sums = sums[order]
    high = np.searchsorted(sums, mine)
    low = high - 1
    index, best = np.full(n, -1), np.zeros(n, x.dtype)
    open_rows = np.arange(n)
    while len(open_rows):
        lo, hi, own = low[open_rows], high[open_rows], mine[open_rows]
        down, up = own - sums[np.maximum(lo, 0)], sums[np.minimum(hi, len(sums) - 1)] - own
        below = (lo >= 0) & ((hi >= len(sums)) | (down <= up))
        gap = np.where(below, down, up)
        going = ((lo >= 0) | (hi < len(sums))) & ((index[open_rows] < 0) | (gap * gap <= best[open_rows] * dim)).astype(bool)
        open_rows, lo, hi, below = open_rows[going], lo[going], hi[going], below[going]
        entry = order[np.where(below, lo, np.minimum(hi, len(sums) - 1))]
        gone = x[open_rows] - book[entry]
        far = (gone * gone).sum(axis=1)
        better = (index[open_rows] < 0) | (far < best[open_rows]) | ((far == best[open_rows]) & (entry < index[open_rows]))
        at = open_rows[better.astype(bool)]
        index[at], best[at] = entry[better.astype(bool)], far[better.astype(bool)]
        low[open_rows[below]] -= 1
        high[open_rows[~below]] += 1
    return index, best


def _by_dim(batch: pa.RecordBatch, dims: pa.Array, x: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows, matrix) of a batch's vectors of each dimension."""
    dims, ends, flat = dims.to_numpy(), np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))]), x.flatten().to_numpy()
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        yield dim, rows, flat[ends[rows][:, None] + np.arange(dim)]


def _sums(sent, parts: int):
    """Of a task's parts the sums and counts by codebook entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int, int], list] = {}
        for batch in batches:
            for dim, _, x in _by_dim(batch, batch.column(0), batch.column(1)):
                x = x.reshape(len(x), parts, -1)
                for p in range(parts):
                    index, _ = equal_average(x[:, p], sent.value[dim][p])
                    for e in np.unique(index).tolist():
                        mine = x[index == e, p]
                        held = totals.setdefault((dim, p, e), [0, 0])
                        held[0] += len(mine)
                        # halves of 32 bits: neither overflows in the sum of a batch
                        held[1] = held[1] + (mine >> 32).sum(axis=0).astype(object) * (1 << 32) + (mine & 0xFFFFFFFF).sum(axis=0).astype(object)
        rows = [{"dim": d, "part": p, "entry": e, "at": i, "n": n, "total": Decimal(int(t))} for (d, p, e), (n, total) in totals.items() for i, t in enumerate(total)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("total", _DECIMAL)]))

    return run


def _codes(sent, parts: int):
    """Each vector's code and error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.empty(batch.num_rows, object), np.empty(batch.num_rows, object)
            for dim, rows, x in _by_dim(batch, batch.column(2), batch.column(3)):
                x = x.reshape(len(x), parts, -1)
                found = [equal_average(x[:, p], sent.value[dim][p]) for p in range(parts)]
                codes[rows] = ["".join(f"{e:02x}" for e in c) for c in zip(*(i.tolist() for i, _ in found))]
                errors[rows] = [sum(map(int, d)) for d in zip(*(b.tolist() for _, b in found))]
            errors = [e if e < 1 << 63 else None for e in errors]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "dim", "code", "error"])

    return run


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """One row per vector that takes part: id_col, code, error, label_error, codebooks_sha256, codebooks.

    Components become floor(scale * x), vectors are cut into ``parts`` equal parts. The codebook of a part
    starts as that part of the vectors of the ``entries`` smallest ids (null ids last, equal ids by their vectors); each round replaces an entry by
    the floored mean of the parts nearest to it, ties to the lower index, and keeps an entry that has none. code: the
    indexes of the nearest final entries, two hex digits each. error: the squared distances of all parts; label_error: its sum
    over the rows of an equal label, nulls together. codebooks: all final entries' components by part, entry, place.

    Vectors null, empty or with null or non-finite components take no part, nor those whose length ``parts`` does not divide, nor
    those with a component of 2^62 / scale or more, which a long can't hold. Vectors of unlike length have codebooks of their
    own. An error that a long can't hold is null, as is the label_error it belongs to. Repeated rows
    count each. Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    spark = vectors.sparkSession
    x = materialize(whole_vectors(vectors, id_col, vector_col, label_col, scale, parts), "whole")
    books = {}
    for (dim,) in x.select("dim").distinct().collect():
        first = x.filter(F.col("dim") == dim).orderBy(F.col("id").asc_nulls_last(), "x").select("x").limit(entries).collect()
        books[dim] = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        summed = x.select("dim", "x").mapInArrow(_sums(sent, parts), "dim int, part int, entry int, at int, n bigint, total decimal(38,0)")
        # as many rows as the codebooks have components
        means = summed.groupBy("dim", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        books = {d: b.copy() for d, b in books.items()}
        for r in means:
            books[r["dim"]][r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
        sent.unpersist()
    sent = spark.sparkContext.broadcast(books)
    schema = T.StructType([*(x.schema[c] for c in ("id", "label", "dim")), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = materialize(x.mapInArrow(_codes(sent, parts), schema), "coded")
    sums = coded.groupBy(F.col("label").alias("label_")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), (F.count("error") == F.count("*")).alias("whole"))
    # a label of a third of all vectors is dealt over 16 tasks
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    met = coded.join(sums, F.col("label").eqNullSafe(F.col("label_")) & (F.pmod(F.xxhash64("id", "code"), F.lit(16)).cast("int") == F.col("salt")))
    listed = {d: ",".join(map(str, b.reshape(-1).tolist())) for d, b in books.items()}
    named = spark.createDataFrame([(d, t, hashlib.sha256(t.encode()).hexdigest()) for d, t in listed.items()], "dim int, codebooks string, codebooks_sha256 string")
    out = met.join(F.broadcast(named), "dim")
    return out.select(F.col("id").alias(id_col), "code", "error", F.when(F.col("whole"), F.col("total").try_cast("bigint")).alias("label_error"), "codebooks_sha256", "codebooks")

"""Nearest neighbours by a block matrix join of int8 tiles with quantisation error bounds.

Vectors are packed into tiles: unit vectors rounded to int8, with a scale and the exact length of what
rounding took away. Every query tile meets every candidate tile in a grid join whose key is the pair of
tiles, so no key sees more than two tiles. An
int8 product plus the error bound is a sure upper bound of each cosine, minus the bound a sure lower
one. A first pass over a part of the candidate tiles gives each query a floor, the k-th best lower bound there, which a
query tile carries along; in the pass over all tiles only pairs that reach it, and the k-th best lower bound of their own tile, are handed on.
Those below the k-th best lower bound of all are out; only the survivors fetch their original vectors and are recomputed in double precision. Each query's best are
merged by a bounded heap in each task and once more over tasks. The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gristmill.llm.common import materialize

#: Products of int8 numbers add up exactly in float32 over this many dimensions: 1024 * 127^2 < 2^24.
_EXACT = 1024


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v double array) of the vectors that take part: not null, empty or zero, without null, infinite or NaN components, with an id."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(F.exists("v", lambda x: x != 0) & F.coalesce(finite, F.lit(False)))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales, and norms of the rounding errors of unit rows."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of int8 rows without any rounding, in whatever dimension."""
    out = np.zeros((len(x), len(y)))
    for a in range(0, x.shape[1], _EXACT):
        out += x[:, a : a + _EXACT].astype(np.float32) @ y[:, a : a + _EXACT].astype(np.float32).T
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = _near_one(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tiles(vectors: DataFrame, rows: int, parts: int) -> DataFrame:
    """(dim, tile, ids, floors, q, scale, error): up to ``rows`` vectors (id, v, floor) of one dimension as the bytes of an int8 matrix. tile is below parts."""
    schema = pa.schema([("dim", pa.int32()), ("tile", pa.int32()), ("ids", pa.list_(pa.int64())), ("floors", pa.list_(pa.float64())), ("q", pa.binary()), ("scale", pa.binary()), ("error", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = TaskContext.get().partitionId()
        held: dict[int, tuple[list, list, list]] = {}

        def out(dim: int, ids: list, data: list, floors: list) -> pa.RecordBatch:
            q, scale, error = quantise(_unit(np.array(data, dtype=np.float64)))
            return pa.RecordBatch.from_pylist([{"dim": dim, "tile": tile, "ids": ids, "floors": floors, "q": q.tobytes(), "scale": scale.tobytes(), "error": error.tobytes()}], schema)

        for batch in batches:
            for i, v, floor in zip(*(batch.column(c).to_pylist() for c in range(3))):
                ids, data, floors = held.setdefault(len(v), ([], [], []))
                ids.append(i)
                data.append(v)
                floors.append(floor)
                if len(ids) == rows:
                    yield out(len(v), ids, data, floors)
                    del held[len(v)]
        for dim, (ids, data, floors) in held.items():
            yield out(dim, ids, data, floors)

    return vectors.select("id", "v", "floor").repartition(parts, F.xxhash64("id")).mapInArrow(pack, "dim int, tile int, ids array<bigint>, floors array<double>, q binary, scale binary, error binary")


def _bounds(row: dict, k: int, lows: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a pair of tiles the places (query, candidate) of the pairs that may be among a query's k nearest, with sure bounds of their cosines; with ``lows`` only those that have the k best lower bounds."""
    asked, ids = np.array(row["query_ids"]), np.array(row["ids"])
    (qx, sx, ex), (qy, sy, ey) = ((np.frombuffer(row[q], np.int8).reshape(-1, row["dim"]), np.frombuffer(row[s]), np.frombuffer(row[e])) for q, s, e in (("query_q", "query_scale", "query_error"), ("q", "scale", "error")))
    near = product(qx, qy) * sx[:, None] * sy[None, :]
    # |x.y - x^.y^| <= |x - x^| |y| + |x^| |y - y^|, with |y| = 1 and |x^| <= 1 + |x - x^|; the rest covers rounding in doubles
    error = ex[:, None] + (1 + ex)[:, None] * ey[None, :] + 1e-9 + 1e-15 * row["dim"]
    near[asked[:, None] == ids[None, :]] = -np.inf
    # rows that repeat an id must not push another id out
    keep = min(k + len(ids) - len(np.unique(ids)), len(ids))
    floor = np.partition(near - error, len(ids) - keep, axis=1)[:, len(ids) - keep]
    best = near - error if lows else near + error
    at = np.nonzero((best >= np.maximum(floor, np.array(row["floors"]))[:, None]) & np.isfinite(near))
    return at[0], at[1], (near - error)[at], (near + error)[at]


def _search(k: int, lows: bool = False):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                q, c, low, high = _bounds(row, k, lows)
                asked, ids = np.array(row["query_ids"]), np.array(row["ids"])
                for a in range(0, len(q), 1 << 16):
                    b = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(asked[q[b]]), pa.array(ids[c[b]]), pa.array(low[b]), pa.array(high[b])], schema=schema)

    return search


def _near_one(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1: no product overflows or vanishes, no digit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


@F.pandas_udf(DoubleType())
def _cosine(x: pd.Series, y: pd.Series) -> pd.Series:
    out = np.full(len(x), np.nan)
    dims = x.map(len).to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        a, b = (_near_one(np.stack(z.iloc[at].to_list())) for z in (x, y))
        out[at] = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    return pd.Series(out)


def _heaps(k: int):
    """Keeps each query's k best of a task in a heap; rows of a query stand together, so one heap is held at a time."""
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, heap = None, []
        for batch in batches:
            out = []
            for q, c, s in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if q != query:
                    out += [(query, -i, x) for x, i in heap]
                    query, heap = q, []
                if len(heap) < k:
                    heapq.heappush(heap, (s, -c))
                elif (s, -c) > heap[0]:
                    heapq.heapreplace(heap, (s, -c))
            yield _scored(out)
        yield _scored([(query, -i, x) for x, i in heap])

    return best


def _scored(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"query_id": q, "vec_id": c, "score": s} for q, c, s in rows], pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, tile_rows: int = 2048, first_tiles: int = 8, first_part: float = 1 / 16) -> DataFrame:
    """Of each query its k nearest candidates by cosine, without the rows of its own id: query_id, rank, vec_id, score.

    queries and vectors share their columns. Nearest first, ties to the smaller id; a query with fewer
    candidates gets them all, one with none has no row. Vectors null, empty, zero or with null or non-finite
    components, and null ids, take no part; vectors of unlike dimension are never compared. Rows that repeat an
    id and vector count once; other repeats of a query's id are searched as one query each would be, best scores kept. Extra columns are ignored.
    Floors come from first_part of the candidate tiles, first_tiles at least; they only decide how many pairs are handed on.
    """
    base, asked = materialize(usable(vectors, id_col, vector_col).distinct(), "vectors"), materialize(usable(queries, id_col, vector_col).distinct(), "asked")
    across, down = (max(1, -(-t.count() // tile_rows)) for t in (base, asked))
    none = F.lit(float("-inf")).alias("floor")
    right = materialize(tiles(base.select("id", "v", none), tile_rows, across), "candidates").select("dim", F.col("tile").alias("column"), "ids", "q", "scale", "error")

    def met(floored: DataFrame, columns: int, name: str) -> DataFrame:
        """Each tile of queries beside each of the first candidate tiles: tiles, not vectors, are repeated, a byte for each component."""
        left = materialize(tiles(floored, tile_rows, down), name).select("dim", F.col("tile").alias("row"), "floors", *(F.col(c).alias(f"query_{c}") for c in ("ids", "q", "scale", "error")))
        left = left.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
        return left.hint("merge").join(right.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))), ["dim", "row", "column"])

    schema = "query_id bigint, vec_id bigint, low double, high double"
    begun = met(asked.select("id", "v", none), max(1, min(across, max(first_tiles, int(across * first_part)))), "first").mapInArrow(_search(k, lows=True), schema)
    lows = top(begun.groupBy("query_id", "vec_id").agg(F.max("low").alias("score")), k).groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") == k)
    floored = asked.join(lows.select(F.col("query_id").alias("id"), "floor"), "id", "left").select("id", "v", F.coalesce("floor", none).alias("floor"))
    pairs = met(floored, across, "queries").mapInArrow(_search(k), schema)
    pairs = materialize(pairs.groupBy("query_id", "vec_id").agg(F.max("low").alias("low"), F.max("high").alias("high")), "pairs")
    floors = top(pairs.select("query_id", "vec_id", F.col("low").alias("score")), k).groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n"))
    open_pairs = pairs.join(floors, "query_id").filter((F.col("n") < k) | (F.col("high") >= F.col("floor"))).select("query_id", "vec_id")
    met = open_pairs.join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("x")), "query_id").join(base.select(F.col("id").alias("vec_id"), F.col("v").alias("y")), "vec_id")
    scored = met.filter(F.size("x") == F.size("y")).select("query_id", "vec_id", _cosine("x", "y").alias("score"))
    best = top(scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score")))
    return best.groupBy("query_id").agg(order.alias("near")).select("query_id", F.posexplode("near")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query, ties to the smaller id. A heap of k in each task, then one over what is left of each query."""
    def merged(rows: DataFrame) -> DataFrame:
        return rows.sortWithinPartitions("query_id").mapInArrow(_heaps(k), "query_id bigint, vec_id bigint, score double")

    return merged(merged(scores).repartition("query_id"))

"""Stupid-backoff language-model scores, computed relationally.

Documents are gathered into blocks. A block keeps its texts as places in its own list of distinct
words, so a text is cut into words once. Of each block, the hashes of its distinct n-grams,
with their counts there, are exploded to the hash partitions of the count table; each partition adds up its n-grams'
counts over all blocks and sends every block the counts of the n-grams it asked for; the block's
documents are then scored and summed. An n-gram occurs once a block at most, however common it is, so no n-gram is hot, and the
number of partitions grows with the corpus, so none of them does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import materialize
from gristmill.llm.near_dup import _STEP, mix, word_hashes

_LOW48 = np.uint64((1 << 48) - 1)


def _pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _planes(x: np.ndarray) -> bytes:
    """The values' lowest bytes, then their next ones and so on: the high bytes of small values are runs of zeros, which shuffles and tables pack well."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _grams(uni: np.ndarray, seq: np.ndarray, counts: np.ndarray, order: int):
    """Hashes of a block's distinct n-grams of 1 to order words, how often each occurs in it, and for each length the number, among those of that length, of the n-gram that ends at each place (-1: the text has too few words before it)."""
    starts = np.cumsum(counts) - counts
    before = np.arange(seq.size) - np.repeat(starts, counts)
    n_words = np.uint64(max(1, uni.size))
    hashes, times, places = [mix(uni ^ _STEP)], [np.bincount(seq, minlength=uni.size)], [seq]
    chain = uni
    for n in range(2, order + 1):
        has = np.flatnonzero(before >= n - 1)
        codes = places[-1][has - 1].astype(np.uint64) * n_words + seq[has].astype(np.uint64)
        distinct, inverse, found = np.unique(codes, return_inverse=True, return_counts=True)
        chain = mix(mix(chain[(distinct // n_words).astype(np.int64)] + _STEP) ^ uni[(distinct % n_words).astype(np.int64)])
        place = np.full(seq.size, -1, dtype=np.int64)
        place[has] = inverse
        hashes.append(chain)
        times.append(found)
        places.append(place)
    return np.concatenate(hashes), np.concatenate(times).astype(np.uint32), places


def _parts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The hash partition of each n-gram."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _log_scores(found: np.ndarray, places: list[np.ndarray], total: int, min_count: int, backoff: float) -> np.ndarray:
    """The log score of each place, from the shortest n-grams up: one that is common enough replaces what shorter ones gave, another backs off to it."""
    sizes = np.cumsum([0] + [int(p.max(initial=-1)) + 1 for p in places])
    short = found[: sizes[1]][places[0]]
    logs = np.log(short) - np.log(max(1, total))
    for place, a, b in zip(places[1:], sizes[1:], sizes[2:]):
        has = np.flatnonzero(place >= 0)
        here = found[a:b][place[has]]
        seen = here >= min_count
        logs[has] = np.where(seen, np.log(np.maximum(here, 1)) - np.log(short[has - 1]), logs[has] + np.log(backoff))
        short = np.ones(place.size)
        short[has] = here
    return logs


def blocks_of(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, order: int) -> DataFrame:
    """(block, ids, counts, words, places, n_grams): documents in blocks of about block_bytes of text."""
    def pack(ids: list, texts: list[bytes]) -> dict:
        hashes, counts = word_hashes(texts)
        uni, seq = np.unique(hashes, return_inverse=True)
        grams = _grams(uni, seq, np.asarray(counts, dtype=np.int64), order)[0].size
        key = int(mix(np.array([len(texts), hashes.size, hashes.sum(dtype=np.uint64) if hashes.size else 0], dtype=np.uint64)).sum(dtype=np.uint64) >> np.uint64(1))
        key ^= hash(tuple(ids)) & 0x7FFFFFFFFFFFFFFF
        return {"block": key, "ids": ids, "counts": counts, "words": uni.tobytes(), "places": _planes(seq.astype(np.uint32)), "n_grams": grams}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("words", pa.binary()), ("places", pa.binary()), ("n_grams", pa.int64())])
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                text = (t.as_py() or "").encode()
                ids.append(i.as_py())
                texts.append(text)
                size += len(text)
                if size >= block_bytes:
                    yield pa.RecordBatch.from_pylist([pack(ids, texts)], schema)
                    ids, texts, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([pack(ids, texts)], schema)

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "block bigint, ids array<bigint>, counts array<bigint>, words binary, places binary, n_grams bigint")


def stupid_backoff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, min_count: int = 2, backoff: float = 0.4, block_bytes: int = 1 << 23, partition_grams: int = 1 << 20) -> DataFrame:
    """One row per row of docs: id_col, n_words, log_score, mean_score.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. Counts of n-grams of 1
    to order words are taken over all texts of docs. A word w after the order - 1 words v before it in its text, or
    all of them if fewer, scores c(v w) / c(v) if the n-gram v w occurs min_count times or more, else
    backoff times what w scores after v without its first word; after no words it scores c(w) / N. log_score is the sum of
    the natural logs, mean_score that over n_words. A null, empty or blank text has n_words 0,
    log_score 0 and a null mean_score. Repeated rows and null ids are scored each; ids are whole numbers
    (strings that hold none end the job). Other columns of docs are ignored, whatever their names.

    An n-gram is told from others by its partition and 48 more bits of its hash. A partition holds about
    partition_grams n-grams at every size of the corpus, so an n-gram takes over the count of another one with a chance of
    partition_grams / 2^48 (by default 4e-9), however many there are.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    blocks = materialize(blocks_of(docs, id_col, text_col, block_bytes, order).withColumn("block", F.xxhash64("block", F.monotonically_increasing_id())), "blocks")
    size = blocks.agg(F.sum("n_grams").alias("n"), F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("words")).first()
    parts, total = max(1, -(-(size["n"] or 0) // partition_grams)), size["words"] or 0

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uni, seq = np.frombuffer(row["words"], np.uint64), _from_planes(row["places"], np.uint32).astype(np.int64)
                hashes, n, _ = _grams(uni, seq, np.array(row["counts"], dtype=np.int64), order)
                part = _parts(hashes, parts)
                ranked = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[ranked], np.arange(parts + 1))
                rows = [(p, ranked[a:b]) for p, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in rows], pa.int64()), pa.array([row["block"]] * len(rows), pa.int64()), pa.array([_pack48(mix(hashes[o]) & _LOW48) for _, o in rows], pa.binary()), pa.array([_planes(n[o]) for _, o in rows], pa.binary())],
                    names=["part", "block", "grams", "n"],
                )

    def count(asked: pd.DataFrame) -> pd.DataFrame:
        grams = [_unpack48(g) for g in asked["grams"]]
        _, place = np.unique(np.concatenate(grams), return_inverse=True)
        sums = np.bincount(place, weights=np.concatenate([_from_planes(n, np.uint32) for n in asked["n"]]))
        answers = np.split(sums[place].astype(np.uint64), np.cumsum([g.size for g in grams])[:-1])
        return pd.DataFrame({"part": asked["part"], "block": asked["block"], "totals": [_planes(a) for a in answers]})

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            uni, seq, counts = np.frombuffer(row.words, np.uint64), _from_planes(row.places, np.uint32).astype(np.int64), np.asarray(row.counts, dtype=np.int64)
            hashes, _, places = _grams(uni, seq, counts, order)
            found = np.empty(hashes.size)
            if hashes.size:
                found[np.argsort(_parts(hashes, parts), kind="stable")] = np.concatenate([_from_planes(t, np.uint64) for t in right.sort_values("part")["totals"]])
            logs = _log_scores(found, places, total, min_count, backoff)
            ends = np.cumsum(counts)
            full = counts > 0
            sums = np.zeros(counts.size)
            if full.any():
                sums[full] = np.add.reduceat(logs, (ends - counts)[full])
            out.append(pd.DataFrame({id_col: pd.array(row.ids, dtype="Int64"), "n_words": counts, "log_score": sums, "mean_score": pd.array(np.where(full, sums / np.maximum(counts, 1), np.nan)).astype("Float64")}))
        return pd.concat(out) if out else pd.DataFrame({id_col: [], "n_words": [], "log_score": [], "mean_score": []})

    asked = blocks.mapInArrow(ask, "part bigint, block bigint, grams binary, n binary")
    answered = asked.groupBy("part").applyInPandas(count, "part bigint, block bigint, totals binary")
    schema = f"`{id_col}` bigint, n_words bigint, log_score double, mean_score double"
    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(score, schema).withColumn("mean_score", F.nullif(F.col("mean_score"), F.lit(float("nan"))))

"""Ranked lexical search, reversed: the index is of the queries' terms, and documents stream through it.

One pass counts documents, terms and the documents that hold each item term. A second one scores: a task holds an
inverted index over a block of items, takes each document's counts of its terms through it, and keeps
a heap of the best documents for each item. Heaps merge by a window over groups of tasks and one over
what these leave. Scores are whole numbers, so neither order nor grouping changes them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm import terms
from gristmill.llm.common import materialize

#: Cells of (document, item) summed at a time.
_CELLS = 1 << 22


def _counted(words: pa.Array, row: np.ndarray, listed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times) of the listed terms that each row holds."""
    ids = terms.places(words, listed).astype(np.int64)
    at = ids >= 0
    pairs, times = np.unique(row[at] * len(listed) + ids[at], return_counts=True)
    return pairs // max(len(listed), 1), pairs % max(len(listed), 1), times


def _statistics(sent):
    """(term, docs) a task: docs with the term; term -1: docs with any term, -2: terms with repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.array(sent.value, pa.large_string())
        df, n, total = np.zeros(len(listed), np.int64), 0, 0
        for batch in batches:
            for a, b in terms.pieces(batch.column(0)):
                words, row = terms.cut(batch.column(0).slice(a, b - a))
                df += np.bincount(_counted(words, row, listed)[1], minlength=len(listed))
                n, total = n + len(np.unique(row)), total + len(row)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, [-1, -2]).astype(np.int32)), pa.array(np.append(df[held], [n, total]))], names=["term", "docs"])

    return run


class Index:
    """Terms of items with their weights, and for each term the items that have it."""

    def __init__(self, listed: list[str], item_terms: list[tuple[int, int]], weights: np.ndarray, n_items: int):
        held = np.array(item_terms, np.int64).reshape(-1, 2)
        held = held[np.lexsort((held[:, 0], held[:, 1]))]
        self.listed, self.weights, self.n_items = listed, weights, n_items
        self.items, self.ends = held[:, 0], np.searchsorted(held[:, 1], np.arange(len(listed) + 1))

    def scores(self, row: np.ndarray, term: np.ndarray, times: np.ndarray, norms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, item, score) of the scores above 0."""
        part = self.weights[term] * (1_000_000_000 * times // (1000 * times + 8 * norms[row]))
        wide = max(1, _CELLS // max(self.n_items, 1))
        for start in range(0, int(row[-1]) + 1 if len(row) else 0, wide):
            a, b = np.searchsorted(row, [start, start + wide])
            sizes = self.ends[term[a:b] + 1] - self.ends[term[a:b]]
            take = np.repeat(self.ends[term[a:b]] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
            cell = np.repeat(row[a:b] - start, sizes) * self.n_items + self.items[take]
            total = np.zeros(min(wide, int(row[-1]) + 1 - start) * self.n_items, np.int64)
            np.add.at(total, cell, np.repeat(part[a:b], sizes))
            found = np.flatnonzero(total > 0)
            yield found // self.n_items + start, found % self.n_items, total[found]


def _search(sent, k: int, documents: int, all_terms: int):
    schema = pa.schema([("item", pa.int64()), ("doc", pa.int64()), ("score", pa.int64()), ("task", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = sent.value
        listed = pa.array(index.listed, pa.large_string())
        heaps: list[list[tuple]] = [[] for _ in range(index.n_items)]
        floor = np.zeros(index.n_items, np.int64)
        for batch in batches:
            for a, b in terms.pieces(batch.column(1)):
                words, row = terms.cut(batch.column(1).slice(a, b - a))
                size = np.bincount(row, minlength=b - a)
                norms = 100 - 90 + 90 * size * documents // max(all_terms, 1)
                ids = batch.column(0).slice(a, b - a).to_pylist()
                for rows, items, scores in index.scores(*_counted(words, row, listed), norms):
                    open_cells = scores >= floor[items]
                    for r, i, s in zip(rows[open_cells].tolist(), items[open_cells].tolist(), scores[open_cells].tolist()):
                        # higher score, then smaller id, null last
                        entry = (s, ids[r] is not None, -(ids[r] or 0))
                        heap = heaps[i]
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                        if len(heap) == k:
                            floor[i] = heap[0][0]
        task = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_pylist([{"item": i, "doc": -d if known else None, "score": s, "task": task} for i, heap in enumerate(heaps) for s, known, d in heap], schema)

    return run


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", k: int = 10, block_terms: int = 1_000_000, block_items: int = 20_000) -> DataFrame:
    """The k best documents of each item: item_id_col, rank, id_col, score; best first, ties to the smaller id.

    Scores are the weighted sums of saturated term counts that op13's contract states, over the distinct terms of an item, in
    64-bit integers. Null and wordless documents have no term and no score; items that have none, or whose
    terms score nowhere, have no row. Each distinct (id, text) of items is an item, each row of docs a document: repeated
    documents rank one behind the other, null ids behind the others of their score. Ids are whole numbers. Other columns are ignored.

    Items go in blocks of about block_items items and block_terms terms in all, whose index is broadcast; each block is held
    against all documents. An item is never cut, so one with more terms than that is a block of its own.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_id_col).alias("item"), F.array_distinct(terms.terms_of(F.col(item_text_col))).alias("terms"), F.xxhash64(item_text_col).alias("h")).filter(F.size("terms") > 0).dropDuplicates(["item", "terms", "h"])
    asked = materialize(asked.withColumn("n", F.monotonically_increasing_id()), "asked")
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-size // block_terms))
    ranked = []
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("n"), F.lit(blocks)) == b).orderBy("n").select("n", "terms").collect()
        listed = sorted({t for r in block for t in r["terms"]})
        place = {t: i for i, t in enumerate(listed)}
        sent = spark.sparkContext.broadcast(listed)
        counted = texts.select("text").mapInArrow(_statistics(sent), "term int, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs"))
        known = dict(counted.collect())  # a row for each term of the block
        documents, all_terms = known.get(-1, 0), known.get(-2, 0)
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * known.get(i, 0) + 1))) for i in range(len(listed))], np.int64)
        index = Index(listed, [(i, place[t]) for i, r in enumerate(block) for t in r["terms"]], weights, len(block))
        sent_index = spark.sparkContext.broadcast(index)
        found = texts.mapInArrow(_search(sent_index, k, documents, all_terms), "item bigint, doc bigint, score bigint, task int")
        best = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
        # heaps of a group of tasks first, so that no item's heaps of all tasks meet in one
        for keys in (["item", "task"], ["item"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["n"]) for i, r in enumerate(block)], "item bigint, n bigint")
        ranked.append(materialize(found.join(names, "item").select("n", "rank", "doc", "score"), "ranked"))
    out = ranked[0]
    for more in ranked[1:]:
        out = out.union(more)
    return out.join(asked.select("n", "item"), "n").select(F.col("item").alias(item_id_col), "rank", F.col("doc").alias(id_col), "score")

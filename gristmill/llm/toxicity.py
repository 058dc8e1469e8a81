"""Toxicity by nearest labelled examples: exact TF-IDF cosines from a block-max inverted index, and their votes.

A text's terms are all its words, by 64-bit hash; none is dropped. Document frequencies are counted over
all documents. A bounded sample of labelled documents, clean ones too, are the examples; words that speak
for the label there weigh ``lift`` times their TF-IDF, for under plain TF-IDF (lift 1) topic and language
drown them. Vectors are normalised over all words of the text.

The index holds the examples in blocks of like ones, and each term's largest weight in each block. A text
first meets the blocks of largest bound; those whose bound, the sum over its terms of these weights, can't reach
the k-th best cosine found there are never opened. What may be among the nearest is summed again in 64 bits,
so the result is that of a comparison with every example. The votes of the nearest, weighted by cosine and
drawn towards the base rate, give the score; the examples are its evidence.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import forget, materialize
from gristmill.llm.near_dup import word_hashes

#: Bytes that stand between words: all of ASCII but letters and digits.
_APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Document frequencies are kept by this many hashes of terms.
BUCKETS = 1 << 18
#: Examples in a part of the index on its way to the executors; texts that meet the index together.
PART, BATCH = 2500, 64


def terms_of(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the sorted distinct 64-bit hashes of its words, in lower case, and how often each stands there."""
    hashes, counts = word_hashes([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts], _APART)
    ends = np.cumsum(counts)
    return [np.unique(hashes[a:b], return_counts=True) for a, b in zip(ends - counts, ends)]


def bucket(terms: np.ndarray) -> np.ndarray:
    return (terms % np.uint64(BUCKETS)).astype(np.int64)


class Weights:
    """TF-IDF with the lifted terms; idf by bucket."""

    def __init__(self, idf: np.ndarray, lifted: np.ndarray, lift: float):
        self.idf, self.lifted, self.lift = idf, np.sort(lifted), lift

    def of(self, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        weights = (1 + np.log(tf)) * self.idf[bucket(terms)]
        if len(self.lifted):
            at = np.minimum(np.searchsorted(self.lifted, terms), len(self.lifted) - 1)
            weights[self.lifted[at] == terms] *= self.lift
        return weights

    def unit(self, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        weights = self.of(terms, tf)
        return weights / np.sqrt((weights * weights).sum()) if len(weights) else weights


class BlockMaxIndex:
    """Sparse unit vectors in blocks; nearest() finds those of largest inner product. Weights have 32 bits, sums that decide 64.

    Terms in more than a ``dense`` part of the vectors are rows of a matrix, the others have posting lists, ordered by block.
    """

    #: 32-bit sums of unit vectors' products are surely this close.
    SLACK = 1e-4

    def __init__(self, terms: np.ndarray, weights: np.ndarray, lengths: np.ndarray, blocks: int = 16, dense: float = 0.1):
        self.vocabulary = np.unique(terms)
        self._build(np.searchsorted(self.vocabulary, terms).astype(np.int32), weights, lengths, blocks, dense)

    @classmethod
    def of(cls, parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], postings: int) -> BlockMaxIndex:
        """The index of parts (terms, weights, lengths) with so many postings in all, with one part and one array of 64 bits at a time in memory."""
        self = cls.__new__(cls)
        terms, weights, lengths, at = np.empty(postings, np.uint64), np.empty(postings, np.float32), [np.zeros(0, np.int64)], 0
        for t, w, n in parts:
            terms[at : at + len(t)], weights[at : at + len(t)], at = t, w, at + len(t)
            lengths.append(n)
        self.vocabulary = np.unique(terms)
        number = np.empty(postings, np.int32)
        for a in range(0, postings, 1 << 20):
            number[a : a + (1 << 20)] = np.searchsorted(self.vocabulary, terms[a : a + (1 << 20)])
        del terms
        self._build(number, weights, np.concatenate(lengths), 16, 0.1)
        return self

    def _build(self, number: np.ndarray, weights: np.ndarray, lengths: np.ndarray, blocks: int, dense: float) -> None:
        self.n = len(lengths)
        owner = np.repeat(np.arange(self.n, dtype=np.int32), lengths)
        common = np.flatnonzero(np.bincount(number, minlength=len(self.vocabulary)) > max(1, dense * self.n))
        self.row = np.full(len(self.vocabulary), -1, dtype=np.int32)
        self.row[common] = np.arange(len(common))
        matrix = np.zeros((len(common), self.n), dtype=np.float32)
        held = self.row[number] >= 0
        matrix[self.row[number[held]], owner[held]] = weights[held]
        group = self._alike(matrix, blocks)
        self.order = np.argsort(group, kind="stable")  # place in the index -> example
        place = np.empty(self.n, dtype=np.int32)
        place[self.order] = np.arange(self.n)
        self.matrix = matrix[:, self.order]
        del matrix
        _, self.edge = np.unique(group[self.order], return_index=True)
        self.edge = np.append(self.edge, self.n)
        self.blocks = len(self.edge) - 1
        number, owner, weights = number[~held], place[owner[~held]], weights[~held].astype(np.float32)
        del held
        key = number.astype(np.int64)
        key *= max(self.n, 1)
        key += owner
        sort = np.argsort(key)
        del key
        self.owner, self.weight, number = owner[sort], weights[sort], number[sort]
        del owner, weights, sort
        size = len(self.vocabulary) * self.blocks
        # a cell: a term in a block; postings lie in the order of their cells
        cell = number.astype(np.int64)
        cell *= self.blocks
        cell += np.searchsorted(self.edge, self.owner, side="right") - 1
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        #: Where the postings of each term and block begin, and their largest weight.
        self.cut, self.most = np.zeros(size + 1, dtype=np.int32), np.zeros(size, dtype=np.float32)
        self.cut[cell[first] + 1] = np.diff(np.append(first, len(cell)))
        np.cumsum(self.cut, out=self.cut)
        if len(first):
            self.most[cell[first]] = np.maximum.reduceat(self.weight, first)
        self.most = self.most.reshape(len(self.vocabulary), self.blocks)

    @staticmethod
    def _alike(matrix: np.ndarray, blocks: int) -> np.ndarray:
        """A block for each vector: a few rounds of spherical k-means over the common terms, which only the speed depends on."""
        n = matrix.shape[1]
        blocks = max(1, min(blocks, n // 64))
        group = np.arange(n) % blocks
        if blocks > 1:
            center = matrix[:, np.linspace(0, n - 1, blocks).astype(int)]
            for _ in range(6):
                group = np.argmax(center.T @ matrix, axis=0)
                center = np.stack([matrix[:, group == b].sum(axis=1) for b in range(blocks)], axis=1)
                center /= np.maximum(np.linalg.norm(center, axis=0), 1e-9)
        return group

    def nearest_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """Of each vector (terms, weights) the k (cosine, example) of largest cosine above 0, ties to the smaller example."""
        if not self.n or not len(self.vocabulary):
            return [[] for _ in vectors]
        known, left = [], np.zeros((len(vectors), len(self.matrix)), dtype=np.float32)
        for q, (terms, weights) in enumerate(vectors):
            at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == terms
            at, weights = at[hit], weights[hit]
            row = self.row[at]
            left[q, row[row >= 0]] = weights[row >= 0]
            known.append((at[row < 0], weights[row < 0], row[row >= 0], weights[row >= 0]))
        sums = left @ self.matrix
        return [self._best(sums[q], *known[q], k) for q in range(len(vectors))]

    def _add(self, sums: np.ndarray, at: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> None:
        """Add the products of the terms' postings in these blocks."""
        cell = (at[:, None] * self.blocks + blocks[None, :]).ravel()
        low, n = self.cut[cell], self.cut[cell + 1] - self.cut[cell]
        if total := int(n.sum()):
            found = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(total)
            sums += np.bincount(self.owner[found], self.weight[found] * np.repeat(np.repeat(weights, len(blocks)), n), self.n)

    def _best(self, common: np.ndarray, at: np.ndarray, weights: np.ndarray, rows: np.ndarray, row_weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        bound = weights @ self.most[at] + np.maximum.reduceat(common, self.edge[:-1])
        by = np.argsort(-bound, kind="stable")
        rare, opened = np.zeros(self.n), by[: max(1, self.blocks // 8)]
        self._add(rare, at, weights, opened)
        inside = np.concatenate([common[self.edge[b] : self.edge[b + 1]] + rare[self.edge[b] : self.edge[b + 1]] for b in opened])
        least = np.partition(inside, len(inside) - k)[len(inside) - k] if len(inside) > k else 0
        more = by[len(opened) :]
        more = more[bound[more] >= least - self.SLACK]
        self._add(rare, at, weights, more)
        closed = by[len(opened) + len(more) :]
        sums = common + rare
        for b in closed:
            sums[self.edge[b] : self.edge[b + 1]] = 0
        least = np.partition(sums, self.n - k)[self.n - k] - self.SLACK if self.n > k else 0
        near = np.flatnonzero((sums >= least) & (sums > 0))
        found = rare[near] + (self.matrix[np.ix_(rows, near)] * row_weights[:, None]).sum(axis=0)
        example = self.order[near]
        best = np.lexsort((example, -found))[:k]
        return list(zip(found[best].tolist(), example[best].tolist()))


def frequencies(docs: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """The number of documents, and of those that hold a term of each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS + 1, dtype=np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                for terms, _ in terms_of(batch.column(0).slice(at, BATCH).to_pylist()):
                    df[bucket(terms)] += 1
                    n += 1
        df[BUCKETS] = n
        held = np.flatnonzero(df)
        for at in range(0, len(held), 50_000):
            part = held[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(df[part], pa.int64())], names=["term", "n"])

    found = docs.select(F.col(text_col)).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS + 1 rows at most
    df = np.zeros(BUCKETS + 1, dtype=np.int64)
    df[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return int(df[BUCKETS]), df[:BUCKETS]


def _vectors(examples: DataFrame) -> DataFrame:
    """(h, n, toxic, terms, tf, id) of examples (id, toxic, text) with any word; h, a hash of the text, orders them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                found = terms_of(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("toxic"), part.column("h"), pa.array([t.view(np.int64) for t, _ in found], pa.list_(pa.int64())), pa.array([n for _, n in found], pa.list_(pa.int32()))], names=["id", "toxic", "h", "terms", "tf"])

    rows = examples.select("id", "toxic", _text_hash(F.col("text")).alias("h"), "text")
    return rows.mapInArrow(run, f"id {examples.schema['id'].dataType.simpleString()}, toxic int, h bigint, terms array<bigint>, tf array<int>").withColumn("n", F.size("terms")).filter("n > 0")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def lifted_terms(vectors: DataFrame, min_odds: float, min_z: float) -> np.ndarray:
    """Terms whose log odds of standing in positive rather than negative examples are min_odds or more and exceed 0 by min_z standard errors."""
    n = vectors.agg(F.sum("toxic").alias("pos"), F.count("*").alias("all")).first()
    if not n["pos"]:
        return np.zeros(0, dtype=np.uint64)
    p, q = n["pos"], n["all"] - n["pos"]
    counted = vectors.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (F.lit(p) - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (F.lit(q) - F.col("b") + 0.5))
    found = counted.filter((odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5)) >= min_z) & (odds >= min_odds)).select("term").toArrow()
    return found.column("term").to_numpy().view(np.uint64)  # terms of the sample, which is bounded


#: The index of this worker, by its run, and what clears it: an idle worker, which may live on beside later stages, gives its memory back.
_INDEX: dict[str, BlockMaxIndex] = {}
_CLEAR: list[threading.Timer] = []
#: Seconds after its last batch at which a worker drops its index.
IDLE = 8.0


def _index(run: str, weights: Weights, parts: list, postings: int) -> BlockMaxIndex:
    def unit_parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for part in parts:
            terms, tf, lengths = part.value
            w = weights.of(terms, tf)
            norms = np.sqrt(np.add.reduceat(w * w, np.cumsum(lengths) - lengths))
            yield terms, (w / np.repeat(norms, lengths)).astype(np.float32), lengths
            del part._value  # one part at a time is in memory twice

    while _CLEAR:
        _CLEAR.pop().cancel()
    if run not in _INDEX:
        _INDEX.clear()
        _INDEX[run] = BlockMaxIndex.of(unit_parts(), postings)
    return _INDEX[run]


def _idle() -> None:
    timer = threading.Timer(IDLE, _INDEX.clear)
    timer.daemon = True
    timer.start()
    _CLEAR.append(timer)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", k: int = 10, max_examples: int = 20_000, max_postings: int = 30_000_000, min_odds: float = 3.0, min_z: float = 2.0, shrink: float = 1.5, carry: tuple[str, ...] = (), lift: float = 8.0, corpus: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: id_col, the columns of carry, score, predicted, evidence.

    labels: (id_col, label_col) of the rows to learn from; null ids or labels teach nothing, repeated ids
    count as positive if any row is, and teach their text of the smallest hash. The classifier is fitted on at most max_examples labelled rows (those
    of the smallest text hashes) with at most max_postings distinct words in all, texts of smaller hashes first, which bounds a
    worker's memory. score, from 0 to 1, is (sum of the cosines of positive neighbours + shrink * base rate) /
    (sum of all neighbours' cosines + shrink); the base rate is over all labels. It depends on the text alone;
    of neighbours of equal cosine those of the smaller text hash count. predicted is 1 if score >= 0.5.
    corpus: documents whose texts teach and are counted, docs itself unless given. evidence holds the ids, cosines and labels of the neighbours. A null or empty text, and any that shares no
    word with an example, scores the base rate; without labels that is 0. Other columns of docs are ignored.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    rate = known.agg(F.avg("toxic")).first()[0] or 0.0
    corpus = docs if corpus is None else corpus
    texts = corpus.select(F.col(id_col).alias("id"), _text_hash(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    # of texts alike the label comes before the id, so that no id decides anything; of an id's texts that of the smallest hash teaches
    chosen = texts.select("id", "h").join(known.withColumnRenamed(id_col, "id"), "id").groupBy("id").agg(F.min("h").alias("h"), F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy("h", "toxic", "id").limit(max_examples)  # so many rows at most: small enough to broadcast
    examples = texts.join(F.broadcast(chosen), ["id", "h"]).groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    vectors = materialize(_vectors(examples), "vectors")
    lifted = lifted_terms(vectors, min_odds, min_z)
    n_docs, df = frequencies(corpus, text_col)
    weights = Weights(np.log((n_docs + 1) / (df + 1)) + 1, lifted, lift)
    order = [(r["h"], r["n"]) for r in vectors.select("h", "n", "toxic", "id").orderBy("h", "toxic", "id").collect()]  # max_examples rows at most
    most = int(np.searchsorted(np.cumsum([n for _, n in order]), max_postings, side="right"))
    # the index goes to the executors in parts, so that the driver holds one at a time
    sc, parts, ids, marks = docs.sparkSession.sparkContext, [], [], []
    edges = [*dict.fromkeys(order[at][0] for at in range(0, most, PART)), None]
    for low, high in zip(edges[:-1], edges[1:]):
        inside = (F.col("h") >= low) & (F.lit(True) if high is None else F.col("h") < high)
        held = vectors.filter(inside).orderBy("h", "toxic", "id").select("id", "toxic", "terms", "tf").toArrow().slice(0, most - len(ids))
        terms, tf = (held.column(c).combine_chunks() for c in ("terms", "tf"))
        lengths = terms.value_lengths().to_numpy()
        parts.append(sc.broadcast((terms.flatten().to_numpy().view(np.uint64), tf.flatten().to_numpy(), lengths)))
        ids += held.column("id").to_pylist()
        marks += held.column("toxic").to_pylist()
        del held, terms, tf
    forget(vectors)
    postings = sum(n for _, n, *_ in order[:most])
    shared, this = sc.broadcast((weights, np.array(ids), np.array(marks))), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, ids, marks = shared.value
        index = _index(this, weights, parts, postings)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                scores, evidence = [], []
                for near in index.nearest_all([(t, weights.unit(t, n)) for t, n in terms_of(batch.column(1 + len(carry)).to_pylist())], k):
                    up = sum(c for c, e in near if marks[e])
                    scores.append(min(1.0, (up + shrink * rate) / (sum(c for c, _ in near) + shrink)))
                    evidence.append([{"id": int(ids[e]), "cosine": c, "label": int(marks[e])} for c, e in near])
                kind = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + len(carry)], pa.array(scores, pa.float64()), pa.array(evidence, kind)], names=[id_col, *carry, "score", "evidence"])
        _idle()

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *carry))
    scored = docs.select(id_col, *carry, F.col(text_col).alias("__t")).mapInArrow(run, f"{kept}, score double, evidence array<struct<id: bigint, cosine: double, label: int>>")
    return scored.select(id_col, *carry, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def cross_validate(docs: DataFrame, labels: DataFrame, settings: list[dict], folds: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[dict]:
    """Of each setting (keywords of score_toxicity) what labelled rows show that it did not learn from: tp, fp, fn, f1, and brier, the mean squared error of the scores.

    Rows are dealt to folds by the hash of their text, so copies share one; each fold is scored by what the others teach. Only labelled rows take part,
    so whoever keeps rows aside passes the labels of the others alone. For choosing parameters."""
    ids = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    known = materialize(docs.select(id_col, text_col).join(ids, id_col).withColumn("__fold", F.pmod(_text_hash(F.col(text_col)), F.lit(folds))), "folds")
    out = []
    for setting in settings:
        scored = None
        for fold in range(folds):
            taught = known.filter(F.col("__fold") != fold).select(id_col, F.col("__y").alias(label_col))
            part = score_toxicity(known.filter(F.col("__fold") == fold), taught, id_col, text_col, label_col, corpus=known, carry=("__y",), **setting).select("__y", "score", "predicted")
            scored = part if scored is None else scored.union(part)
        y, p = F.col("__y"), F.col("predicted")
        r = scored.agg(F.sum(y * p).alias("tp"), F.sum((1 - y) * p).alias("fp"), F.sum(y * (1 - p)).alias("fn"), F.avg((F.col("score") - y) ** 2).alias("brier")).first()
        out.append({**setting, **r.asDict(), "f1": 2 * r["tp"] / max(1, 2 * r["tp"] + r["fp"] + r["fn"])})
    return out

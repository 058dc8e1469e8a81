"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

Each window of an item is a set of placed shingles, and a document holds the window only if it holds
all of them. So the necessary prefix is one shingle, the rarest of the window in the corpus. One pass
over the texts leaves of every document its runs: stretches covered by shingles that items have. From
there on all is relational: shingles of runs are counted, each window's rarest one joins the runs
that hold it, bounds of length and place drop windows that would not fit into their run, and the rest is
compared word for word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm import terms
from gristmill.llm.common import materialize

#: Words of a shingle; windows of fewer words are one shingle.
SHINGLE = 3
#: 3 places of a vocabulary of up to 2^20 entries fit in one long, beside the shingle's length.
_BASE = 1 << 20
_RUNS = "array<struct<start: int, ids: array<int>>>"


def windows_of(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(item, words): the distinct windows of each item, ``size`` consecutive words or all of fewer; none of an item without words."""
    words = items.select(F.col(id_col).alias("item"), terms.terms_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words")).distinct()


def _keys(ids: np.ndarray, s: int) -> np.ndarray:
    """The shingles of s places each that begin at every place; negative where one holds a place of no word."""
    key = np.full(len(ids) - s + 1, s, np.int64)
    for j in range(s):
        part = ids[j : len(ids) - s + 1 + j].astype(np.int64)
        key = np.where((key < 0) | (part < 0), -1, key * _BASE + part)
    return key


def _shingle_keys(ids: Column, size: int) -> Column:
    """array<struct<at, key>> of an array of places, as _keys makes them."""
    def key(at: Column, s: int) -> Column:
        total = F.lit(s).cast("bigint")
        for j in range(s):
            total = total * _BASE + F.get(ids, at + j).cast("bigint")
        return total

    return F.transform(F.sequence(F.lit(0), F.size(ids) - size), lambda at: F.struct(at.alias("at"), key(at, size).alias("key")))


def _find_runs(words: pa.Array, vocabulary: pa.Array, row: np.ndarray, rows: int, shingles: dict[int, np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Of each row the stretches of words that known shingles cover, and its number of words."""
    ids = terms.places(words, vocabulary).astype(np.int32)
    covered = np.zeros(len(ids), bool)
    for s, known in shingles.items():
        if len(ids) >= s:
            key = _keys(ids, s)
            at = np.flatnonzero((key >= 0) & (row[: len(key)] == row[s - 1 :]))
            place = np.searchsorted(known, key[at])
            at = at[known[np.minimum(place, len(known) - 1)] == key[at]]
            for j in range(s):
                covered[at + j] = True
    new = np.ones(len(ids), bool)
    new[1:] = row[1:] != row[:-1]
    first = covered & new
    first[1:] |= covered[1:] & ~covered[:-1]
    starts = np.flatnonzero(first)
    held = np.cumsum(covered)
    run_ends = np.append(held[starts] - 1, held[-1] if len(held) else 0).astype(np.int32)
    begins = np.searchsorted(row, np.arange(rows + 1))
    runs = pa.StructArray.from_arrays([pa.array((starts - begins[row[starts]]).astype(np.int32)), pa.ListArray.from_arrays(pa.array(run_ends), pa.array(ids[covered]))], names=["start", "ids"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, begins).astype(np.int32)), runs), np.diff(begins)


def document_runs(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str], shingles: dict[int, np.ndarray]) -> DataFrame:
    """(doc, h, n_words, runs) of every document; h: a hash of its text. Both lists are broadcast, so the caller bounds them."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, shingles))
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, known = pa.array(sent.value[0], pa.large_string()), sent.value[1]
        for batch in batches:
            for a, b in terms.pieces(batch.column(2)):
                words, row = terms.cut(batch.column(2).slice(a, b - a))
                runs, n = _find_runs(words, listed, row, b - a, known)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n.astype(np.int64)), runs], names=["doc", "h", "n_words", "runs"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], rows.schema["h"], T.StructField("n_words", T.LongType()), T.StructField("runs", T._parse_datatype_string(_RUNS))]))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, ids, key, offset): each window's rarest shingle; windows of which some shingle stands nowhere are out, no document can hold them."""
    each = windows.select("window", "ids", F.explode("shingles").alias("s")).select("window", "ids", "s.at", "s.key")
    met = each.join(counts, "key", "left")
    rarest = F.min(F.struct("n", "key", "at"))
    chosen = met.groupBy("window").agg(F.first("ids").alias("ids"), F.every(F.col("n").isNotNull()).alias("whole"), rarest.alias("rare"))
    return chosen.filter("whole").select("window", "ids", "rare.key", F.col("rare.at").alias("offset"))


def _block_hits(docs: DataFrame, id_col: str, text_col: str, windows: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    """(runs of the documents, (doc, h, start, stop, window) of the windows found) for windows (window, words) of one block."""
    vocabulary = sorted(r[0] for r in windows.select(F.explode("words")).distinct().collect())
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.array(sent.value, pa.large_string())
        for batch in batches:
            lists = batch.column(1)
            ids = terms.places(lists.flatten().cast(pa.large_string()), listed).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["window", "ids"])

    coded = windows.select("window", "words").mapInArrow(encode, "window bigint, ids array<int>")
    full = F.size("ids") >= SHINGLE
    made = F.when(full, _shingle_keys(F.col("ids"), SHINGLE))
    for s in range(1, SHINGLE):
        made = made.when(F.size("ids") == s, _shingle_keys(F.col("ids"), s))
    coded = materialize(coded.withColumn("shingles", made), "windows")
    known = [r["key"] for r in coded.select(F.explode("shingles.key").alias("key")).distinct().collect()]
    shingles = {s: np.array(sorted(k for k in known if k // _BASE**s == s), np.int64) for s in range(1, SHINGLE + 1)}
    sizes = [s for s, keys in shingles.items() if len(keys)]
    runs = materialize(document_runs(docs, id_col, text_col, vocabulary, {s: shingles[s] for s in sizes}), "runs")

    each = runs.select("doc", "h", F.explode("runs").alias("run"))
    keyed = F.flatten(F.array(*(F.when(F.size("run.ids") >= s, _shingle_keys(F.col("run.ids"), s)).otherwise(F.array().cast("array<struct<at: int, key: bigint>>")) for s in sizes))) if sizes else F.array().cast("array<struct<at: int, key: bigint>>")
    # a passage of many documents is counted once a task, not once a document, before the shuffle
    counts = each.select(F.explode(F.transform(keyed, lambda x: x["key"])).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    rare = materialize(prefixes(coded, counts), "prefixes")
    # only occurrences of prefixes go on; a key that a third of the documents hold is dealt over all salts
    met = each.select("doc", "h", "run", F.explode(keyed).alias("s")).select("doc", "h", "run", "s.at", "s.key", F.pmod(F.xxhash64("doc", "h"), F.lit(salts).cast("bigint")).alias("salt"))
    dealt = rare.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    tried = met.join(dealt, ["key", "salt"]).withColumn("from", F.col("at") - F.col("offset"))
    fits = tried.filter((F.col("from") >= 0) & (F.col("from") + F.size("ids") <= F.size("run.ids")))
    same = fits.filter(F.slice("run.ids", F.col("from") + 1, F.size("ids")) == F.col("ids"))
    start = F.col("run.start") + F.col("from")
    return runs, same.select("doc", "h", start.alias("start"), (start + F.size("ids")).alias("stop"), "window")


def covered(spans: Column) -> Column:
    """How many places an array of (start, stop) covers together."""
    def add(state: Column, span: Column) -> Column:
        more = F.greatest(span["stop"] - F.greatest(span["start"], state["reach"]), F.lit(0))
        return F.struct((state["n"] + more).alias("n"), F.greatest(state["reach"], span["stop"]).alias("reach"))

    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")), add, lambda s: s["n"].cast("bigint"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_windows: int = 100_000, salts: int = 16) -> DataFrame:
    """One row per document: id_col, n_words, n_hit, items, spans, contaminated.

    A window is ``window`` consecutive words of an item, or all words of an item that has fewer. n_hit
    counts the document's words inside any place where a window stands, spans lists those places as
    (start, stop), items the ids of the items that have them as sorted strings. Null and wordless texts have no words, and
    hold nothing and are held nowhere. Items without an id count in n_hit and spans, not in items;
    several texts of one item id count as one item. Repeated documents get a row each. Other columns are ignored.

    Windows go in blocks of about block_windows (so that a block's words and shingles, which are broadcast, are at most
    ``window`` times as many), each block against all documents; nothing is left out however many there are.
    """
    all_windows = windows_of(items, item_id_col, item_text_col, window)
    # equal hashes of unlike windows are told apart by the words
    named = all_windows.groupBy("words").agg(F.lit(1)).select("words", F.monotonically_increasing_id().alias("window"))
    named = materialize(named, "named")
    blocks = max(1, -(-named.count() // block_windows))
    if block_windows * window > _BASE:
        raise ValueError(f"a block's words must stay below {_BASE}")
    base, found = None, []
    for b in range(blocks):
        runs, hits = _block_hits(docs, id_col, text_col, named.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b), salts)
        base = runs if base is None else base
        found.append(materialize(hits, "hits"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    places = hits.groupBy("doc", "h").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    holders = all_windows.filter("item is not null").join(named, "words").select("window", F.col("item").cast("string").alias("item"))
    held = hits.select("doc", "h", "window").distinct().join(holders, "window").groupBy("doc", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = places.withColumn("items", F.lit(None).cast("array<string>")).unionByName(held.withColumn("spans", F.lit(None).cast("array<struct<start: int, stop: int>>")))
    one = both.groupBy(F.col("doc").alias("doc_"), F.col("h").alias("h_")).agg(F.max("spans").alias("spans"), F.max("items").alias("items"))
    out = base.select("doc", "h", "n_words").join(one, F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("h") == F.col("h_")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start: int, stop: int>>"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("doc").alias(id_col), "n_words", covered(spans).alias("n_hit"), items.alias("items"), spans.alias("spans"), F.col("spans").isNotNull().alias("contaminated"))

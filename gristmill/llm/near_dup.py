"""MinHash near-duplicates with odd sketches.

Documents with the same shingle set form one class, so copies never multiply. Each class has a MinHash
signature of ``bands * rows`` samples. Bands give candidates; the samples folded into a parity bitmap
(an odd sketch) estimate a candidate pair's similarity from the population count of the XOR of the two
bitmaps, and pairs that are certainly too far apart end there; the rest are confirmed on full sets.

Buckets are not expanded into all pairs. In each of two rounds every bucket's members are compared
with one center only, drawn by hash; then connected components are taken, and only buckets that still
hold several components go on: a large group of near copies is resolved by its stars. The sets of those
open members are ordered, rarest shingle first, and joined by shingle under a bound of what two sets can
still share from their places of that shingle on. That join is exact: it finds every link between open members, and
in a group of near copies it meets few other pairs, for what sets them apart is rare. A link at the
similarity bound is lost by banding with a chance below 1e-6, by its sketches in a star with one of about
1e-5, if nothing else joins its two documents; the pair join loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import forget, materialize

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


#: Rounds in which a bucket's members are compared with one center.
STAR_ROUNDS = 2
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


WHITE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def word_hashes(texts: list[bytes], apart: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, A-Z lower-cased, and the number of words of each text.

    Words are runs of bytes that ``apart`` does not mark, which must mark the line feed. Equal words hash alike in any text."""
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined.lower(), dtype=np.uint8)
    space = apart[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if raw.size and not space[0]:
        edge = np.concatenate([[0], edge])
    start, stop = edge[::2], edge[1::2]
    lengths = stop - start
    hashes = np.zeros(start.size, dtype=np.uint64)
    # one step for each position in a word: the words shorter than that have left
    order = np.argsort(-lengths, kind="stable")
    alive = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left") if start.size else np.zeros(0, int)
    short = min(64, alive.size)
    at = start[order]
    h = np.zeros(start.size, dtype=np.uint64)
    for i in range(short):
        n = alive[i]
        h[:n] = (h[:n] ^ _BYTE[raw[at[:n] + i]]) * _MIX2
        h[:n] ^= h[:n] >> np.uint64(29)
    hashes[order] = h
    for k in order[: alive[short] if alive.size > short else 0]:  # longer words, by eight bytes a step
        word = raw[start[k] + short : stop[k]].tobytes()
        word = np.frombuffer(word + b"\0" * (-len(word) % 8), dtype=np.uint64)
        x = int(hashes[k])
        for w in word.tolist():
            x = ((x ^ w) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
            x ^= x >> 29
        hashes[k] = x
    hashes = mix(hashes + lengths.astype(np.uint64) * _STEP)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(start, ends), prepend=0)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its shingles of k words; with fewer words but any, of all of them as one."""
    hashes, counts = word_hashes(texts)
    rolled = np.zeros(max(0, hashes.size - k + 1), dtype=np.uint64)
    for i in range(k):
        rolled = mix(rolled + _STEP) ^ hashes[i : i + rolled.size]
    rolled = mix(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(rolled[at : at + n - k + 1]))
        elif n:
            x = np.zeros(1, dtype=np.uint64)
            for h in hashes[at : at + n]:
                x = mix(x + _STEP) ^ h
            out.append(mix(x + np.uint64(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def minhash(sets: list[np.ndarray], samples: int) -> np.ndarray:
    """(len(sets), samples) uint32 MinHash values; all sets must be non-empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([s.size for s in sets])[:-1]])
    seeds = mix(np.arange(1, 2 * samples + 1, dtype=np.uint64) * _STEP)
    out = np.empty((len(sets), samples), dtype=np.uint32)
    for j in range(samples):
        out[:, j] = np.minimum.reduceat(((flat * (seeds[j] | np.uint64(1)) + seeds[samples + j]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def odd_sketches(signatures: np.ndarray, bits: int) -> np.ndarray:
    """(n, bits / 64) uint64 parity bitmaps: each sample (with its place) flips one bit."""
    n, samples = signatures.shape
    at = mix(signatures.astype(np.uint64) + np.arange(1, samples + 1, dtype=np.uint64) * _STEP) % np.uint64(bits)
    flips = np.zeros((n, bits), dtype=np.uint8)
    np.bitwise_xor.at(flips, (np.arange(n)[:, None], at.astype(np.int64)), 1)
    return np.packbits(flips, axis=1, bitorder="little").view(np.uint64)


def popcount_bound(samples: int, bits: int, similarity: float, sigmas: float = 4.5) -> int:
    """Population count of the XOR that a pair of at least this similarity exceeds with a chance of sigmas standard deviations only.

    Two independent errors add up: of the samples that differ, and of the bits on which their flips fall."""
    apart = samples * (1 - similarity)
    expected = bits / 2 * (1 - (1 - 2 / bits) ** (2 * apart))
    sampled = 4 * samples * similarity * (1 - similarity) * (1 - 2 / bits) ** (4 * apart)
    folded = bits / 4 * (1 - (1 - 2 / bits) ** (4 * apart))
    return int(min(bits, expected + sigmas * (sampled + folded) ** 0.5) + 1)


def sketch(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int, bits: int, key_col: str | None = None) -> DataFrame:
    """(id, n_shingles, fp, bands, odd), and with a key_col (a bigint) key: fp, a 128-bit hash of the shingle set, is null for an empty one, and so are bands and odd."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 256
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                sets = shingle_sets([(t or "").encode() for t in part.column(1).to_pylist()], k)
                full = [i for i, s in enumerate(sets) if s.size]
                fps, keys, odds = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    signatures = minhash([sets[i] for i in full], bands * rows)
                    folded = np.zeros((len(full), bands), dtype=np.uint64)
                    for r in range(rows):
                        folded = mix(folded + _STEP) ^ signatures[:, r::rows].astype(np.uint64)
                    folded = mix(folded + np.arange(1, bands + 1, dtype=np.uint64) * _STEP).view(np.int64)
                    odd = odd_sketches(signatures, bits).view(np.int64)
                    for j, i in enumerate(full):
                        fps[i] = fingerprint(sets[i])
                        keys[i], odds[i] = folded[j], odd[j]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([s.size for s in sets], pa.int64()), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(odds, pa.list_(pa.int64())), *part.columns[2:]],
                    names=["id", "n_shingles", "fp", "bands", "odd", *keys_],
                )

    keys_ = ["key"] if key_col else []
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"), *(F.col(key_col).alias(c) for c in keys_)).mapInArrow(run, ", ".join(["id bigint, n_shingles bigint, fp binary, bands array<bigint>, odd array<bigint>", *(f"{c} bigint" for c in keys_)]))


def fingerprint(s: np.ndarray) -> bytes:
    """128-bit hash of a set of 64-bit values."""
    return np.array([mix(s).sum(dtype=np.uint64), mix(s ^ _STEP).sum(dtype=np.uint64)]).tobytes()


def full_sets(texts: DataFrame, k: int) -> DataFrame:
    """(class_id, hashes): the full shingle sets of those rows (class_id, fp, t) whose text t has the set that fp names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                ids, fps, part = (c.to_pylist() for c in batch.slice(a, 256).columns)
                sets = shingle_sets([(t or "").encode() for t in part], k)
                found = [(i, s.view(np.int64)) for i, fp, s in zip(ids, fps, sets) if fingerprint(s) == fp]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.int64()))], names=["class_id", "hashes"])

    return texts.select("class_id", "fp", "t").mapInArrow(run, "class_id bigint, hashes array<bigint>")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(class_id, comp): the smallest class_id reachable from each node over links (a, b).

    Alternating large-star and small-star rounds, each written to the shared folder; only counts and
    one sum reach the driver. Nodes without links are their own component.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges, old = materialize(small.filter("u != v").distinct(), "edges"), edges
        forget(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.join(edges.groupBy(F.col("u").alias("class_id")).agg(F.min("v").alias("comp")), "class_id", "left").select("class_id", F.coalesce("comp", "class_id").alias("comp"))


def _apart(x: Column, y: Column) -> Column:
    """Population count of the XOR of two bitmaps of 64-bit words."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, n: s + n)


def rare_first_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of sets (class_id, comp, hashes) of unlike comp, among them all whose similarity is percent or more.

    A set's hashes stand in the order of how many sets hold them. If the first that two sets share stands
    at place i in x and at place j in y, they share min(|x| - i, |y| - j) at most, and a link needs
    (100 + percent) times that to reach percent * (|x| + |y|). So only a set's beginning is joined, and of
    two places one must be early: at (100 + percent) * (|x| - i) >= 2 * percent * |x|. Hashes that one set alone holds only take places.
    """
    tokens = sets.select("class_id", F.explode("hashes").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    shared = tokens.join(often, "token").groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    placed = sets.select("class_id", "comp", F.size("hashes").alias("n")).join(shared, "class_id")
    most = F.floor(F.col("n") * (100 - percent) / 100) + 1 - (F.col("n") - F.size("shared"))
    entries = placed.filter(most > 0).select("class_id", "comp", "n", F.size("shared").alias("left"), F.posexplode(F.slice("shared", F.lit(1), most.cast("int"))).alias("i", "at"))
    entries = entries.select(F.col("at.token").alias("token"), "class_id", "comp", "n", (F.col("left") - F.col("i")).alias("rest"))
    entries = materialize(entries.withColumn("early", F.col("rest") * (100 + percent) >= F.col("n") * (2 * percent)), "entries")
    other = entries.select("token", F.col("class_id").alias("y"), F.col("comp").alias("comp_y"), F.col("n").alias("n_y"), F.col("rest").alias("rest_y"), F.col("early").alias("early_y"))
    able = F.least("rest", "rest_y") * (100 + percent) >= (F.col("n") + F.col("n_y")) * percent
    met = entries.filter("early").alias("x").join(other.alias("o"), (F.col("x.token") == F.col("o.token")) & (F.col("comp") != F.col("comp_y")) & able & (~F.col("early_y") | (F.col("class_id") > F.col("y"))))
    return met.select(F.greatest("class_id", "y").alias("a"), F.least("class_id", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 36, rows: int = 5, bits: int = 512, key_col: str | None = None) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept.

    A text is lower-cased (A-Z) and cut at ASCII white space; its set holds the distinct shingles of k
    words, or with fewer words all of them as one. Two rows are linked if 100 * |intersection| >=
    percent * |union|. component_id is the smallest id that a row reaches; kept is id = component_id,
    so one document of each group stays. A null, empty or blank text has an empty set, is linked with
    nothing and is kept. A row with a null id can't stand for a group: it takes no part, its
    component_id is null and it is kept. Rows that repeat an id and its text share one result each;
    rows that repeat an id with different texts are judged apart. With a key_col, a bigint, each row has it too, and group:
    equal for the rows of a group and for no others, null for those that are in none. Other columns of docs are ignored.
    """
    sketches = materialize(sketch(docs, id_col, text_col, k, bands, rows, bits, key_col), "sketches")
    live = sketches.filter("fp is not null and id is not null")
    # a class is named by its smallest id; should two classes have that in common, by that and its set
    named = live.groupBy("fp").agg(F.min("id").alias("class_doc"))
    clash = named.groupBy("class_doc").agg(F.min("fp").alias("first_fp"))
    named = named.join(clash, "class_doc").select("fp", "class_doc", F.when(F.col("fp") == F.col("first_fp"), F.col("class_doc")).otherwise(F.xxhash64("class_doc", "fp")).alias("class_id"))
    named = materialize(named, "classes")
    one = live.join(named.select("fp", F.col("class_doc").alias("id"), "class_id"), ["fp", "id"]).dropDuplicates(["class_id"])
    reps = materialize(one.select("class_id", "id", "fp", "n_shingles", "bands", "odd"), "representatives")

    members = reps.select("class_id", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    members = materialize(members.join(shared, "bucket"), "buckets")
    wanted = members.select("class_id").distinct().join(reps.select("class_id", "id", "fp"), "class_id")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).join(wanted, "id")
    sets = materialize(full_sets(texts, k).dropDuplicates(["class_id"]), "sets")
    far = popcount_bound(bands * rows, bits, percent / 100)
    light = reps.select("class_id", "n_shingles", "odd")
    side = lambda x: light.select(F.col("class_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}"))

    def near(pairs: DataFrame) -> DataFrame:
        close = pairs.join(side("a"), "a").join(side("b"), "b")
        close = close.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).filter(_apart(F.col("odd_a"), F.col("odd_b")) <= far)
        return close.select("a", "b")

    def confirmed(close: DataFrame, among: DataFrame, at: int) -> DataFrame:
        x = close.join(among.select(F.col("class_id").alias("a"), F.col("hashes").alias("h_a")), "a").join(among.select(F.col("class_id").alias("b"), F.col("hashes").alias("h_b")), "b")
        both = F.size(F.array_intersect("h_a", "h_b"))
        return materialize(x.filter(both * 100 >= (F.size("h_a") + F.size("h_b") - both) * percent).select("a", "b"), f"links-{at}")

    nodes = reps.select("class_id")
    comp, links = nodes.withColumn("comp", F.col("class_id")), None
    for at in range(STAR_ROUNDS + 1):
        placed = members.join(comp, "class_id")
        open_ = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("bucket")
        placed = placed.join(open_, "bucket") if at else placed
        if at < STAR_ROUNDS:
            # a bucket's center is drawn by hash, one of four in a large group that shares all its buckets, and others in each round
            drawn = F.min(F.struct(F.xxhash64("class_id", F.lit(at), F.pmod("bucket", F.lit(4))), "class_id", "comp"))
            centers = placed.groupBy("bucket").agg(drawn.alias("c")).select("bucket", F.col("c.class_id").alias("y"), F.col("c.comp").alias("comp_y"))
            pairs = placed.join(centers, "bucket").filter("comp != comp_y").select(F.greatest("class_id", "y").alias("a"), F.least("class_id", "y").alias("b"))
            close, among = materialize(near(pairs.distinct()), f"candidates-{at}"), sets
        else:
            among = materialize(sets.join(placed.select("class_id", "comp").distinct(), "class_id"), "open")
            close = materialize(rare_first_pairs(among, percent), f"candidates-{at}")
        new = confirmed(close, among, at)
        links = links.union(new) if at else new
        comp = materialize(components(nodes, links), f"components-{at}")
        forget(close)
    forget(sets)
    smallest = comp.join(reps.select("class_id", "id"), "class_id").groupBy("comp").agg(F.min("id").alias("component_id"))
    label = named.join(comp, "class_id").join(smallest, "comp").select("fp", "component_id", F.col("comp").alias("group"))
    out = sketches.join(label, "fp", "left")
    own = F.when(F.col("fp").isNull() & F.col("id").isNotNull(), F.col("id")).when(F.col("id").isNotNull(), F.col("component_id"))
    more = [F.col("key").alias(key_col), F.when(F.col("id").isNotNull(), F.col("group")).alias("group")] if key_col else []
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"), *more).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))

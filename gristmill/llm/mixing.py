"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents, shuffled by a hash, form one stream of words, repeated ``most_repeats`` times and
cut into blocks of ``block_tokens`` words. Slots of the mix are golden-ratio points mapped through the
sources' cumulative targets; the slot of rank r among a source's takes the r-th block of its stream. A source
has as many slots as its own target fills, the last block cut to the word, so what it takes is its target at any
size of the corpus, and a small source is none the worse for large ones; what the points are short of by
their discrepancy closes the schedule.
Places in a stream and ranks of slots are sums in two levels: over groups first, then within each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import WS, materialize

#: Rows of a source's stream, and slots of a schedule, that are ordered in one task.
GROUP = 1 << 16
#: Cells of the unit interval in which points meet sources, at least.
CELLS = 1024


def text_size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"[^{WS}]+")).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most_repeats: float) -> DataFrame:
    """(source, source_size, target, no) of each source of sizes (source, size): one row a source.

    Sources by code point, null last, weigh by ``weights``, repeating. Of share * all sizes each gets its
    weight's part, but most_repeats times its size at most; what is over is shared again by weight among the rest, until
    none is above: sources are taken by the ratio of their limit to their weight, as long as the rest's level is above it.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("no", F.row_number().over(place) - 1)
    by = by.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), F.col("no") % len(weights)))
    by = by.withColumn("most", F.col("source_size") * F.lit(float(most_repeats)))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), "no")
    all_ = Window.partitionBy(F.lit(0))
    below = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", (F.sum("source_size").over(all_) * F.lit(float(share)) - below) / above)
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("no"), F.col("level").alias("level")))).over(all_)
    level = F.coalesce(level["level"], F.max(F.col("most") / F.col("weight")).over(all_))
    return by.withColumn("target", F.least(F.col("most"), level * F.col("weight"))).select("source", "source_size", "target", "no")


def schedule(by: DataFrame, n_slots: int, n_sources: int) -> DataFrame:
    """(no, rank, slot) of the slots of sources by (no, target, slots): rank counts a source's slots from 0, slot all of them from 0.

    Point j is the fractional part of j times the golden ratio, in 64-bit steps; it belongs to the source in whose part of
    the cumulative targets it falls. A source's points beyond its number of slots are void, and slots that it lacks follow at the end.
    """
    cells = max(CELLS, 2 * n_sources)
    total, order = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("no")
    high = F.sum("target").over(order) / F.sum("target").over(total)
    ranges = by.filter("slots > 0").withColumn("high", high).withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0)))
    ranges = ranges.withColumn("high", F.when(F.col("no") == F.max("no").over(total), F.lit(2.0)).otherwise(F.col("high")))
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    ranges = ranges.select("no", "slots", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    step, ring = F.lit("11400714819323198485").cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)")
    points = by.sparkSession.range(n_slots).select(F.col("id").alias("j"), (((F.col("id").cast("decimal(18,0)") * step) % ring).cast("double") / F.lit(2.0**64)).alias("u"))
    drawn = points.withColumn("cell", cell(F.col("u"))).join(ranges, "cell").filter("u >= low and u < high").select("j", "no", "slots", (F.col("j") / GROUP).cast("bigint").alias("part"))
    drawn = materialize(drawn, "slots")
    sums = drawn.groupBy("no", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("no").orderBy("part")) - F.col("n")
    sums = materialize(sums.withColumn("before", before), "ranks")
    ranked = drawn.join(sums, ["no", "part"]).select("no", "slots", (F.row_number().over(Window.partitionBy("no", "part").orderBy("j")) - 1 + F.col("before")).cast("bigint").alias("rank"), F.col("j").alias("slot"))
    had = sums.groupBy("no").agg(F.sum("n").alias("had"))
    lacking = by.join(had, "no", "left").withColumn("had", F.coalesce("had", F.lit(0).cast("bigint"))).filter("had < slots")
    closing = lacking.select("no", F.explode(F.sequence(F.col("had"), F.col("slots") - 1)).alias("rank"))
    closing = closing.select("no", "rank", (F.lit(n_slots) + F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rank", "no")) - 1).cast("bigint").alias("slot"))  # as many as the points' discrepancy
    return ranked.filter("rank < slots").select("no", "rank", "slot").unionByName(closing)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most_repeats: int = 2, seed: str = "mix", keep: tuple[str, ...] = (), block_tokens: int = 256) -> DataFrame:
    """One row per row of docs: id_col, the columns of keep, size, source_size, target, taken, first_slot.

    size is the number of words of the text (null: 0); taken, the words the mix takes of the row, repeats
    counted, is most_repeats * size at most; a source's sum of taken is its target, to the nearest word. first_slot is the
    smallest slot of the schedule that takes words of the row, null if none does. Reruns agree: the order is by
    md5(seed and id), then size; rows alike in both may change places. A null id is ordered as "". A null source
    is a source of its own, the last. Sources of no words get target 0. An empty table gives no rows. Other columns are
    ignored. The table of sources must fit a task: it has one row a source.
    """
    named = {c: f"__keep_{i}" for i, c in enumerate(keep)}
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_size(F.col(text_col)).alias("size"), *(F.col(c).alias(a) for c, a in named.items()))
    rows = materialize(rows.withColumn("h", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))), "sizes")
    words = F.least(F.round("target").cast("bigint"), F.col("source_size") * most_repeats).alias("words")
    by = targets(rows.select("source", "size"), weights, share, most_repeats).select("*", words)
    by = materialize(by.withColumn("slots", F.ceil(F.col("words") / block_tokens).cast("bigint")), "sources")
    count = by.agg(F.sum("slots").alias("slots"), F.count("*").alias("sources")).first()
    slots = schedule(by.select("no", "target", "slots"), count["slots"] or 0, count["sources"])
    # places in a source's stream: sums by hash bucket, then within a bucket
    buckets = max(1, rows.count() // GROUP)
    by_no = _with_source(rows, by.drop("slots")).withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * buckets / (1 << 32)))
    sums = by_no.groupBy("no", "bucket").agg(F.sum("size").alias("sum"))
    sums = sums.select("no", "bucket", (F.sum("sum").over(Window.partitionBy("no").orderBy("bucket")) - F.col("sum")).alias("offset"))
    within = F.sum("size").over(Window.partitionBy("no", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = by_no.withColumn("inner", within).join(sums, ["no", "bucket"]).withColumn("start", F.col("inner") + F.col("offset"))
    placed = materialize(placed.select("id", *named.values(), "no", "size", "source_size", "target", "words", "start"), "placed")
    # a row's words in each repeat of the stream, block by block
    turns = placed.filter("size > 0").select("no", "start", "size", "words", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("source_size") * (most_repeats - 1), F.col("source_size"))).alias("low")).filter("low < words")
    parts = turns.withColumn("high", F.least(F.col("low") + F.col("size"), F.col("words")))
    parts = parts.select("no", "start", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / block_tokens), F.floor((F.col("high") - 1) / block_tokens))).alias("rank"))
    met = parts.join(slots, ["no", "rank"])
    inside = F.least("high", (F.col("rank") + 1) * block_tokens) - F.greatest("low", F.col("rank") * block_tokens)
    taken = met.groupBy("no", "start").agg(F.sum(inside).cast("bigint").alias("taken"), F.min("slot").alias("first_slot"))
    out = placed.filter("size > 0").join(taken, ["no", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("bigint")))
    blank = placed.filter("size = 0").withColumns({"taken": F.lit(0).cast("bigint"), "first_slot": F.lit(None).cast("bigint")})
    columns = [F.col("id").alias(id_col), *(F.col(a).alias(c) for c, a in named.items()), "size", "source_size", "target", "taken", "first_slot"]
    return out.select(*columns).unionByName(blank.select(*columns))


def _with_source(rows: DataFrame, by: DataFrame) -> DataFrame:
    """rows with their source's columns; a plain join, which Spark broadcasts while the source table is small and splits by skew beyond."""
    side = by.withColumnRenamed("source", "source_")
    return rows.join(side, F.col("source").eqNullSafe(F.col("source_")), "inner").drop("source_", "source")

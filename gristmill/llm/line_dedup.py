"""Line dedup by distinct-site spread, in DataFrame functions only.

Each line hash gets a HyperLogLog sketch of the sites it stands on; sketches merge in aggregation, so a
line on a third of all pages costs one sketch a task. Lines whose estimate is near the threshold get
an exact distinct count, the others are decided by the sketch. Lines on enough sites are boilerplate: they
stay in the one document that holds them first and go from all others.

Texts are cut into lines and hashed once, into a table of hashes, sites and holders; only the last pass reads texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import let, materialize, row_key

_WHITE = " \t\n\x0b\x0c\r"


def line_hashes(lines: Column) -> Column:
    """Hashes of lines, without the white space at their ends; null for a blank line."""
    return F.transform(lines, lambda line: let(F.btrim(line, F.lit(_WHITE)), lambda bare: F.when(bare != "", F.xxhash64(bare))))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def spread_lines(lines: DataFrame, min_sites: int, lg_k: int, band: float) -> DataFrame:
    """(h, none, id, key): those lines (h, site, none, id, key) that stand on min_sites sites or more, with their first holder."""
    first = F.min(F.struct("none", "id", "key")).alias("first")
    sketched = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"), first, F.count("*").alias("n"))
    low, high = min_sites * (1 - band) - 1, min_sites * (1 + band) + 1
    many = materialize(sketched.filter((F.col("n") >= min_sites) & (F.col("sites") >= low)), "many")
    near = many.filter(F.col("sites") <= high)
    # sites of a near line: each task hands on a line's distinct sites only
    exact = lines.join(near.select("h"), "h", "left_semi").groupBy("h", "site").agg(F.lit(1)).groupBy("h").agg(F.count("site").alias("sites")).filter(F.col("sites") >= min_sites)
    return many.filter(F.col("sites") > high).select("h", "first.*").unionByName(near.join(exact.select("h"), "h", "left_semi").select("h", "first.*"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, lg_k: int = 12, band: float = 0.1, keep_first: bool = True) -> DataFrame:
    """docs with boilerplate lines taken from text_col, and the columns n_lines and n_removed added.

    Lines end at a line feed and are compared without white space at their ends; blank lines always
    stay. A line on min_sites distinct sites or more is boilerplate and goes from every row, but (with
    keep_first) for the row of the smallest id, null ids last, that holds it: ties there are rows of
    one id, told apart by text. A null site is no site. A text of which no line goes is unchanged, null
    stays null with n_lines 0; a text all of whose lines go becomes empty. Repeated rows share one
    result each. Other columns stay as they are, whatever their names; columns n_lines and n_removed are replaced.
    """
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed", text_col)]
    at = lambda c: docs[f"`{c}`"]
    keyed = docs.select(F.struct(*(at(c) for c in others)).alias("row"), at(id_col).alias("id"), at(text_col).alias("text"), at(site_col).alias("site"), row_key(at(id_col), at(text_col)).alias("key"))
    cut = keyed.select("site", F.col("id").isNull().alias("none"), "id", "key", F.explode(F.array_distinct(line_hashes(lines_of(F.col("text"))))).alias("h"))
    lines = materialize(cut.filter("h is not null"), "lines")
    spread = spread_lines(lines, min_sites, lg_k, band).select(F.col("h"), F.col("none").alias("first_none"), F.col("id").alias("first_id"), F.col("key").alias("first_key"))
    gone = lines.join(spread, "h")
    if keep_first:
        gone = gone.filter(~((F.col("key") == F.col("first_key")) & F.col("id").eqNullSafe(F.col("first_id"))))
    gone = gone.groupBy(F.col("key").alias("key_"), F.col("id").alias("id_")).agg(F.collect_set("h").alias("gone"))
    same = (F.col("key") == F.col("key_")) & F.col("id").eqNullSafe(F.col("id_"))
    found = keyed.join(gone, same, "left")
    kept = lambda parts: F.filter(F.arrays_zip(parts.alias("line"), line_hashes(parts).alias("h")), lambda x: x["h"].isNull() | ~F.array_contains(F.col("gone"), F.coalesce(x["h"], F.lit(0).cast("bigint"))))
    joined = lambda zipped: F.struct(F.array_join(F.transform(zipped, lambda x: x["line"]), "\n").alias("text"), F.size(zipped).cast("bigint").alias("n"))
    stay = let(lines_of(F.col("text")), lambda parts: let(kept(parts), joined))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("bigint")
    out = found.select("row", "text", n_lines.alias("n_lines"), F.when(F.col("gone").isNotNull(), stay).alias("stay"))
    value = {c: F.col("row").getField(c) for c in others} | {text_col: F.coalesce("stay.text", "text")}
    return out.select(*(value[c].alias(c) for c in docs.columns if c in value), "n_lines", F.coalesce(F.col("n_lines") - F.col("stay.n"), F.lit(0).cast("bigint")).alias("n_removed"))

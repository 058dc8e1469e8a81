"""Operators on a product table: ord bigint, the eight exported columns, source, source_detail, category; texts are '' where missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window  # noqa: F401
from pyspark.sql import functions as F

from gristmill.functions import lexicon as lex
from gristmill.functions import markup as mk
from gristmill.functions import scalar as fn
from gristmill.sources.tables import written

MERGED = ["product_image", "sku_upc", "product_name", "color", "msrp", "your_cost", "qty"]


def normalize(products: DataFrame) -> DataFrame:
    """Clean every field; an empty quantity becomes Catalog."""
    qty = fn.clean_qty(F.col("qty"))
    return products.withColumns({
        "product_name": fn.clean_text(F.col("product_name")), "color": fn.clean_text(F.col("color")), "notes": fn.clean_text(F.col("notes")),
        "sku_upc": fn.clean_sku(F.col("sku_upc")), "msrp": fn.normalize_price(F.col("msrp")), "your_cost": fn.normalize_price(F.col("your_cost")),
        "qty": F.when(qty == "", "Catalog").otherwise(qty),
    })


def is_page_title(name: Column) -> Column:
    parts = F.transform(F.split(name, r"\|"), lambda p: F.lower(fn.strip(p)))
    opens = F.exists(parts, lambda p: fn.starts_with_any(p, lex.TITLE_OPENERS))
    return opens | (F.size(parts) >= 3) | F.exists(parts, lambda p: fn.contains_any(p, ["recipe", "cookbook", "book"]))


def is_non_product(name: Column) -> Column:
    return fn.let(fn.strip(name), _is_non_product)


def _is_non_product(name: Column) -> Column:
    low = F.lower(name)
    has = lambda c: F.col(c) != ""
    bare = ~has("sku_upc") & ~has("msrp")
    words = F.size(F.filter(F.split(name, r"\s+"), lambda w: w != ""))
    return (
        ((name == "") & ~has("sku_upc"))
        | (bare & ((F.length(name) < 5) | name.endswith(")") | name.endswith("-")))
        | fn.contains_any(low, lex.PROMO_PHRASES + lex.NON_PRODUCT_PHRASES)
        | low.isin(lex.NON_PRODUCT_NAMES)
        | (bare & (name.contains("|") | fn.ends_with_any(low, lex.SITE_ENDINGS)) & is_page_title(name))
        | (bare & ~has("your_cost") & ~has("product_image") & (words <= 2) & ~name.rlike(r"\d"))
    )


def filter_non_products(products: DataFrame) -> DataFrame:
    # an explode, not a filter, which would be moved ahead of the exchange that deals the rows out, into one task, and clean each name many times
    kept = F.explode(F.filter(F.array("product_name"), lambda n: ~is_non_product(n)))
    return products.select(*(kept.alias(c) if c == "product_name" else F.col(c) for c in products.columns))


def data_score() -> Column:
    """Completeness of a row, 0 to 12."""
    points = {"product_image": 3, "sku_upc": 2, "product_name": 2, "color": 1, "msrp": 1, "your_cost": 1, "qty": 1, "notes": 1}
    return reduce(lambda a, b: a + b, [F.when(F.col(c) != "", n).otherwise(0) for c, n in points.items()])


def merge_groups(rows: DataFrame, key: str) -> DataFrame:
    """One row per key: the most complete row (ties to the smaller ord), its empty merged fields filled from the next rows.

    All of it is one aggregation with partial results in each task, so a key with a third of all rows stays cheap.
    """
    rank = [(-data_score()).alias("r"), F.col("ord").alias("o")]
    rest = [c for c in rows.columns if c not in (*MERGED, key)]
    best = F.min(F.struct(*rank, *(F.col(c).alias(f"x_{c}") for c in rest))).alias("best")
    fills = [F.min(F.when(F.col(c) != "", F.struct(*rank, F.col(c).alias("v")))).alias(f"f_{c}") for c in MERGED]
    out = rows.groupBy(key).agg(best, *fills)
    value = {c: F.coalesce(F.col(f"f_{c}.v"), F.lit("")) for c in MERGED} | {c: F.col(f"best.x_{c}") for c in rest}
    return out.select(*(value[c].alias(c) for c in rows.columns if c != key))


def _lower(c: str) -> Column:
    return F.lower(fn.strip(F.col(c)))


def dedupe_by_sku(products: DataFrame) -> DataFrame:
    """Rows with a SKU, one per SKU and colour."""
    keyed = products.filter(fn.strip(F.col("sku_upc")) != "").withColumn("key", F.concat(_lower("sku_upc"), F.lit("|"), _lower("color")))
    return merge_groups(keyed, "key")


def dedupe_by_name(products: DataFrame) -> DataFrame:
    """Rows without a SKU, one per name and colour; those without a name all stay."""
    bare = products.filter(fn.strip(F.col("sku_upc")) == "")
    name = _lower("product_name")
    keyed = bare.filter(name != "").withColumn("key", F.when(_lower("color") != "", F.concat(name, F.lit("|"), _lower("color"))).otherwise(name))
    return bare.filter(name == "").unionByName(merge_groups(keyed, "key"))


def lower_name() -> Column:
    return _lower("product_name")


def without_phantoms(scored: DataFrame, name: str, score: str) -> DataFrame:
    """Rows of (name, score, …) without those whose name another name strictly extends, if a row of that longer name has at least their score.

    Distinct names with their best score are exploded into prefixes, which meet names by equality: the work grows with
    the length of the names, not with the square of their number.
    """
    names = scored.filter(F.col(name) != "").groupBy(F.col(name).alias("__prefix")).agg(F.max(score).alias("top"))
    longer = names.filter(F.length("__prefix") > 1).select("top", F.explode(F.transform(F.sequence(F.lit(1), F.length("__prefix") - 1), lambda k: F.substring(F.col("__prefix"), F.lit(1), k))).alias("__prefix"))
    over = longer.join(names.select("__prefix"), "__prefix", "left_semi").groupBy("__prefix").agg(F.max("top").alias("__over"))
    return scored.join(over, F.col(name) == F.col("__prefix"), "left").filter(F.coalesce(F.col("__over") < F.col(score), F.lit(True))).select(*scored.columns)


def remove_phantoms(products: DataFrame) -> DataFrame:
    """Products without those whose name another name strictly extends, if a row of that longer name is at least as complete."""
    # three branches read these rows; written, they are made once
    scored = written(products.withColumn("__score", data_score()).withColumn("__name", lower_name()), "scored")
    return without_phantoms(scored, "__name", "__score").select(*products.columns)


def product_key() -> Column:
    """SKU and colour, name and colour without a SKU, or the row itself without both."""
    name, color = _lower("product_name"), _lower("color")
    return (
        F.when(fn.strip(F.col("sku_upc")) != "", F.concat(F.lit("s|"), _lower("sku_upc"), F.lit("|"), color))
        .when(name != "", F.concat(F.lit("n|"), name, F.when(color != "", F.concat(F.lit("|"), color)).otherwise("")))
        .otherwise(F.concat(F.lit("r|"), F.col("ord").cast("string")))
    )


def deduplicate(products: DataFrame) -> DataFrame:
    """One row per SKU and colour, per name and colour without a SKU, and all rows without both; then without phantoms. One aggregation keys all three kinds."""
    return remove_phantoms(merge_groups(products.withColumn("key", product_key()), "key"))


def clean(products: DataFrame) -> DataFrame:
    """Normalise, filter, deduplicate."""
    return deduplicate(filter_non_products(normalize(products)))


def title_score(title: Column) -> Column:
    t = fn.strip(title)
    low = F.lower(title)
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    n = F.size(words)
    hits = reduce(lambda a, b: a + b, [F.when(low.contains(p), 1).otherwise(0) for p in lex.MERCH_PHRASES])
    steps = [
        F.when(n < 2, -0.20).when(n > 12, -0.18).otherwise(0.0),
        F.when(t.rlike(r"[.!?]$"), -0.10).otherwise(0.0),
        F.when(title.rlike("(?i)" + lex.CONNECTORS), -0.22).otherwise(0.0),
        F.when(F.get(words, F.lit(0)).isin(lex.SENTENCE_OPENERS), -0.18).otherwise(0.0),
        F.least(hits, F.lit(3)) * F.lit(-0.10),
        F.when(low.rlike(r"\bwith\b.{5,}") & (n > 5), -0.10).otherwise(0.0),
        F.when(fn.contains_any(low, lex.PRODUCT_NOUNS), 0.10).otherwise(0.0),
        F.when(t.rlike(r"^([A-Z][a-z]*[\s\-]?)+$") & n.between(2, 8), 0.05).otherwise(0.0),
        F.when(title.rlike(r"\b[A-Z]{1,4}\d{2,}|\b\d{4,}\b"), 0.10).otherwise(0.0),
    ]
    return F.when(t == "", -0.25).otherwise(reduce(lambda a, b: a + b, steps))


def product_score(page_url: Column, page_type: Column) -> Column:
    sku, price = F.length(F.col("sku_upc")) >= 3, fn.parsed_price(F.col("msrp")) > 0
    image = F.col("product_image")
    detail = F.when(F.col("source_detail") != "", F.col("source_detail")).otherwise(page_url)
    plus = lambda test, x: F.when(test, x).otherwise(0.0)
    steps = [
        F.lit(0.5), plus(sku, 0.20), plus(price, 0.15), plus(image.startswith("http"), 0.05), plus(F.col("color") != "", 0.05), plus(page_type == "pdp", 0.10),
        F.when(page_url == "", 0.0).when(fn.product_url(page_url), 0.10).when(~fn.non_product_url(page_url), 0.03).otherwise(0.0),
        plus(fn.product_url(detail), 0.08), title_score(F.col("product_name")),
        plus(F.col("sku_upc") == "", -0.08), plus(~price & (F.col("sku_upc") == ""), -0.08), plus(image == "", -0.05),
    ]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), reduce(lambda a, b: a + b, steps)))


def bucket(score: Column) -> Column:
    return F.when(score >= 0.65, "confirmed").when(score >= 0.40, "likely").when(score >= 0.15, "uncertain").otherwise("suppressed")


def page_links(pages: DataFrame, pattern: str) -> DataFrame:
    """(page_id, link): distinct links of a page to its own host whose path fits the pattern."""
    anchors = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)<a\b[^>]*?\shref\s*=\s*(["'][^"']*["']|[^\s"'>]+)"""), 1)).alias("href"))
    hrefs = anchors.select("page_id", "url", mk.unescape(F.regexp_replace("href", "[\"']", "")).alias("href"))
    out = hrefs.withColumn("link", fn.absolute_url(F.col("url"), F.col("href"))).filter(fn.url_host(F.col("link")) == fn.url_host(F.col("url")))
    return out.filter(~fn.non_product_path(F.col("link")) & fn.url_path(F.col("link")).rlike("(?i)" + pattern)).select("page_id", "link").distinct()


def stats(products: DataFrame) -> DataFrame:
    named = (F.col("product_name") != "") | (F.col("sku_upc") != "")
    return products.agg(F.count("*").alias("n_rows"), F.count_if(named).alias("n_named"), F.count_if(F.col("product_image") != "").alias("n_images"))


def sheet_name(c: Column) -> Column:
    s = F.substring(F.regexp_replace(c, r"[\\/*?\[\]:]", ""), 1, 31)
    return F.when(s == "", "Sheet").otherwise(s)


def sheets(products: DataFrame) -> DataFrame:
    """(sheet, n_rows, first_ord): one row per category, blank ones under Uncategorized."""
    group = F.when(F.col("category") == "", "Uncategorized").otherwise(F.col("category"))
    return products.groupBy(sheet_name(group).alias("sheet")).agg(F.count("*").alias("n_rows"), F.min("ord").alias("first_ord"))

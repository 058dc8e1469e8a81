"""Scalar functions as column expressions. Missing text is '' in a product table, never null; inputs are taken as such."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions import lexicon as lex


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, and standing once in the plan, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _either(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def contains_any(c: Column, phrases: list[str]) -> Column:
    return c.rlike(_either(phrases))


def starts_with_any(c: Column, words: list[str]) -> Column:
    return c.rlike(f"^(?:{_either(words)})")


def ends_with_any(c: Column, words: list[str]) -> Column:
    return c.rlike(f"(?:{_either(words)})$")


def dollars(x: Column) -> Column:
    return F.concat(F.lit("$"), F.call_function("format_number", x, F.lit("0.00")))


def clean_text(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_sku(c: Column) -> Column:
    """A trailing .0 goes from a number; $ before four digits is a misread S."""
    s = strip(c)
    return F.when(s.rlike(r"^\d+\.0$"), F.regexp_replace(s, r"\.0$", "")).when(s.rlike(r"^\$\d{4,}"), F.concat(F.lit("S"), F.substring(s, 2, 1 << 30))).otherwise(s)


def sheet_sku(c: Column) -> Column:
    """A plain whole number loses leading zeros, fraction and exponent; all else stays. It is held as a double, as sheets hold numbers, and written to its last digit; from 8e34 on it stays as it is."""
    def of(s: Column) -> Column:
        x = F.when(s.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))
        high = F.floor(x / float(1 << 53))
        exact = high.cast("decimal(20,0)") * F.lit(1 << 53).cast("decimal(16,0)") + (x - high.cast("double") * float(1 << 53)).cast("bigint").cast("decimal(20,0)")
        return F.when((x == F.rint(x)) & (F.abs(x) < 8e34), exact.cast("decimal(38,0)").cast("string")).otherwise(s)

    return let(strip(c), of)


def normalize_price(c: Column) -> Column:
    """The first number with two decimals, a comma read as a decimal point: $1,579.99 gives $1.57, as it always did."""
    n = F.regexp_extract(c, r"(\d+(?:[.,]\d{1,2})?)", 1)
    return F.when(n != "", dollars(F.regexp_replace(n, ",", ".").try_cast("double"))).otherwise(c)


def sheet_price(c: Column) -> Column:
    """Digits and dots only, as dollars; what is no number then stays as it was."""
    x = F.regexp_replace(c, r"[^\d.]", "")
    return F.when(x.rlike(r"^(\d+\.?\d*|\.\d+)$"), dollars(x.try_cast("double"))).otherwise(c)


def clean_qty(c: Column) -> Column:
    s = strip(c)
    return F.when(s.rlike(r"^\d+\.0$"), F.regexp_replace(s, r"\.0$", "")).otherwise(s)


def grouped_dollars(x: Column) -> Column:
    """$X,XXX.cc; cents are rounded apart from the whole, half to even."""
    def of(x: Column) -> Column:
        whole = F.floor(x)
        cents = F.bround((x - whole) * 100).cast("int").cast("string")
        cents = F.when(F.length(cents) < 2, F.lpad(cents, 2, "0")).otherwise(cents)
        return F.when(x >= 1000, F.concat(F.lit("$"), F.format_number(whole, 0), F.lit("."), cents)).otherwise(dollars(x))

    return let(x, of)


def _sane_price(number: Column, raw: Column) -> Column:
    """The number as a price; below 10, the first run of four digits over 100 in the text stands for it."""
    runs = F.filter(F.regexp_extract_all(F.regexp_replace(raw, ",", ""), F.lit(r"\d{4,}"), 0), lambda r: r.try_cast("double") > 100)
    large = F.get(runs, F.lit(0)).try_cast("double")
    return grouped_dollars(let(F.regexp_replace(number, ",", "").try_cast("double"), lambda x: F.when(x < 10, F.coalesce(large, x)).otherwise(x)))


def web_price(c: Column) -> Column:
    """A price out of any text: a plain number, else the first marked with a currency sign, else the first bare one, else ''."""
    def of(raw: Column) -> Column:
        found = lambda pattern, other: let(F.regexp_extract(raw, pattern, 1), lambda n: F.when(n != "", _sane_price(n, raw)).otherwise(other))
        number = let(F.regexp_replace(raw, ",", ""), lambda plain: F.when(plain.rlike(r"^\+?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double")))
        return let(number, lambda n: F.when(n.isNotNull(), grouped_dollars(n)).otherwise(found(lex.PRICE_MARKED, found(lex.PRICE_BARE, F.lit("")))))

    return let(strip(c), of)


def best_price(c: Column) -> Column:
    """The first labelled price of a text, else the first marked one, else ''."""
    grouped, plain = (F.regexp_extract(c, "(?i)" + lex.PRICE_LABEL + n, 1) for n in (r"(\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?)", r"(\d+(?:\.\d{1,2})?)"))
    found = F.coalesce(*(let(x, lambda n: F.when(n != "", n)) for x in (grouped, plain, F.regexp_extract(c, lex.PRICE_MARKED, 1))))
    return let(found, lambda n: F.when(n.isNotNull(), _sane_price(n, c)).otherwise(""))


def parsed_price(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"[^\d.]", "").try_cast("double"), F.lit(0.0))


def valid_sku(c: Column) -> Column:
    s = strip(c)
    bad = (F.length(s) > 50) | s.rlike("(?i)" + lex.SKU_JUNK) | (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) > 3) | s.rlike("[$€£]")
    return F.when(~bad & s.rlike(r"^[A-Za-z0-9][\w\-.]{2,29}$"), s).otherwise("")


def qty_value(c: Column) -> Column:
    """12K gives 12,000; a leading whole number is grouped; a label before it goes; all else stays."""
    s = strip(F.regexp_replace(strip(c), r"(?i)^(?:ATS|QTY|MOQ|AVAIL)[:\s]+", ""))
    thousands, whole = F.regexp_extract(s, r"^(\d+(?:\.\d+)?)\s*[Kk]$", 1), F.regexp_extract(s, r"^(\d[\d,]*)", 1)
    grouped = F.format_number(F.regexp_replace(whole, ",", "").try_cast("bigint"), 0)
    return F.when(thousands != "", F.format_number(F.floor(thousands.try_cast("double") * 1000), 0)).when(whole != "", grouped).otherwise(s)


def qty_in_text(c: Column) -> Column:
    patterns = (r"\b(\d+(?:\.\d+)?)\s*[Kk]\b", r"(?i)\b(\d[\d,]*)\s*(?:ea|pcs?|units?|each|pieces?)\b", r"(?i)\b(?:ATS|QTY|MOQ|AVAIL)[:\s]+(\d[\d,]*(?:\.\d+)?(?:\s*[Kk])?)\b")
    found = F.coalesce(*(F.nullif(F.regexp_extract(c, p, 0), F.lit("")) for p in patterns))
    return F.coalesce(let(found, qty_value), F.lit(""))


def product_indicators(c: Column) -> Column:
    return c.rlike(r"\$\s*\d") | c.rlike(r"[A-Z]\d{4,}") | c.rlike(r"(?i)msrp") | c.rlike(r"\b\d+\s*[Kk]\b") | c.rlike(r"(?i)\b\d+\s*ea\b")


def url_path(u: Column) -> Column:
    return F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def url_host(u: Column) -> Column:
    return F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)


def non_product_path(u: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(url_path(u)), "/"), F.array(*(F.lit(s) for s in lex.NON_PRODUCT_SEGMENTS)))


def product_url(u: Column) -> Column:
    return u.rlike("(?i)" + lex.PDP_URL)


def non_product_url(u: Column) -> Column:
    return u.rlike("(?i)" + lex.NON_PRODUCT_URL)


def _fold_dots(path: Column) -> Column:
    """A path without its . and .. steps."""
    drop = lambda held: F.when(F.size(held) > 1, F.slice(held, F.lit(1), F.size(held) - 1)).otherwise(held)
    folded = lambda steps: F.aggregate(F.slice(steps, 2, 1 << 20), F.array(F.lit("")), lambda held, x: F.when(x == "..", drop(held)).when(x == ".", held).otherwise(F.concat(held, F.array(x))))
    return F.array_join(let(F.split(path, "/"), lambda steps: F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(folded(steps), F.array(F.lit("")))).otherwise(folded(steps))), "/")


def absolute_url(base: Column, href: Column) -> Column:
    """href seen from base, without its fragment."""
    return let(F.regexp_replace(href, "#.*$", ""), lambda h: _resolved(base, h))


def _resolved(base: Column, h: Column) -> Column:
    plain = F.regexp_replace(base, "#.*$", "")
    scheme, root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1), F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    query, folder = F.regexp_extract(h, r"(\?.*)$", 1), let(F.regexp_extract(url_path(base), r"^(.*/)[^/]*$", 1), lambda x: F.when(x == "", "/").otherwise(x))
    merged = let(F.regexp_replace(h, r"\?.*$", ""), lambda steps: F.when(steps.startswith("/"), steps).otherwise(F.concat(folder, steps)))
    resolved = F.concat(root, _fold_dots(merged), query)
    bare = F.regexp_replace(plain, r"\?.*$", "")
    return F.when(h == "", plain).when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), h).when(h.startswith("//"), F.concat(scheme, h)).when(h.startswith("?"), F.concat(bare, h)).otherwise(resolved)


def page_type(u: Column) -> Column:
    """The kind of a page as far as its URL tells."""
    low = F.lower(u)
    return (
        F.when(low.rlike(r"(/search\?|/search/|\?q=|&q=|/find\?)"), "search")
        .when(low.rlike(r"/(blog|article|editorial|guide|inspiration|about|contact|faq|press)/"), "editorial")
        .when(low.rlike(r"^https?://[^/]+/?$"), "homepage")
        .when(low.rlike(r"(/category/|/collection[s]?/|/catalog/|/c/|/shop/)"), "category")
        .otherwise("unknown")
    )


def title_case(c: Column) -> Column:
    """Upper case after any character that is no letter."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), 1), F.initcap), "")


def looks_like_color(c: Column) -> Column:
    low = F.lower(strip(c))
    return ~low.rlike(lex.SIZES) & (starts_with_any(low, lex.COLORS) | (~c.rlike(r"\d") & (F.length(c) < 30)))


def color_in_name(c: Column) -> Column:
    """The first part after a separator that begins with a known colour, else such a text in parentheses, in title case, else ''."""
    known = lambda x: starts_with_any(F.lower(F.trim(x)), lex.COLORS)
    parts = [F.get(F.filter(F.slice(F.split(c, s), 2, 1 << 20), known), F.lit(0)) for s in (" - ", " / ", r" \| ", ", ")]
    inner = F.nullif(F.regexp_extract(c, r"\(([^)]+)\)", 1), F.lit(""))
    found = F.coalesce(*parts, F.when(known(inner), inner))
    return F.coalesce(title_case(F.trim(found)), F.lit(""))


def cache_file(url: Column) -> Column:
    """File name under which an image is cached: the URL's MD5 and its path's ending, if that is one of an image, else .jpg."""
    endings = "|".join(e[1:] for e in lex.CACHED_ENDINGS)
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    ending = F.regexp_extract(path, rf"(?i)[^/](\.(?:{endings}))/*(?:;[^/]*)?$", 1)
    return F.concat(F.md5(url.cast("binary")), F.when(ending == "", ".jpg").otherwise(ending))

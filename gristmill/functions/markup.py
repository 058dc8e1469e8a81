"""Column expressions over HTML text: tags, attributes, element texts. Regular expressions, so elements of one tag inside each other are not told apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions import scalar as fn


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of an opening tag, '' if it is not there."""
    found = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""", 0)
    return unescape(F.regexp_extract(found, r"""(?s)=\s*(["']?)(.*)\1$""", 2))


def unescape(c: Column) -> Column:
    for code, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def text(html: Column) -> Column:
    """The text of markup, each piece stripped, joined without anything between."""
    pieces = F.split(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", ""), r"(?s)<[^>]*>")
    return unescape(F.array_join(F.transform(pieces, fn.strip), ""))


def tags(html: Column, name: str) -> Column:
    """All opening tags of a name."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), 0)


def scripts(html: Column, having: str) -> Column:
    """The contents of script elements whose opening tag fits a pattern."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<script\b(?=[^>]*{having})[^>]*>(.*?)</script>"), 1)


def meta(html: Column, name: str) -> Column:
    """The content of the first meta tag of a property, null if there is none."""
    found = F.get(F.filter(tags(html, "meta"), lambda t: attribute(t, "property") == name), F.lit(0))
    return F.when(found.isNotNull(), attribute(found, "content"))


# selectors as patterns of an opening tag
def with_attribute(name: str, value: str | None = None) -> str:
    return rf"<[a-z][a-z0-9]*\b(?=[^>]*\s{name}" + (rf"""\s*=\s*["']{value}["']""" if value else r"[\s=/>]") + r")[^>]*>"


def class_holds(part: str) -> str:
    return rf"""<[a-z][a-z0-9]*\b(?=[^>]*\sclass\s*=\s*["'][^"']*{part})[^>]*>"""


def of_class(name: str, tag: str = "[a-z][a-z0-9]*") -> str:
    return rf"""<{tag}\b(?=[^>]*\sclass\s*=\s*["'](?:[^"']*\s)?{name}[\s"'])[^>]*>"""


def element(html: Column, selector: str) -> tuple[Column, Column]:
    """(opening tag, text) of the first element that a selector finds; '' if none."""
    tag = F.regexp_extract(html, f"(?s){selector}", 0)
    inner = F.regexp_extract(html, rf"(?s)(?=<([a-zA-Z0-9]+)){selector}(.*?)</\1\s*>", 2)
    return tag, text(inner)


def elements(html: Column, selectors: list[str]) -> Column:
    """array<struct<tag, text>>: the first element of each selector, '' where it finds none. One expression, however many selectors."""
    def first(selector: Column) -> Column:
        whole = F.call_function("regexp_extract", html, F.concat(F.lit(r"(?s)(?=<([a-zA-Z0-9]+))"), selector, F.lit(r"(.*?)</\1\s*>")), F.lit(0))
        tag = F.call_function("regexp_extract", html, F.concat(F.lit("(?s)"), selector), F.lit(0))
        inner = F.regexp_replace(whole, r"(?s)^<[^>]*>|</[a-zA-Z0-9]+\s*>$", "")
        return F.struct(tag.alias("tag"), text(inner).alias("text"))

    return F.transform(F.array(*(F.lit(x) for x in selectors)), first)


def first_of(found: Column, value) -> Column:
    """The first non-empty value(tag, text) of the elements that were found, else ''. Those behind it are not evaluated."""
    there = F.filter(found, lambda e: e["tag"] != "")
    return F.aggregate(there, F.lit(""), lambda held, e: F.when(held != "", held).otherwise(F.coalesce(value(e["tag"], e["text"]), F.lit(""))))

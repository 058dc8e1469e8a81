"""Pages as tokens and nested elements: each element an interval of tokens, its children the intervals one level down.

A parsed page is (row, page_id, url, tokens, nodes). tokens are the tags, comments, scripts and texts of
the HTML in order and make it up again when joined; nodes are its elements in document order. A card is such a page in
small, so whatever looks for elements works on both. All of it stays within a page's row: nothing is shuffled.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import lexicon as lex
from gristmill.functions import markup as mk
from gristmill.functions import scalar as fn
from gristmill.sources.tables import written

TOKEN = (
    r"""(?is)<!--.*?-->|<(?:script|style|template)\b[^>]*>.*?</(?:script|style|template)\s*>|<[!?][^>]*>"""
    r"""|</?[a-z][^\s>/]*+(?:[^'">]++|"[^"]*+"|'[^']*+')*+>|[^<]+|<"""
)
#: close: the token that ends the element, not part of it; last: its last descendant's place in nodes (its own without any); kids: its children's places.
NODE = [("name", T.StringType()), ("tag", T.StringType()), *((c, T.IntegerType()) for c in ("open", "close", "depth", "parent", "last")), ("kids", T.ArrayType(T.IntegerType()))]
NODES = T.ArrayType(T.StructType([T.StructField(*f) for f in NODE]))
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s>/]*)")
#: Fixed values of HTML: elements without content, and which open elements a start tag ends, up to which it looks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr script style template".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {
    **{b: ({"p"}, {"button", "td", "th", "li", "div", "section", "article", "body"}) for b in BLOCKS},
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}


def nested(tokens: list[str]) -> list[list]:
    """The elements [name, open, close, depth, parent, last, kids] of a page's tokens; a stray end tag is ignored, an element left open ends with what holds it."""
    out: list[list] = []
    held: list[int] = []

    def end(place: int, at: int) -> None:
        for n in held[place:]:
            out[n][2], out[n][5] = at, len(out) - 1
        del held[place:]

    def innermost(names: set, within: set | tuple) -> int | None:
        for place in range(len(held) - 1, -1, -1):
            name = out[held[place]][0]
            if name in names:
                return place
            if name in within:
                return None
        return None

    for at, token in enumerate(tokens):
        found = _NAME.match(token) if token[:1] == "<" else None
        if not found:
            continue
        close, name = found.groups()
        name = name.lower()
        if close:
            # mostly the element that was opened last
            place = len(held) - 1 if held and out[held[-1]][0] == name else innermost({name}, ())
        else:
            place = innermost(*ENDS[name]) if held and name in ENDS else None
        if place is not None:
            end(place, at)
        if not close:
            parent = held[-1] if held else -1
            if held:
                out[parent][6].append(len(out))
            out.append([name, at, at, len(held), parent, len(out), []])
            if name not in VOID:
                held.append(len(out) - 1)
    end(0, len(tokens))
    return out


@F.arrow_udf(NODES)
def nest(tokens: pa.Array) -> pa.Array:
    ends, kid_ends, flat, tags, kids = [0], [0], [], [], []
    # all tokens at once, then cut into pages, null ones empty: many times faster than a list of lists
    every, places = tokens.flatten().to_numpy(zero_copy_only=False).tolist(), [0, *pc.cumulative_sum(pc.fill_null(pc.list_value_length(tokens), 0)).to_pylist()]
    for start, stop in zip(places, places[1:]):
        page = every[start:stop]
        for node in nested(page):
            flat.append(node)
            tags.append(page[node[1]] if node[0] not in ("script", "style", "template") else page[node[1]][: page[node[1]].index(">") + 1])
            kids += node[6]
            kid_ends.append(len(kids))
        ends.append(len(flat))
    numbers = [pa.array([n[i] for n in flat], pa.int32()) for i in range(1, 6)]
    fields = [pa.array([n[0] for n in flat], pa.string()), pa.array(tags, pa.string()), *numbers, pa.ListArray.from_arrays(pa.array(kid_ends, pa.int32()), pa.array(kids, pa.int32()))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=[c for c, _ in NODE]))


def parse(pages: DataFrame) -> DataFrame:
    """Parsed pages of (page_id, url, html), written as a table so that every reader shares one parse; each row is a page, equal rows too. Null html is a page without elements."""
    tokens = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(TOKEN), F.lit(0))
    return written(pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", tokens.alias("tokens")).withColumn("nodes", nest("tokens")), "parsed")


def html_of(parsed: DataFrame) -> DataFrame:
    """The pages again."""
    return parsed.select("row", "page_id", "url", F.array_join("tokens", "").alias("html"))


# ---- expressions over tokens and nodes

def is_text(token: Column) -> Column:
    return ~token.rlike(r"^<(?:[a-zA-Z/!?])")


def inside(tokens: Column, node: Column) -> Column:
    """The tokens within an element."""
    return F.slice(tokens, node["open"] + 2, F.greatest(node["close"] - node["open"] - 1, F.lit(0)))


def text_of(tokens: Column, node: Column) -> Column:
    """The texts of an element, each stripped, joined without anything between."""
    return F.array_join(F.transform(F.filter(inside(tokens, node), is_text), lambda t: fn.strip(mk.unescape(t))), "")


def descendants(nodes: Column, place: Column) -> Column:
    """The elements within the one at a place."""
    return F.slice(nodes, place + 2, F.get(nodes, place)["last"] - place)


def first_node(nodes: Column, selector: str) -> Column:
    """The first element whose opening tag fits, null if none."""
    return F.get(F.filter(nodes, lambda n: n["tag"].rlike(selector)), F.lit(0))


def firsts(tokens: Column, nodes: Column, selectors: list[str], sign: str = "") -> Column:
    """array<struct<tag, text>>: the first element of each selector, '' where it finds none. sign: a pattern of every tag that a selector finds, cheaper than these."""
    found = fn.let(F.filter(nodes, lambda n: n["tag"].rlike(sign)) if sign else nodes, lambda asked: F.array(*(first_node(asked, s) for s in selectors)))
    return F.transform(found, lambda n: F.struct(F.coalesce(n["tag"], F.lit("")).alias("tag"), F.coalesce(text_of(tokens, n), F.lit("")).alias("text")))


def part_of(tokens: Column, nodes: Column, place: Column) -> Column:
    """struct<tokens, nodes>: one element as a page of its own, itself its first node."""
    own = F.get(nodes, place)
    moved = F.transform(F.slice(nodes, place + 1, own["last"] - place + 1), lambda n: F.struct(n["name"].alias("name"), n["tag"].alias("tag"), (n["open"] - own["open"]).alias("open"), (n["close"] - own["open"]).alias("close")))
    return F.struct(F.slice(tokens, own["open"] + 1, F.greatest(own["close"] - own["open"], F.lit(1))).alias("tokens"), moved.alias("nodes"))


# ---- card sets

def _selected(nodes: Column, selectors: list[tuple[str, str | None]], sign: str) -> Column:
    """array<struct<place, which>>: elements that selectors (own tag, tag of some ancestor or None) find, and which of them; only tags that show the sign are asked."""
    def which(node: Column) -> Column:
        tests = [node["tag"].rlike(own) if above is None else node["tag"].rlike(own) & F.exists(nodes, lambda m: (m["open"] < node["open"]) & (node["open"] < m["close"]) & m["tag"].rlike(above)) for own, above in selectors]
        return F.array_compact(F.array(*(F.when(t, F.lit(i)) for i, t in enumerate(tests))))

    asked = F.filter(F.transform(nodes, lambda n, i: F.struct(i.alias("place"), n.alias("node"))), lambda x: x["node"]["tag"].rlike(sign))
    return F.filter(F.transform(asked, lambda x: F.struct(x["place"].alias("place"), which(x["node"]).alias("which"))), lambda x: F.size(x["which"]) > 0)


def grid_places(tokens: Column, nodes: Column) -> Column:
    """The places of the cards of a page's best repeating grid, empty if none.

    A grid is the children of a list, division or section: four at least, three quarters of one name, four with an image and a
    text. The most such children win, priced ones counting three times; of equal grids the first."""
    pictured = lambda k: F.exists(descendants(nodes, k), lambda n: n["name"] == "img")
    worded = lambda k: text_of(tokens, F.get(nodes, k)) != ""
    plain = lambda k: mk.unescape(F.array_join(F.filter(inside(tokens, F.get(nodes, k)), is_text), ""))

    def scored(valid: Column, place: Column) -> Column:
        priced = F.size(F.filter(valid, lambda k: plain(k).rlike(r"\$[\d,]+")))
        return F.when(F.size(valid) >= 4, F.struct((F.size(valid) + priced * 2).alias("score"), (-place).alias("place"), valid.alias("cards")))

    def candidate(node: Column, place: Column) -> Column:
        most = fn.let(F.transform(node["kids"], lambda k: F.get(nodes, k)["name"]), lambda names: F.array_max(F.transform(F.array_distinct(names), lambda x: F.size(F.filter(names, lambda y: y == x)))))
        fits = node["name"].isin("ul", "div", "section", "ol") & (F.size(node["kids"]) >= 4)
        return F.when(fits, F.when(most / F.size(node["kids"]) >= 0.75, fn.let(F.filter(node["kids"], lambda k: pictured(k) & worded(k)), lambda valid: scored(valid, place))))

    best = F.array_max(F.array_compact(F.transform(nodes, candidate)))
    return F.coalesce(best["cards"], F.array().cast("array<int>"))


def card_places(tokens: Column, nodes: Column, selectors: list[tuple[str, str | None]], sign: str = "") -> Column:
    """The places of a page's cards: of the selector that finds most (three at least, the first of equal ones), else of its repeating grid."""
    def found(hits: Column) -> Column:
        of = lambda i: F.filter(hits, lambda h: F.array_contains(h["which"], i))
        counts = F.transform(F.sequence(F.lit(0), F.lit(len(selectors) - 1)), lambda i: F.struct(F.size(of(i)).alias("n"), (-i).alias("i")))
        known = lambda best: F.when(best["n"] >= 3, F.transform(of(-best["i"]), lambda h: h["place"]))
        return fn.let(F.array_max(counts), known)

    return F.coalesce(fn.let(_selected(nodes, selectors, sign), found), grid_places(tokens, nodes))


def cards(parsed: DataFrame, selectors: list[tuple[str, str | None]], sign: str = "") -> DataFrame:
    """(row, page_id, url, pos, tokens, nodes): the cards of each page, as pages in small. sign: a pattern of every tag that a selector finds, cheaper than these."""
    each = parsed.select("row", "page_id", "url", "tokens", "nodes", F.posexplode(card_places(F.col("tokens"), F.col("nodes"), selectors, sign)).alias("pos", "place"))
    return each.select("row", "page_id", "url", "pos", part_of(F.col("tokens"), F.col("nodes"), F.col("place")).alias("part")).select("row", "page_id", "url", "pos", "part.*")


# ---- links

def product_links(parsed: DataFrame) -> DataFrame:
    """(page_id, link): distinct links of a page to its own host that have a product's path, or that stand in a card and have a path of more than five characters."""
    nodes = F.col("nodes")
    marked = F.filter(nodes, lambda n: n["tag"].rlike(lex.LINK_CARD_CLASS))  # found once a page
    anchors = F.filter(nodes, lambda n: (n["name"] == "a") & n["tag"].rlike(r"(?i)\shref\s*="))
    # within a card: between its opening and its end
    within = lambda held: F.transform(anchors, lambda a: F.struct(mk.attribute(a["tag"], "href").alias("href"), F.exists(held, lambda m: (m["open"] < a["open"]) & (a["open"] < m["close"])).alias("carded")))
    each = parsed.select("page_id", "url", F.explode(fn.let(marked, within)).alias("a")).select("page_id", "url", "a.*")
    linked = each.withColumn("link", fn.absolute_url(F.col("url"), F.col("href")))
    path = fn.url_path(F.col("link"))
    own = linked.filter((fn.url_host(F.col("link")) == fn.url_host(F.col("url"))) & ~fn.non_product_path(F.col("link")))
    return own.filter(path.rlike("(?i)" + lex.PRODUCT_LINK) | (F.col("carded") & (F.length(path) > 5))).select("page_id", "link").distinct()

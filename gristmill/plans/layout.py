"""Queries over the layout of pages: grids without known classes, nested cards, links by their card."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import lexicon as lex
from gristmill.operators import dom
from gristmill.operators import pages as pg
from gristmill.sources.tables import spread, table

QUERIES, SQL = {}, {}


def _add(name: str, make, sql: str) -> None:
    QUERIES[name], SQL[name] = make, sql


def _each(n: int, markup: str) -> str:
    return "".join(markup.replace("@", str(j)) for j in range(n))


_LOST = "<!-- <img src=\"/c.jpg\"> --><script>var a = '<img src=\"/s.jpg\">';</script>"
#: Bodies of eight kinds of pages; NAME, ID and PRICE stand for a part's, @ for the number of an element.
BODIES = [
    # lists left open, three of five priced, beside a longer one without prices
    '<div class="w"><ul>' + _each(3, '<li><a href="/x/ID-@"><img src="/g/@.jpg"></a><p>NAME @ <b class="price">$PRICE</b>') + _each(2, '<li><img src="/h/@.jpg"><p>NAME more @') + "</ul><ol>" + _each(6, '<li><img src="/o/@.jpg"><p>Other NAME @</p></li>') + "</ol></div>",
    # three quarters of one name
    "<section>" + _each(3, '<article><img src="/a/@.jpg"><h3>NAME @</h3></article>') + '<aside><img src="/b.jpg"><h3>NAME aside</h3></aside></section>',
    # two thirds of one name: no grid
    "<div>" + _each(4, '<article><img src="/a/@.jpg"><h3>NAME @</h3></article>') + _each(2, '<aside><img src="/b.jpg"><h3>NAME aside</h3></aside>') + "</div>",
    # cards within cards' elements, one without a picture and one without a word
    '<div class="rows">' + _each(5, '<div><div><div><img src="/n/@.jpg"></div></div><div><div>NAME @</div><div class="price"><div><div>$PRICE</div></div></div></div></div>') + '<div>NAME alone</div><div><img src="/x.jpg">&nbsp;</div></div>',
    # three known cards against a longer grid
    "<ul>" + _each(9, '<li><img src="/l/@.jpg"><p>Listed NAME</p></li>') + "</ul><main>" + _each(3, '<div class="big product-tile"><div><img src="/t/@.jpg"></div><div><h4>NAME @</h4></div></div>') + "</main>",
    # two known cards are too few
    '<p class="product-tile">NAME</p><p class="product-tile">NAME</p><ol>' + _each(4, '<li><img data-src="/z/@.jpg" src="data:x"><p>NAME @</p></li>') + "</ol>",
    # pictures in comments and scripts only
    "<ul>" + _each(5, f"<li>{_LOST}<p>NAME @</p></li>") + "</ul>",
    # a class that counts within another only
    _each(3, '<div class="grid__item half"><div><a class="grid-product" href="/i/@"><img src="/i/@.jpg"><span>NAME @</span></a></div></div>') + '<div class="other"><a class="grid-product"><img src="/no.jpg"><span>NAME</span></a></div>',
]
_KINDS = " ".join(f"WHEN {k} THEN replace(replace(replace('{b.replace(chr(39), chr(39) * 2)}', 'NAME', p_name), 'ID', cast(p_partkey AS string)), 'PRICE', cast(p_retailprice AS string))" for k, b in enumerate(BODIES))


def grid_pages(s: SparkSession, d: str) -> DataFrame:
    return s.sql(f"SELECT p_partkey AS page_id, 'https://shop.example.com/c/' || cast(p_partkey AS string) AS url, '<!DOCTYPE html><html><head><title>x</title></head><body>' || CASE p_partkey % 8 {_KINDS} END || '</body></html>' AS html FROM {{part}}", part=spread(table(s, d, "part")))


_D = "(SELECT p_partkey, p_name, p_partkey % 8 AS k, cast(p_partkey AS string) AS id, '$' || printf('%.2f', p_retailprice) AS price FROM part)"


def _cards(k: int, n: int, image: str, name: str, price: str = "''", link: str = "'https://shop.example.com/c/' || id", first: int = 0) -> list[str]:
    one = f"SELECT p_partkey AS page_id, {{p}} AS pos, 'https://shop.example.com{image}' AS product_image, {name} AS product_name, {price} AS msrp, {link} AS url FROM {_D} WHERE k = {k}"
    return [one.replace("@", str(j)).replace("{p}", str(first + j)) for j in range(n)]


_GRID = " UNION ALL ".join([
    *_cards(0, 3, "/g/@.jpg", "p_name || ' @'", "price", "'https://shop.example.com/x/' || id || '-@'"), *_cards(0, 2, "/h/@.jpg", "p_name || ' more @'", first=3),
    *_cards(1, 3, "/a/@.jpg", "p_name || ' @'"), *_cards(1, 1, "/b.jpg", "p_name || ' aside'", first=3),
    *_cards(3, 5, "/n/@.jpg", "p_name || ' @'", "price"), *_cards(4, 3, "/t/@.jpg", "p_name || ' @'"), *_cards(5, 4, "/z/@.jpg", "p_name || ' @'"), *_cards(7, 3, "/i/@.jpg", "p_name || ' @'"),
])


def repeating_grid(s: SparkSession, d: str) -> DataFrame:
    """Products of the cards of pages of which most have no known class."""
    return pg.card_products(grid_pages(s, d)).select("page_id", "pos", "product_image", "product_name", "msrp", "url")


_add("repeating_grid", repeating_grid, _GRID)

_FRAMED = [(r'<li><a href="/([a-f])', r'<li class="menu-item"><a href="/\1'), (r'<li><a href="/([g-m])', r'<li class="grid x"><b><a class=y href=/\1'), (r'<li><a href="/([n-p])', r'<li class="grids"><a href="/shop/\1'), (r"<nav>", r'<nav data-class="card">')]


def card_pages(s: SparkSession, d: str) -> DataFrame:
    """The given pages, their menus' links put into elements of several classes, some without quotes."""
    html = F.col("html")
    for found, put in _FRAMED:
        html = F.regexp_replace(html, found, put.replace(r"\1", "$1"))
    # an unquoted address ends at its tag's end
    return table(s, d, "pages").withColumn("html", F.regexp_replace(html, r'(<a class=y href=/[^"<>]*)"', "$1"))


def product_links_cards(s: SparkSession, d: str) -> DataFrame:
    """Links with a product's path, and links in cards."""
    return dom.product_links(dom.parse(card_pages(s, d)))


_BARRED = "[" + ", ".join(f"'{w}'" for w in lex.NON_PRODUCT_SEGMENTS) + "]"
_add("product_links_cards", product_links_cards, rf"""
WITH h AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) AS root, unnest(regexp_extract_all(html, '<li><a href="(/[^"]*)"', 1)) AS href FROM pages),
l AS (SELECT page_id, root, CASE WHEN regexp_matches(href, '^/[n-p]') THEN '/shop' || href ELSE href END AS href, regexp_matches(href, '^/[a-m]') AS carded FROM h)
SELECT DISTINCT page_id, root || regexp_replace(href, '#.*$', '') AS link FROM l
WHERE (regexp_matches(regexp_extract(href, '^([^?#]*)', 1), '(?i){lex.PRODUCT_LINK}') OR (carded AND length(regexp_extract(href, '^([^?#]*)', 1)) > 5)) AND NOT list_has_any(string_split(lower(regexp_extract(href, '^([^?#]*)', 1)), '/'), {_BARRED})""")


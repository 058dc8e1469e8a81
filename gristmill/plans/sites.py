"""Queries over whole sites, rendered from parts: walks of sitemaps and site scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import crawl
from gristmill.operators import pages as pg
from gristmill.sources.tables import spread, table

QUERIES, SQL = {}, {}


def _add(name: str, make, sql: str) -> None:
    QUERIES[name], SQL[name] = make, sql


_LOC = "'<url><loc> https://s' || cast(s AS string) || '.example.com' || {0} || '</loc><lastmod>x</lastmod></url>'"
#: Three levels of sitemaps for each of 8 sites: an index, three maps that it names (one twice, one without "product" in its address), and a deeper one.
MAPS = f"""
WITH p AS (SELECT p_partkey % 8 AS s, p_partkey AS k, cast(p_partkey AS string) AS id FROM {{part}}),
l AS (SELECT s, array_sort(collect_list(struct(k, id))) AS ids FROM p GROUP BY s),
r AS (SELECT s, ids, 'https://s' || cast(s AS string) || '.example.com' AS root FROM l)
SELECT root || '/sitemap.xml' AS url, '<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><!-- <sitemap><loc>' || root || '/product-no.xml</loc></sitemap> -->' ||
  concat_ws('', transform(array('/Product-b.xml', '/other.xml', '/product-a.xml', '/Product-b.xml'), x -> '<sitemap><loc><![CDATA[' || root || x || ']]></loc></sitemap>')) || '</sitemapindex>' AS xml FROM r
UNION ALL SELECT root || '/sitemap_products_1.xml', '<urlset>' || array_join(transform(slice(ids, 1, 3), x -> {_LOC.format("'/products/' || x.id || '?a=1&amp;b=2'")}), '') || {_LOC.format("'/products/' || ids[0].id || '?a=1&amp;b=2'")} || {_LOC.format("'/blog/products/1'")} || {_LOC.format("'/about'")} || '</urlset>' FROM r
UNION ALL SELECT root || '/product-a.xml', '<urlset>' || array_join(transform(filter(ids, x -> x.k % 3 = 0), x -> {_LOC.format("'/shop/a' || x.id")}), '') || '</urlset>' FROM r
UNION ALL SELECT root || '/Product-b.xml', '<urlset>' || array_join(transform(filter(ids, x -> x.k % 3 = 1), x -> {_LOC.format("'/item/b' || x.id")}), '') || '<sitemap><loc>' || root || '/deep/product-c.xml</loc></sitemap></urlset>' FROM r
UNION ALL SELECT root || '/deep/product-c.xml', '<urlset>' || array_join(transform(ids, x -> {_LOC.format("'/p/c' || x.id")}), '') || '<sitemap><loc>' || root || '/product-a.xml</loc></sitemap></urlset>' FROM r
UNION ALL SELECT root || '/other.xml', '<urlset>' || {_LOC.format("'/products/other'")} || '</urlset>' FROM r
"""
_ORDERED = " UNION ALL ".join(f"SELECT {level} AS level, {place} AS place, row_number() OVER (PARTITION BY s ORDER BY k) AS n, s, k, {path} AS path FROM p WHERE {test}" for level, place, path, test in (
    (0, 1, "'/products/' || id || '?a=1&b=2'", "r <= 3"), (0, 2, "'/products/' || id || '?a=1&b=2'", "r = 1"), (1, 0, "'/item/b' || id", "k % 3 = 1"), (1, 2, "'/shop/a' || id", "k % 3 = 0"), (2, 0, "'/p/c' || id", "true"),
))


def sitemap_walk(s: SparkSession, d: str) -> DataFrame:
    """The first 100 product addresses of each site's sitemaps."""
    sites = table(s, d, "part").select(F.concat(F.lit("https://s"), (F.col("p_partkey") % 8).cast("string"), F.lit(".example.com/home")).alias("site"))
    return crawl.sitemap_walk(sites, s.sql(MAPS, part=table(s, d, "part")))


_add("sitemap_walk", sitemap_walk, f"""
WITH p AS (SELECT p_partkey % 8 AS s, p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, row_number() OVER (PARTITION BY p_partkey % 8 ORDER BY p_partkey) AS r FROM part),
o AS ({_ORDERED}), n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY level, place, n) AS nth FROM o)
SELECT 'https://s' || s || '.example.com/home' AS site, nth, 'https://s' || s || '.example.com' || path AS url FROM n WHERE nth <= 100""")

_LD = """'<script type="application/ld+json">{{"@type":"Product","name":"' || p_name || ' {0}","sku":"SKU{0}-' || id || '","offers":{{"price":12.5}}}}</script>'"""


def _ld(tail: str) -> str:
    return _LD.format(tail)


def _as_braces(sql: str) -> str:
    return sql.replace("{", "{{").replace("}", "}}")


_SITE_OF = "SELECT *, p_partkey % 7 AS k, cast(p_partkey AS string) AS id, 'https://t' || cast(p_partkey AS string) || '.example.com' AS root FROM {part}"
_CARD = """'<div class="product-card"><a href="/products/c@"><img src="/c@.jpg"></a><h3>' || p_name || ' card @</h3><span class="price">$7.50</span></div>'"""
_MANY = " || ".join(f"""'<a href="/collections/x{j:02d}">x</a>'""" for j in range(22))
#: Pages of sites of seven kinds: 0 a shop with a feed, 1 one whose feed is empty and that links to products, 2 collections, 3 more than 20 collections,
#: 4 a landing page that lists nothing but has a sitemap, 5 one that lists enough, 6 one that is not held.
SITE_PAGES = " UNION ALL ".join(f"SELECT root || '{path}' AS url, '<html><body>' || {body} || '</body></html>' AS html FROM s WHERE {test}" for path, body, test in (
    ("/", "'<i class=\"myshopify.com\"></i>' || CASE WHEN k = 1 THEN '<a href=\"/products/one\">1</a><a href=\"/products/two\">2</a><a href=\"/products/gone\">3</a>' ELSE '' END", "k IN (0, 1)"),
    ("/products/one", _ld("one"), "k = 1"), ("/products/two", _ld("two"), "k = 1"),
    ("/", "'<a href=\"/collections/b\">b</a><a href=\"/collections/a\">a</a><a href=\"/products/z\">z</a>'", "k = 2"),
    ("/collections/a", " || ".join(_CARD.replace("@", str(j)) for j in range(3)) + " || '<a href=\"/products/extra\">e</a>'", "k = 2"),
    ("/products/extra", _ld("extra"), "k = 2"), ("/products/z", _ld("never"), "k = 2"), ("/products/c0", _ld("never"), "k = 2"),
    ("/", _MANY, "k = 3"), *((f"/collections/x{j:02d}", _ld(f"x{j:02d}"), "k = 3") for j in (0, 5, 19, 20, 21)),
    ("/", "'<p>nothing</p>'", "k = 4"), ("/products/m1", _ld("m1"), "k IN (4, 5)"), ("/products/m2", _ld("m2"), "k IN (4, 5)"),
    ("/", " || ".join(_ld(f"own{j}") for j in range(3)), "k = 5"), ("/products/one", _ld("never"), "k = 6"),
))
_SITE_FEEDS = """SELECT root || '/' AS site, CASE WHEN k = 1 THEN '{"products":[]}' ELSE '{"products":[{"title":"' || p_name || '","handle":"h","images":[],"variants":[{"id":1,"sku":"F-' || id || '","price":"3.5","option1":"Navy"},{"id":2,"sku":"G-' || id || '","price":"4","option1":"Red"}]}]}' END AS json FROM s WHERE k IN (0, 1, 2)"""
_SITE_MAPS = """SELECT root || '/sitemap.xml' AS url, '<urlset><url><loc>' || root || '/products/m1</loc></url><url><loc>' || root || '/products/m0</loc></url><url><loc>' || root || '/products/m2</loc></url></urlset>' AS xml FROM s WHERE k IN (2, 3, 4, 5)"""


def site_crawl(s: SparkSession, d: str) -> DataFrame:
    """A scan of a site per part."""
    of = lambda sql: s.sql("WITH s AS (" + _SITE_OF + ") " + _as_braces(sql), part=spread(table(s, d, "part")))
    found = crawl.site_crawl(of("SELECT root || '/' AS site FROM s"), of(SITE_PAGES), of(_SITE_FEEDS), of(_SITE_MAPS))
    return found.select("site", "branch", "visit", "source_detail", *pg.RECORD)


def _expected(k: int, branch: str, visit: int, path: str, sku: str, name: str, msrp: str = "'$12.50'", image: str = "''", color: str = "''") -> str:
    return f"SELECT root || '/' AS site, '{branch}' AS branch, {visit} AS visit, root || '{path}' AS source_detail, {image} AS product_image, {sku} AS sku_upc, p_name || '{name}' AS product_name, {color} AS color, {msrp} AS msrp FROM s WHERE k = {k}"


def _single(k: int, branch: str, visit: int, path: str, tail: str) -> str:
    return _expected(k, branch, visit, path, f"'SKU{tail}-' || id", f" {tail}")


_add("site_crawl", site_crawl, "WITH s AS (" + _SITE_OF.replace("{part}", "part") + ") " + " UNION ALL ".join([
    _expected(0, "feed", 0, "/products/h", "'F-' || id", "", "'$3.50'", color="'Navy'"), _expected(0, "feed", 0, "/products/h", "'G-' || id", "", "'$4.00'", color="'Red'"),
    _single(1, "linked", 2, "/products/one", "one"), _single(1, "linked", 3, "/products/two", "two"),
    *(_expected(2, "collection", 1, f"/products/c{j}", "''", f" card {j}", "'$7.50'", f"root || '/c{j}.jpg'") for j in range(3)), _single(2, "followed", 1, "/products/extra", "extra"),
    *(_single(3, "collection", j + 1, f"/collections/x{j:02d}", f"x{j:02d}") for j in (0, 5, 19)),
    _single(4, "sitemap", 1, "/products/m1", "m1"), _single(4, "sitemap", 3, "/products/m2", "m2"),
    *(_single(5, "landing", 0, "/", f"own{j}") for j in range(3)),
]))

"""Queries over web pages: those given, and pages and feeds rendered from parts, whose SQL projects what was rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import lexicon as lex
from gristmill.functions import scalar as fn
from gristmill.operators import pages as pg
from gristmill.operators import products as op
from gristmill.sources.tables import spread, table

_URL = "CASE WHEN k IN (0, 1) THEN 'https://shop.example.com/products/' || id WHEN k IN (2, 4) THEN 'https://shop.example.com/collection/all/' || id ELSE 'https://shop.example.com/x/' || id END"
_PART = "SELECT *, p_partkey % 8 AS k, cast(p_partkey AS string) AS id, cast(p_retailprice AS string) AS price FROM {part}"
#: A page per part, of eight kinds: JSON-LD bare, in a graph, in an item list; framework data; cards; meta tags; patterns; editorial.
PAGES = f"""
SELECT p_partkey AS page_id, {_URL} AS url, '<!DOCTYPE html><html><head><title>Discover how style meets everyday cooking. | Site</title>' || CASE
  WHEN k = 0 THEN '<script type="application/ld+json">{{{{"@type":"Product","name":"' || p_name || '","sku":"SKU-' || id || '","image":["/thumb/a.jpg","/products/b.jpg","/products/c.jpg"],"color":"Navy","offers":[{{{{"price":' || price || '}}}},{{{{"price":1}}}}]}}}}</script></head><body><h1>x</h1><button class="btn">Add to Cart</button></body>'
  WHEN k = 1 THEN '<script type="application/ld+json">not json</script><script type="application/ld+json">{{{{"@graph":[{{{{"@type":"WebPage","name":"no"}}}},{{{{"@type":"Product","name":"' || p_name || ' - Red","productID":"P' || id || '00","image":{{{{"url":"../img/1.png"}}}},"offers":{{{{"highPrice":"1,' || lpad(id, 3, '0') || '.50"}}}}}}}}]}}}}</script></head><body></body>'
  WHEN k = 2 THEN '<script type="application/ld+json">[{{{{"@type":"ItemList","itemListElement":[{{{{"item":{{{{"@type":"Product","name":"' || p_name || '","image":"https://cdn.example.com/1.jpg"}}}}}}}},{{{{"name":"Second ' || p_name || '","offers":{{{{"price":"12"}}}}}}}},{{{{"position":3}}}}]}}}},{{{{"@type":["Product"],"name":"no"}}}}]</script></head><body></body>'
  WHEN k = 3 THEN '<script id="__NEXT_DATA__" type="application/json">{{{{"props":{{{{"x":[1,{{{{"list":[{{{{"title":"' || p_name || '","price":{{{{"amount":' || price || '}}}},"images":[{{{{"src":"https://cdn.example.com/n.jpg"}}}}],"id":"N' || id || '00","color":{{{{"name":"Teal"}}}},"inner":{{{{"name":"inner","price":1}}}}}}}},{{{{"name":"ab","price":1}}}},{{{{"name":"Other ' || p_name || '","thumbnail":"t.png","salePrice":"5"}}}}]}}}}]}}}}}}}}</script></head><body></body>'
  WHEN k = 4 THEN '</head><body><ul class="grid">' || repeat('<li><div class="product-card" data-sku="C' || id || '00"><a href="/products/' || id || '"><img data-src="/images/' || id || '.jpg" src="data:x"></a><h3 class="title">' || p_name || ' &amp; co</h3><span class="price">$' || price || '</span><i class="color">Red</i></div></li>', 4) || '</ul><p>after</p></body>'
  WHEN k = 5 THEN '<meta property="og:title" content="' || p_name || ', Blue"><meta content="o.png" property="og:image"><meta property="og:price:amount" content="' || price || '"><meta property="product:retailer_item_id" content="OG' || id || '00"></head><body></body>'
  WHEN k = 6 THEN '</head><body><h1>' || p_name || ' <b>(Olive)</b></h1><div class="product-price">MSRP: $' || price || '</div><p class="sku">H' || id || '00</p><div class="gallery"><img src="/s/thumb.jpg" srcset="/s/1.jpg 100w, /s/2.jpg 900w"></div></body>'
  ELSE '</head><body class="myshopify.com"><p>text</p></body>' END || '</html>' AS html
FROM ({_PART}) AS t
"""
_D = "(SELECT *, p_partkey % 8 AS k, cast(p_partkey AS string) AS id, '$' || printf('%.2f', p_retailprice) AS price FROM part)"
_S = "'https://shop.example.com'"


def rendered(s: SparkSession, d: str) -> DataFrame:
    return s.sql(PAGES, part=spread(table(s, d, "part")))


QUERIES, SQL = {}, {}


def _add(name: str, make, sql: str) -> None:
    QUERIES[name], SQL[name] = make, sql


def _rows(*cases: tuple[str, str, str, str, str, str, str]) -> str:
    """SQL of (page_id, pos, record) for cases (k, pos, image, sku, name, color, msrp)."""
    return " UNION ALL ".join(f"SELECT p_partkey AS page_id, {pos} AS pos, {image} AS product_image, {sku} AS sku_upc, {name} AS product_name, {color} AS color, {msrp} AS msrp FROM {_D} WHERE k = {k}" for k, pos, image, sku, name, color, msrp in cases)


_LD = [
    ("0", "0", f"{_S} || '/products/b.jpg'", "'SKU-' || id", "p_name", "'Navy'", "price"),
    ("1", "1000", f"{_S} || '/img/1.png'", "'P' || id || '00'", "p_name || ' - Red'", "'Red'", "'$1,' || lpad(id, 3, '0') || '.50'"),
    ("2", "0", "'https://cdn.example.com/1.jpg'", "''", "p_name", "''", "''"),
    ("2", "1", "''", "''", "'Second ' || p_name", "''", "'$12.00'"),
]
_NEXT = [
    ("3", "0", "'https://cdn.example.com/n.jpg'", "'N' || id || '00'", "p_name", "'Teal'", "price"),
    ("3", "1", f"{_S} || '/x/t.png'", "''", "'Other ' || p_name", "''", "'$5.00'"),
]
_CARD = [("4", str(i), f"{_S} || '/images/' || id || '.jpg'", "'C' || id || '00'", "p_name || ' & co'", "'Red'", "price") for i in range(4)]
_META = [("5", "0", f"{_S} || '/x/o.png'", "'OG' || id || '00'", "p_name || ', Blue'", "'Blue'", "price")]
_TEXT = [("6", "0", f"{_S} || '/s/2.jpg'", "'H' || id || '00'", "p_name || '(Olive)'", "'Olive'", "price")]
_plain = lambda f: lambda s, d: f(rendered(s, d)).select("page_id", "pos", *pg.RECORD)
_add("jsonld_extract", _plain(pg.json_ld_products), _rows(*_LD))
_add("nextdata_extract", _plain(pg.framework_products), _rows(*_NEXT))
_add("html_cards", _plain(pg.card_products), _rows(*_CARD))
_add("opengraph_extract", _plain(pg.meta_products), _rows(*_META))
_PLAIN = "'Discover how style meets everyday cooking.'"
_add("html_fallback", _plain(pg.pattern_products), _rows(*_TEXT, ("0", "0", "''", "''", "'x'", "''", "''"), ("4", "0", f"{_S} || '/images/' || id || '.jpg'", "''", _PLAIN, "''", "price"), *((k, "0", "''", "''", _PLAIN, "''", "''") for k in "12357")))
_add("page_features", lambda s, d: rendered(s, d).select("page_id", pg.has_product_schema(F.col("html")).alias("schema"), pg.card_count(F.col("html")).alias("cards"), pg.has_single_price(F.col("html")).alias("one_price"), pg.has_add_to_cart(F.col("html")).alias("cart"), pg.is_shop_platform(F.col("html")).alias("shop"), pg.page_type(F.col("url"), F.col("html")).alias("page_type")),
     f"SELECT p_partkey AS page_id, k IN (0, 1) AS schema, CASE WHEN k = 4 THEN 4 ELSE 0 END AS cards, k = 6 AS one_price, k = 0 AS cart, k = 7 AS shop, CASE WHEN k = 0 THEN 'pdp' WHEN k IN (2, 4) THEN 'category' WHEN k = 6 AND p_partkey > 999999 THEN 'pdp' ELSE 'unknown' END AS page_type FROM {_D}")

# pages that reach every mark of a shop platform and every rule of the page type
_MARKED = """SELECT p_partkey AS page_id, CASE k WHEN 6 THEN 'https://shop.example.com/products/' || id WHEN 9 THEN 'https://shop.example.com/blog/' || id WHEN 10 THEN 'https://shop.example.com/search?q=' || id WHEN 11 THEN 'https://shop.example.com/' ELSE 'https://shop.example.com/x/' || id END AS url, '<html>' || CASE k
  WHEN 0 THEN '<script src="https://cdn.shopify.com/s.js"></script>' WHEN 1 THEN '<script>Shopify.theme = 1</script>' WHEN 2 THEN '<a href="https://a.myshopify.com">a</a>'
  WHEN 3 THEN '<script>p = "Shopify"</script>' WHEN 4 THEN repeat('<p>x</p>', 700) || '<script>p = "Shopify"</script>' WHEN 5 THEN '<meta name="shopify-checkout-api-token" content="t">'
  WHEN 6 THEN '<span class="price">$9</span>' WHEN 7 THEN '<span class="price">$9</span><button>Add to Bag</button>'
  WHEN 8 THEN '<b class="price">$9</b><button>Buy now</button>' || repeat('<div class="product-card">' || p_name || '</div>', 4)
  WHEN 9 THEN '<div itemscope itemtype="https://schema.org/Product"><button>Add to cart</button></div>' WHEN 10 THEN repeat('<div class="product-card">' || p_name || '</div>', 4)
  ELSE '<a class="btn quick-add" href="/x">' || p_name || '</a>' END || '</html>' AS html FROM (SELECT *, p_partkey % 12 AS k, cast(p_partkey AS string) AS id FROM {part}) AS t"""
_FEATURES = lambda html, url: (pg.has_product_schema(html).alias("schema"), pg.card_count(html).alias("cards"), pg.has_single_price(html).alias("one_price"), pg.has_add_to_cart(html).alias("cart"), pg.is_shop_platform(html).alias("shop"), pg.page_type(url, html).alias("page_type"))
_add("page_feature_marks", lambda s, d: s.sql(_MARKED, part=spread(table(s, d, "part"))).select("page_id", *_FEATURES(F.col("html"), F.col("url"))),
     "SELECT p_partkey AS page_id, k = 9 AS schema, CASE WHEN k IN (8, 10) THEN 4 ELSE 0 END AS cards, k IN (6, 7, 8) AS one_price, k IN (7, 8, 9, 11) AS cart, k IN (0, 1, 2, 3, 5) AS shop, CASE WHEN k IN (6, 7) THEN 'pdp' WHEN k = 8 THEN 'category' WHEN k = 9 THEN 'editorial' WHEN k = 10 THEN 'search' WHEN k = 11 THEN 'homepage' ELSE 'unknown' END AS page_type FROM (SELECT *, p_partkey % 12 AS k FROM part)")
_CASCADE = " UNION ALL ".join(f"SELECT page_id, {n} AS strategy, pos, product_name, msrp FROM ({_rows(*rows)})" for n, rows in ((1, [x for x in _LD if x[0] != "2" or x[1] == "1"]), (2, _NEXT), (3, _CARD), (4, _META), (5, _TEXT)))
_add("page_extract_score", lambda s, d: pg.page_products(rendered(s, d)).filter("confidence >= 0.45").select("page_id", "strategy", "pos", "product_name", "msrp"), _CASCADE)

_FEED = """SELECT p_partkey AS page_id, 'https://shop.example.com/products.json' AS url, '{{"products":[{{"title":"' || p_name || '","product_type":"' || p_type || '","handle":"h' || id || '","images":[{{"id":1,"src":"a.jpg"}},{{"id":2,"src":"b.jpg"}}],"variants":[' ||
 '{{"id":10,"sku":"A' || id || '","price":"' || price || '","option1":"Large 9","option2":"Navy","image_id":2}},{{"id":11,"sku":"B","price":"3","option1":"navy","option2":null,"image_id":1}},{{"id":12,"sku":"C","price":"","option1":"Default Title"}},{{"id":13,"sku":"D","price":"1234.5","option1":"12 oz","image_id":9}}]}}]}}' AS json FROM (""" + _PART + ") AS t"
_SHOP = " UNION ALL ".join(f"SELECT p_partkey AS page_id, {_S} || '/products/h' || id AS url, {pos} AS pos, '{image}' AS product_image, {sku} AS sku_upc, p_name AS product_name, '{color}' AS color, {msrp} AS msrp, p_type AS category FROM {_D}" for pos, image, sku, color, msrp in ((0, "b.jpg", "'A' || id", "Navy", "price"), (2, "a.jpg", "'C'", "", "''"), (3, "a.jpg", "'D'", "", "'$1234.50'")))
_add("shop_variants", lambda s, d: pg.shop_products(s.sql(_FEED, part=spread(table(s, d, "part")))), _SHOP)

_SITE = "SELECT p_partkey AS ord, CASE p_partkey % 4 WHEN 0 THEN ' FAQ ' WHEN 1 THEN '' ELSE p_name END AS product_name, CASE p_partkey % 8 WHEN 2 THEN 'seo-belt-pouches' WHEN 3 THEN 'AB-12345' ELSE '' END AS sku_upc, CASE p_partkey % 16 WHEN 10 THEN 'call us' ELSE '$9.50' END AS msrp, 'Red' AS color, 'http://i.example.com/' || cast(p_partkey AS string) || '.jpg' AS product_image, 'https://shop.example.com/products/' || cast(p_partkey AS string) AS source_detail FROM {part}"
_add("site_filter", lambda s, d: pg.real_products(s.sql(_SITE, part=table(s, d, "part"))).select("ord", "product_name", "sku_upc", "msrp"),
     f"SELECT ord, product_name, CASE WHEN sku_upc = 'seo-belt-pouches' THEN '' ELSE sku_upc END AS sku_upc, CASE WHEN msrp = 'call us' THEN '' ELSE msrp END AS msrp FROM ({_SITE.replace('{part}', 'part')}) WHERE product_name NOT IN ('', ' FAQ ')")
_IMAGES = "array('/thumb/' || cast(p_partkey AS string) || '.jpg', CASE p_partkey % 3 WHEN 0 THEN '/a.svg' WHEN 1 THEN '/products/a_large.jpg' ELSE '/spacer.gif' END, '/b.png', '/c.png')"
_add("best_image", lambda s, d: table(s, d, "part").select("p_partkey", pg.best_image(F.expr(_IMAGES)).alias("image")), "SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN '/products/a_large.jpg' ELSE '/b.png' END AS image FROM part")
_TAG = "'<img class=\"i\" srcset=\"/a.jpg 100w, /b-' || cast(p_partkey AS string) || '.jpg 900w, /c.jpg 2x\" data-src=\"d.jpg\" src=\"' || CASE WHEN p_partkey % 2 = 0 THEN 'data:x' ELSE '/e.jpg' END || '\">'"
_add("srcset_urls", lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(pg.image_urls(F.expr(_TAG), F.lit("https://x.example.com/p/q")), " ").alias("urls")), "SELECT p_partkey, 'https://x.example.com/b-' || p_partkey || '.jpg https://x.example.com/a.jpg https://x.example.com/c.jpg https://x.example.com/p/d.jpg' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' https://x.example.com/e.jpg' END AS urls FROM part")

# links of the given pages
_HREF = r"""<a\b[^>]*?\shref\s*=\s*["'']([^"'']*)["'']"""
_LINKS = """WITH h AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) AS root, unnest(regexp_extract_all(html, '{href}', 1)) AS href FROM pages),
l AS (SELECT DISTINCT page_id, root || regexp_replace(href, '#.*$', '') AS link FROM h WHERE href LIKE '/%' AND href NOT LIKE '//%' AND regexp_matches(regexp_extract(href, '^([^?#]*)', 1), '(?i){pattern}') AND NOT list_has_any(string_split(lower(regexp_extract(href, '^([^?#]*)', 1)), '/'), {barred}))"""
_BARRED = "[" + ", ".join(f"'{w}'" for w in lex.NON_PRODUCT_SEGMENTS) + "]"


def _shop_pages(s: SparkSession, d: str) -> DataFrame:
    """The given pages with their own links put under the folders of shops, so that link rules find some."""
    return table(s, d, "pages").withColumn("html", F.regexp_replace("html", r'<a href="/([a-h])', r'<a class="c" href="/products/$1')).withColumn("html", F.regexp_replace("html", r'<a href="/([i-r])', r"<a href='/collections/all/$1"))


_SHOPPED = r"""(SELECT page_id, url, regexp_replace(regexp_replace(html, '<a href="/([a-h])', '<a class="c" href="/products/\1', 'g'), '<a href="/([i-r])', '<a href=''/collections/all/\1', 'g') AS html FROM pages)"""
for _name, _pattern in (("product_links", lex.PRODUCT_LINK), ("collection_pages", lex.COLLECTION_LINK)):
    _add(_name, lambda s, d, p=_pattern: op.page_links(_shop_pages(s, d), p).withColumn("nth", F.row_number().over(op.Window.partitionBy("page_id").orderBy("link"))), _LINKS.format(href=_HREF, pattern=_pattern, barred=_BARRED).replace("FROM pages)", f"FROM {_SHOPPED})") + " SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY link) AS nth FROM l")


def _followed(s: SparkSession, d: str) -> DataFrame:
    pages = _shop_pages(s, d)
    links = op.page_links(pages, lex.PRODUCT_LINK)
    targets = links.select(F.col("link").alias("url")).distinct().withColumn("target", F.md5(F.col("url").cast("binary")))
    listings = links.filter(F.md5(F.col("link").cast("binary")) < "5").select("page_id", F.col("link").alias("source_detail"))
    return pg.follow_links(listings, links, targets, most=3).select("listing_id", "url", "target")


_add("follow_links", _followed, _LINKS.format(href=_HREF, pattern=lex.PRODUCT_LINK, barred=_BARRED).replace("FROM pages)", f"FROM {_SHOPPED})") + ", f AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY link) AS nth FROM l WHERE md5(link) >= '5') SELECT page_id AS listing_id, link AS url, md5(link) AS target FROM f WHERE nth <= 3")
_KIND = "CASE p_partkey % 5 WHEN 0 THEN 'b?q=1' WHEN 1 THEN '../c' WHEN 2 THEN './d/../e/' WHEN 3 THEN '?x=2#f' ELSE '//h.example.com/i' END"
_add("url_join", lambda s, d: table(s, d, "part").select("p_partkey", fn.absolute_url(F.expr("'http://x.com/a/b' || cast(p_partkey AS string)"), F.expr(_KIND)).alias("url"), fn.absolute_url(F.lit("http://x.com"), F.expr("'a' || cast(p_partkey AS string)")).alias("bare")),
     "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'http://x.com/a/b?q=1' WHEN 1 THEN 'http://x.com/c' WHEN 2 THEN 'http://x.com/a/e/' WHEN 3 THEN 'http://x.com/a/b' || p_partkey || '?x=2' ELSE 'http://h.example.com/i' END AS url, 'http://x.com/a' || p_partkey AS bare FROM part")
_add("title_case", lambda s, d: table(s, d, "documents").select("doc_id", fn.title_case(F.substring(F.regexp_replace(F.replace("text", F.lit("ß"), F.lit("ss")), r"\s+", " "), 1, 40)).alias("title")), r"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(substr(regexp_replace(replace(text, 'ß', 'ss'), '[\t\n\x0b\f\r ]+', ' ', 'g'), 1, 40)), '\p{L}+|\P{L}+'), lambda w: upper(w[1]) || w[2:]), '') AS title FROM documents")

"""Products out of web pages (page_id, url, html): structured data, meta tags, cards and patterns, each a DataFrame operator.

Every extractor returns (page_id, url, pos, product_image, sku_upc, product_name, color, msrp); texts are '' where missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import lexicon as lex
from gristmill.functions import markup as mk
from gristmill.functions import scalar as fn
from gristmill.operators import dom
from gristmill.operators import products as op
from gristmill.sources.tables import written

RECORD = ["product_image", "sku_upc", "product_name", "color", "msrp"]
_ITEM = "`@type` string, `@graph` string, itemListElement string, item string, name string, sku string, productID string, gtin13 string, image string, color string, offers string"
_LIST = "array<string>"


def _or(*values: Column) -> Column:
    """The first value that is neither null nor '', else ''."""
    return F.coalesce(F.get(F.filter(F.array(*values), lambda v: v != ""), F.lit(0)), F.lit(""))


# The rules of scalar.py name their argument many times; here they are given expressions, which so stand once in the plan.

def _url(base: Column, href: Column) -> Column:
    return fn.let(F.struct(base.alias("base"), href.alias("href")), lambda x: fn.absolute_url(x["base"], x["href"]))


def _price(text: Column) -> Column:
    return fn.let(text, fn.web_price)


def _labelled_price(text: Column) -> Column:
    return fn.let(text, fn.best_price)


def _sku(text: Column) -> Column:
    return fn.let(text, fn.valid_sku)


def _color(name: Column) -> Column:
    return fn.let(name, fn.color_in_name)


def _listed(json: Column) -> Column:
    """The elements of a JSON list, or the value itself as the only one."""
    return F.when(F.trim(json).startswith("["), F.from_json(json, _LIST)).otherwise(F.array(json))


def _from_page(url: Column, image: Column) -> Column:
    return fn.let(F.struct(url.alias("url"), image.alias("image")), lambda x: F.when((x["image"] == "") | x["image"].startswith("http"), x["image"]).otherwise(fn.absolute_url(x["url"], x["image"])))


def image_score(url: Column) -> Column:
    low = F.lower(url)
    return reduce(lambda a, b: a + b, (F.when(fn.contains_any(low, words), points).otherwise(0) for words, points in lex.IMAGE_WORDS)) + F.when(fn.ends_with_any(low, lex.IMAGE_ENDINGS), 10).otherwise(0)


def best_image(urls: Column) -> Column:
    """The URL of the largest score, the first of equal ones; '' of none."""
    scored = F.transform(urls, lambda u, i: F.struct(image_score(u).alias("score"), (-i).alias("place"), u.alias("url")))
    return F.coalesce(F.array_max(scored)["url"], F.lit(""))


def image_urls(tag: Column, url: Column) -> Column:
    """All URLs of an img tag: its srcset from the widest on, lazy-loading attributes, src."""
    parts = F.filter(F.transform(F.split(mk.attribute(tag, "srcset"), ","), fn.strip), lambda p: p != "")
    sized = F.transform(parts, lambda p, i: F.struct((-F.coalesce(F.regexp_extract(p, r"\s(\d+)w", 1).try_cast("int"), F.lit(0))).alias("w"), i.alias("i"), F.get(F.split(p, r"\s+"), F.lit(0)).alias("u")))
    lazy = [mk.attribute(tag, a) for a in ("data-src", "data-original", "data-zoom-image", "data-large")]
    src = mk.attribute(tag, "src")
    every = F.concat(F.transform(F.array_sort(sized), lambda x: x["u"]), F.array(*lazy, F.when(src.startswith("data:"), "").otherwise(src)))
    return F.transform(F.filter(every, lambda u: u != ""), lambda u: _url(url, u))


def main_image(html: Column, url: Column) -> Column:
    """The best image of product galleries, else of the whole page."""
    framed = F.regexp_extract_all(html, F.lit(r"""(?is)class\s*=\s*["'][^"']*(?:product-image|ProductImage|product-photo|gallery|main-image)[^"']*["'][^>]*>\s*(?:<a\b[^>]*>\s*)?(<img\b[^>]*>)"""), 1)
    marked = F.filter(mk.tags(html, "img"), lambda t: mk.attribute(t, "itemprop") == "image")
    urls = lambda tags: F.flatten(F.transform(tags, lambda t: image_urls(t, url)))
    best = best_image(fn.let(urls(F.concat(framed, marked)), lambda own: F.when(F.size(own) > 0, own).otherwise(urls(mk.tags(html, "img")))))
    return F.when(html.rlike("(?i)<img"), best).otherwise("")


# ---- page features

def json_ld(html: Column) -> Column:
    return F.filter(F.flatten(F.transform(mk.scripts(html, r"application/ld\+json"), _listed)), lambda x: x.isNotNull())


def has_product_schema(html: Column) -> Column:
    def typed(item: Column) -> Column:
        return F.lower(F.from_json(item, _ITEM)["@type"]).isin("product", "productgroup")

    graph = lambda item: F.coalesce(F.from_json(F.from_json(item, _ITEM)["@graph"], _LIST), F.array().cast(_LIST))
    found = F.exists(json_ld(html), lambda i: F.coalesce(typed(i), F.lit(False)) | F.exists(graph(i), lambda g: F.coalesce(typed(g), F.lit(False))))
    return found | html.rlike(r"""(?i)itemtype\s*=\s*["'][^"']*schema.org/product""")


CARDS = [
    *(mk.with_attribute(a) for a in ("data-product-id", "data-sku", "data-item-id", "data-product", "data-product-handle")),
    *(mk.of_class(c) for c in ("product-card", "product-tile", "product-item", "product-grid-item", "product-list-item", "ProductCard", "ProductItem", "ProductTile")),
    *(mk.class_holds(c) for c in ("product-card", "product-tile", "ProductCard", "ProductTile")),
    mk.of_class("search-result-item"), mk.of_class("plp-item"), mk.class_holds("plp-"), mk.of_class("grid-product"), mk.of_class("product", "li"), mk.of_class("product-item-info"), mk.with_attribute("data-product-listing"),
]
#: What the tag of every card shows, anywhere and, nearer, in its own attributes.
CARD_SIGN = "product|Product|data-sku|data-item-id|search-result-item|plp-"
CARD_TAG = rf"""\s(?:data-(?:product|sku|item-id)|class\s*=\s*["'][^"']*(?:{CARD_SIGN}))"""
#: The same with the class that some element around a card must have.
CARD_SELECTORS = [(c, mk.of_class("grid__item") if c == mk.of_class("grid-product") else None) for c in CARDS]
PRICES = [mk.class_holds("price"), mk.with_attribute("data-price"), mk.with_attribute("itemprop", "price"), mk.class_holds("Price"), mk.of_class("Price"), mk.of_class("money"), mk.with_attribute("data-regular-price"), mk.with_attribute("data-sale-price")]
SKUS = [mk.with_attribute("itemprop", "sku"), mk.with_attribute("data-sku"), mk.with_attribute("data-product-id"), mk.with_attribute("data-item-id"), mk.class_holds("sku"), mk.class_holds("model"), mk.with_attribute("data-model"), mk.with_attribute("data-upc")]
NAMES = [*(mk.class_holds(c) for c in ("product-name", "product-title", "ProductName", "ProductTitle", "item-title", "item-name")), mk.with_attribute("itemprop", "name"), *(rf"<{h}\b[^>]*>" for h in ("h2", "h3", "h4"))]

#: What the tag of every element shows that SKUS, PRICES, NAMES or COLOR_MARK find, and each of them.
FIELD_SIGN = "(?i)price|money|sku|product|item|model|upc|name|title|color|^<h[234]"
SKU_SIGN, PRICE_SIGN, NAME_SIGN = "sku|data-(?:product|item)-id|model|data-upc", "[Pp]rice|money", "product-(?:name|title)|Product(?:Name|Title)|item-(?:title|name)|itemprop|<h[234]"
COLOR_MARK = "|".join([mk.class_holds("color"), mk.with_attribute("data-color")])


def _counts(html: Column, selectors: list[str]) -> Column:
    return F.array(*(F.regexp_count(html, F.lit(s)) for s in selectors))


def card_count(html: Column) -> Column:
    return F.array_max(_counts(html, CARDS))


def has_single_price(html: Column) -> Column:
    return F.array_contains(_counts(html, PRICES[:4]), F.lit(1))


def has_add_to_cart(html: Column) -> Column:
    return html.rlike(rf"(?is)<button\b[^>]*>[^<]*{lex.ADD_TO_CART}") | html.rlike(rf"""(?i)\s(?:class|id)\s*=\s*["'][^"']*{lex.ADD_TO_CART}""")


def is_shop_platform(html: Column) -> Column:
    low = F.lower(html)
    return fn.contains_any(html, lex.SHOP_MARKS) | F.contains(F.substring(low, 1, 5000), F.lit('"shopify"')) | html.rlike(r"""<meta[^>]*name=["']shopify-checkout-api-token["']""")


def page_type(url: Column, html: Column) -> Column:
    by_url, atc, one, grid = fn.page_type(url), has_add_to_cart(html), has_single_price(html), card_count(html) >= 4
    return (
        F.when(by_url.isin("search", "editorial", "homepage"), by_url)
        .when((has_product_schema(html) & atc) | (atc & one & ~grid) | (fn.product_url(url) & one), "pdp")
        .when(grid, "category").otherwise(by_url)
    )


# ---- extractors

def _keys(rows: DataFrame) -> list[str]:
    """What tells pages apart: their row where they were parsed, and what they carry."""
    return [c for c in ("row", "page_id", "url") if c in rows.columns]


def _record(rows: DataFrame, **values: Column) -> DataFrame:
    return rows.select(*_keys(rows), "pos", *(F.coalesce(values.get(c, F.lit("")), F.lit("")).alias(c) for c in RECORD))


def json_ld_products(pages: DataFrame) -> DataFrame:
    """Products of JSON-LD scripts: bare, in a list, in @graph or in an ItemList."""
    items = pages.select(*_keys(pages), F.posexplode(json_ld(F.col("html"))).alias("at", "json")).withColumn("i", F.from_json("json", _ITEM))
    listed = F.transform(F.from_json("i.itemListElement", _LIST), lambda e: F.coalesce(F.from_json(e, _ITEM)["item"], e))
    kind = lambda p: F.coalesce(F.from_json(p, _ITEM)["@type"] == "Product", F.lit(False))
    named = lambda p: kind(p) | F.from_json(p, _ITEM)["name"].isNotNull()
    found = (
        F.when((F.col("i.@type") == "ItemList") & F.col("i.itemListElement").isNotNull(), F.filter(listed, named))
        .when(F.col("i.@graph").isNotNull(), F.filter(F.from_json("i.@graph", _LIST), kind))
        .when(F.col("i.@type") == "Product", F.array("json"))
    )
    found = items.select(*_keys(pages), "at", F.posexplode(found).alias("k", "json")).select(*_keys(pages), (F.col("at") * 1000 + F.col("k")).alias("pos"), F.from_json("json", _ITEM).alias("p"))
    image, offer = F.coalesce("p.image", F.lit("")), F.get(_listed(F.coalesce("p.offers", F.lit("{}"))), F.lit(0))
    nested = F.from_json(image, "url string, contentUrl string")
    image = F.when(image.startswith("["), best_image(F.from_json(image, _LIST))).when(image.startswith("{"), F.coalesce(nested["url"], nested["contentUrl"], F.lit(""))).otherwise(image)
    offer = F.from_json(offer, "price string, highPrice string, lowPrice string")
    price = F.coalesce(F.nullif(offer["price"], F.lit("")), offer["highPrice"], offer["lowPrice"], F.lit(""))
    sku = F.coalesce("p.sku", "p.productID", "p.gtin13", F.lit(""))
    return _record(found, product_image=_from_page(F.col("url"), image), sku_upc=_sku(sku), product_name=F.col("p.name"), color=_or(F.col("p.color"), _color(F.col("p.name"))), msrp=_price(price))


_FRAMEWORK = "name string, title string, productName string, product_name string, price string, msrp string, amount string, salePrice string, retailPrice string, image string, images string, imageUrl string, image_url string, thumbnail string, primaryImage string, sku string, productId string, id string, color string, colorName string"


def framework_products(pages: DataFrame, depth: int = 10) -> DataFrame:
    """Products of a page framework's data script: objects with a name and a price or image, down to ``depth``; what is inside one is not searched.

    The walk goes level by level: each opens the objects and lists that the one before left, and is written, so it is as long as the data are deep and has no limit of rows."""
    names, signs = ("name", "title", "productName", "product_name"), ("price", "msrp", "amount", "salePrice", "retailPrice", "image", "images", "imageUrl", "image_url", "thumbnail")
    keys = ["row", "page_id", "url"]
    keyed = pages if "row" in pages.columns else pages.withColumn("row", F.monotonically_increasing_id())
    level = keyed.select(*keys, F.explode(F.slice(mk.scripts(F.col("html"), "__NEXT_DATA__"), 1, 1)).alias("json")).select(*keys, F.trim("json").alias("json"), F.lit("").alias("place"))
    parsed = F.from_json("json", _FRAMEWORK)
    named = F.length(F.coalesce(*(F.nullif(parsed[n], F.lit("")) for n in names), F.lit(""))) > 2
    hit = F.col("json").startswith("{") & named & reduce(lambda a, b: a | b, (parsed[n].isNotNull() for n in signs))
    inner = F.when(F.col("json").startswith("["), F.from_json("json", _LIST)).when(F.col("json").startswith("{"), F.map_values(F.from_json("json", "map<string,string>")))
    found = []
    for d in range(depth + 1):
        # a text or number holds nothing
        level = written(level.filter(F.substring("json", 1, 1).isin("{", "[")).withColumn("hit", F.coalesce(hit, F.lit(False))), "walk")
        found.append(level.filter("hit"))
        if d == depth or level.filter("not hit").isEmpty():
            break
        level = level.filter("not hit").select(*keys, "place", F.posexplode(inner).alias("k", "child")).select(*keys, F.trim("child").alias("json"), F.concat("place", F.lpad(F.col("k").cast("string"), 9, "0")).alias("place"))
    walk = reduce(DataFrame.union, found).select(*keys, "json", "place")
    rows = walk.withColumn("pos", F.row_number().over(Window.partitionBy("row").orderBy("place")) - 1).withColumn("p", F.from_json("json", _FRAMEWORK))
    shape = lambda v: F.from_json(v, "src string, url string")
    first = lambda v: F.get(F.from_json(v, _LIST), F.lit(0))
    one = lambda v: F.when(v.startswith("["), F.when(first(v).startswith("{"), _or(shape(first(v))["src"], shape(first(v))["url"])).otherwise(first(v))).when(v.startswith("{"), _or(shape(v)["src"], shape(v)["url"])).otherwise(v)
    used = F.get(F.filter(F.array(*(F.col(f"p.{c}") for c in ("image", "imageUrl", "image_url", "thumbnail", "primaryImage"))), lambda v: v.isNotNull() & ~v.isin("", "[]", "{}")), F.lit(0))
    image = _or(_from_page(F.col("url"), F.coalesce(one(used), F.lit(""))), one(F.col("p.images")))
    money = lambda v: F.when(v.startswith("{"), _or(F.from_json(v, "amount string")["amount"], F.from_json(v, "value string")["value"])).otherwise(v)
    price = _or(*(_price(F.coalesce(money(F.col(f"p.{c}")), F.lit(""))) for c in ("price", "msrp", "retailPrice", "salePrice", "amount")))
    color = _or(F.col("p.color"), F.col("p.colorName"))
    color = F.when(color.startswith("{"), _or(F.from_json(color, "name string")["name"], F.from_json(color, "label string")["label"])).otherwise(color)
    full = _or(*(F.col(f"p.{c}") for c in ("name", "title", "productName", "product_name")))
    return _record(rows, product_image=image, sku_upc=_sku(_or(F.col("p.sku"), F.col("p.productId"), F.col("p.id"))), product_name=full, color=color, msrp=price)


def _price_of(tag: Column, text: Column) -> Column:
    """The price of a marked element: its data first, then its text."""
    return _or(_price(_or(mk.attribute(tag, "data-price"), mk.attribute(tag, "content"))), _labelled_price(text))


def _sku_of(tag: Column, text: Column) -> Column:
    return _sku(_or(mk.attribute(tag, "content"), text))


def _marked_price(html: Column, selectors: list[str]) -> Column:
    return mk.first_of(mk.elements(html, selectors), _price_of)


def _marked_sku(html: Column, selectors: list[str]) -> Column:
    return mk.first_of(mk.elements(html, selectors), _sku_of)


def may_hold_cards(html: Column) -> Column:
    """False only for pages without cards: three tags show the sign of a selector, or a grid has four images."""
    return (F.regexp_count(html, F.lit(CARD_SIGN)) >= 3) | (F.regexp_count(html, F.lit("(?i)<img")) >= 4)


def card_products(pages: DataFrame) -> DataFrame:
    """Products of a page's repeated cards: those of the selector that finds most, three at least, else of its best repeating grid."""
    # an explode, not a filter, which would be moved ahead of the exchange that deals the pages out, and make each page twice
    held = pages.select("page_id", "url", F.explode(F.filter(F.array("html"), may_hold_cards)).alias("html"))
    return cards_to_products(dom.cards(dom.parse(held), CARD_SELECTORS, CARD_TAG))


def cards_to_products(cards: DataFrame) -> DataFrame:
    """A product of each card (row, page_id, url, pos, tokens, nodes) that shows a name, a SKU or an image."""
    tokens, url = F.col("tokens"), F.col("url")
    rest = F.slice("nodes", 2, 1 << 20)
    own = F.get("nodes", F.lit(0))["tag"]
    tag_of = lambda name, more="": F.coalesce(dom.first_node(rest, rf"(?i)^<{name}(?=[\s/>])" + more)["tag"], F.lit(""))
    # found once a card, then read by the rules
    found = cards.select("row", "page_id", "url", "pos", own.alias("own"), tag_of("img").alias("img"), tag_of("a", r"(?=[^>]*\shref)").alias("a"), fn.let(F.filter(rest, lambda n: n["tag"].rlike(FIELD_SIGN)), lambda held: F.struct(*(dom.firsts(tokens, held, x, sign).alias(n) for n, x, sign in (("skus", SKUS, SKU_SIGN), ("prices", PRICES, PRICE_SIGN), ("names", NAMES, NAME_SIGN), ("colors", [COLOR_MARK], ""))))).alias("fields"), F.transform(F.filter(tokens, dom.is_text), lambda t: fn.strip(mk.unescape(t))).alias("texts"))
    img, own = F.col("img"), F.col("own")
    read = {
        "src": _or(*(mk.attribute(img, a) for a in ("data-src", "data-lazy-src", "src"))),
        "last": F.get(F.split(fn.strip(F.element_at(F.split(mk.attribute(img, "srcset"), ","), -1)), r"\s+"), F.lit(0)),
        "link": mk.attribute(F.col("a"), "href"),
        "own_sku": _sku(_or(*(mk.attribute(own, a) for a in ("data-product-id", "data-sku", "data-item-id", "data-pid", "data-id")))),
    }
    found = found.select("row", "page_id", "url", "pos", "fields.*", "texts", *(v.alias(n) for n, v in read.items()))
    src, last, link, sku = (F.col(n) for n in read)
    image = _or(F.when((src != "") & ~src.startswith("data:"), _url(url, src)), F.when(last != "", _url(url, last)))
    sku = F.when(sku != "", sku).otherwise(mk.first_of(F.col("skus"), _sku_of))
    fits = lambda _, x: F.when((F.length(x) > 3) & (F.length(x) < 150), x).otherwise("")
    plain = F.get(F.filter("texts", lambda x: (F.length(x) > 4) & (F.length(x) < 150) & ~x.rlike(r"^[\$\d\.\,\s]+$")), F.lit(0))
    name = _or(mk.first_of(F.col("names"), fits), plain)
    color = F.substring(F.get("colors", F.lit(0))["text"], 1, 50)
    values = {"product_image": image, "sku_upc": sku, "product_name": name, "color": color, "msrp": mk.first_of(F.col("prices"), _price_of)}
    record = F.struct(F.when(link != "", _url(url, link)).otherwise(url).alias("url"), *(F.coalesce(v, F.lit("")).alias(c) for c, v in values.items()))
    # tested where it is made: a filter behind would be moved ahead and work the fields out twice
    shown = F.filter(F.array(record), lambda r: (r["product_name"] != "") | (r["sku_upc"] != "") | (r["product_image"] != ""))
    return found.select("row", "page_id", "pos", F.explode(shown).alias("record")).select("row", "page_id", "record.url", "pos", *(f"record.{c}" for c in values))


def meta_products(pages: DataFrame) -> DataFrame:
    """The product of a page's Open Graph tags."""
    html = F.col("html")
    name, image = mk.meta(html, "og:title"), F.coalesce(mk.meta(html, "og:image"), F.lit(""))
    price = F.coalesce(mk.meta(html, "product:price:amount"), mk.meta(html, "og:price:amount"), F.lit(""))
    sku = F.coalesce(mk.meta(html, "product:retailer_item_id"), F.lit(""))
    rows = pages.withColumns({"pos": F.lit(0), "name": name}).filter("name != ''")
    return _record(rows, product_image=_from_page(F.col("url"), image), sku_upc=_sku(sku), product_name=F.col("name"), color=_color(F.col("name")), msrp=_price(price))


def pattern_products(pages: DataFrame) -> DataFrame:
    """The product that a page's heading, or else its title, names, with the first price, SKU and image found."""
    return parsed_pattern_products(dom.parse(pages))


_PATTERN_PRICES = [PRICES[0], PRICES[3], PRICES[1], mk.of_class("price"), mk.with_attribute("id", "price"), PRICES[2]]
_PATTERN_SKUS = [mk.class_holds("sku"), mk.class_holds("Sku"), mk.with_attribute("itemprop", "sku"), mk.class_holds("product-id"), mk.class_holds("style-number")]
_PATTERN_SIGN, _PATTERN_SKU_SIGN = "[Pp]rice", "[Ss]ku|product-id|style-number"
_HEADS = [r"(?i)^<h1[\s/>]", r"(?i)^<title[\s/>]"]


def parsed_pattern_products(parsed: DataFrame) -> DataFrame:
    tokens, nodes = F.col("tokens"), F.col("nodes")
    found = parsed.select(*_keys(parsed), dom.firsts(tokens, nodes, _HEADS, "(?i)^<(?:h1|title)").alias("heads"), dom.firsts(tokens, nodes, _PATTERN_PRICES, _PATTERN_SIGN).alias("prices"), dom.firsts(tokens, nodes, _PATTERN_SKUS, _PATTERN_SKU_SIGN).alias("skus"), F.array_join("tokens", "").alias("html"))
    heading = F.get("heads", F.lit(0))["text"]
    title = fn.strip(F.get(F.split(F.get(F.split(F.get("heads", F.lit(1))["text"], r"\|"), F.lit(0)), "–"), F.lit(0)))
    # an explode, not a filter, which would be moved ahead and look for the headings twice
    rows = found.select("*", F.lit(0).alias("pos"), F.explode(F.filter(F.array(_or(heading, title)), lambda x: x != "")).alias("name"))
    return _record(rows, product_image=main_image(F.col("html"), F.col("url")), sku_upc=mk.first_of(F.col("skus"), _sku_of), product_name=F.col("name"), color=_color(F.col("name")), msrp=mk.first_of(F.col("prices"), _price_of))


def shop_products(feeds: DataFrame) -> DataFrame:
    """(page_id, url, pos, …, category): products of shop feeds (page_id, url, json), one per colour, or per variant without one."""
    image, variant = "array<struct<id: bigint, src: string>>", "array<struct<id: bigint, sku: string, price: string, option1: string, option2: string, image_id: bigint>>"
    feed = F.from_json("json", f"products array<struct<title: string, product_type: string, handle: string, images: {image}, variants: {variant}>>")
    root = F.regexp_extract("url", r"^(https?://[^/?#]*)", 1)
    each = feeds.select("page_id", root.alias("root"), F.posexplode(feed["products"]).alias("at", "p"))
    option = lambda o: F.when((o != "") & ~F.lower(o).isin(lex.DEFAULT_OPTIONS) & fn.looks_like_color(o), o)

    def keyed(v: Column, k: Column) -> Column:
        color = F.coalesce(option(v["option1"]), option(v["option2"]), F.lit(""))
        return fn.let(color, lambda c: F.struct(k.alias("k"), v.alias("v"), c.alias("color"), F.when(c != "", F.lower(c)).otherwise(F.concat(F.lit("_var_"), F.coalesce(v["id"].cast("string"), F.lit("")))).alias("key")))

    # the first variant of each key, within the product's row: nothing is shuffled or sorted
    def firsts(variants: Column) -> Column:
        return fn.let(F.transform(variants, lambda x: x["key"]), lambda keys: F.filter(variants, lambda x: F.array_position(keys, x["key"]) == x["k"] + 1))

    kept = each.select("page_id", "root", "at", "p.title", "p.product_type", "p.handle", "p.images", F.explode(fn.let(F.transform("p.variants", keyed), firsts)).alias("x")).select("*", "x.*")
    own = F.get(F.filter("images", lambda i: i["id"] == F.col("v.image_id")), F.lit(0))["src"]
    kept = kept.withColumns({"url": F.concat("root", F.lit("/products/"), F.coalesce("handle", F.lit(""))), "pos": F.col("at") * 1000 + F.col("k"), "category": F.coalesce("product_type", F.lit(""))})
    price = F.when(F.col("v.price") != "", fn.dollars(F.col("v.price").cast("double")))
    out = {"product_image": F.coalesce(own, F.get("images", F.lit(0))["src"]), "sku_upc": F.col("v.sku"), "product_name": F.col("title"), "color": F.col("color"), "msrp": price}
    return kept.select("page_id", "url", "pos", *(F.coalesce(v, F.lit("")).alias(c) for c, v in out.items()), "category")


# ---- filters and the cascade

def _as_products(found: DataFrame) -> DataFrame:
    return found.withColumns({"source_detail": F.col("url"), "your_cost": F.lit(""), "qty": F.lit(""), "notes": F.lit("")})


def filter_products(products: DataFrame, page_url: Column, page_type: Column, include_uncertain: bool = False) -> DataFrame:
    """Products that score as confirmed or likely (or uncertain, if asked for), with confidence added."""
    scored = products.withColumn("confidence", op.product_score(page_url, page_type))
    return scored.filter(F.col("confidence") >= (0.15 if include_uncertain else 0.40))


def real_products(products: DataFrame) -> DataFrame:
    """The filter of a site scan: rejects names of pages, blanks slugs that pose as SKUs, scores again, and blanks prices without a digit."""
    named = products.filter((F.col("product_name") != "") & ~F.lower(fn.strip(F.col("product_name"))).isin(lex.PAGE_NAMES))
    slug = F.col("sku_upc").rlike(r"^[a-z0-9\-]{10,}$") & F.col("sku_upc").contains("-")
    named = named.withColumn("sku_upc", F.when(slug, "").otherwise(F.col("sku_upc")))
    kept = filter_products(named, F.col("source_detail"), F.lit("unknown"))
    return kept.withColumn("msrp", F.when(F.col("msrp").rlike(r"\d"), F.col("msrp")).otherwise(""))


def page_products(pages: DataFrame) -> DataFrame:
    """(row, page_id, page_url, strategy, pos, url, …, confidence): the products of each page by the first strategy that finds any, cards added on listings, then filtered by score.

    Pages are parsed once, into a table of which each row is a page, so rows of one page_id don't mix. What a step finds is
    written, so each is a plan of its own and only what was found meets again."""
    parsed = dom.parse(pages)
    html = dom.html_of(parsed)
    kinds = written(html.select("row", F.col("url").alias("page_url"), page_type(F.col("url"), F.col("html")).alias("page_type")), "kinds")
    steps = [json_ld_products(html), framework_products(html), cards_to_products(dom.cards(parsed, CARD_SELECTORS, CARD_TAG)), meta_products(html), parsed_pattern_products(parsed)]
    found = written(reduce(DataFrame.unionByName, (written(f, "found").withColumn("strategy", F.lit(n + 1)) for n, f in enumerate(steps))), "all")
    page = Window.partitionBy("row")
    first = F.min("strategy").over(page)
    names = F.collect_set(F.when(F.col("strategy") < 3, F.when(F.col("product_name") != "", F.lower("product_name")))).over(page)
    listing = F.col("page_type").isin("category", "search", "unknown")
    stays = (F.col("strategy") == F.col("first")) | ((F.col("strategy") == 3) & listing & (F.col("first") < 3) & ~F.array_contains("names", F.lower("product_name")))
    found = found.join(kinds, "row").withColumns({"first": first, "names": names}).filter(stays)
    return filter_products(_as_products(found), F.col("page_url"), F.col("page_type")).select("row", "page_id", "page_url", "strategy", "pos", "url", *RECORD, "confidence")


def follow_links(listings: DataFrame, links: DataFrame, pages: DataFrame, most: int = 50) -> DataFrame:
    """Pages that listings link to, most of each in the order of their links, without the listing's own products' pages.

    listings: (page_id, source_detail) of products already found; links: (page_id, link); pages: (url, …)."""
    fresh = links.join(listings.select("page_id", F.col("source_detail").alias("link")).distinct(), ["page_id", "link"], "left_anti")
    ranked = fresh.withColumn("nth", F.row_number().over(Window.partitionBy("page_id").orderBy("link"))).filter(F.col("nth") <= most)
    return ranked.select(F.col("page_id").alias("listing_id"), F.col("link").alias("url")).join(pages, "url")

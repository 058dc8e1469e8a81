"""Walks over held documents: sitemaps from a site's roots on, and the plan of a site scan over a table of pages.

Nothing is fetched: an address that the tables don't hold is one that could not be read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import lexicon as lex
from gristmill.functions import markup as mk
from gristmill.functions import scalar as fn
from gristmill.operators import dom
from gristmill.operators import pages as pg
from gristmill.operators import products as op
from gristmill.sources.tables import written


def _locations(xml: Column, element: str) -> Column:
    """The first <loc> of each element of a name, in order, '' where it has none."""
    plain = F.regexp_replace(xml, r"(?s)<!--.*?-->", "")
    inner = F.regexp_extract_all(plain, F.lit(rf"(?is)<{element}(?:\s[^>]*)?>(.*?)</{element}\s*>"), 1)
    loc = lambda x: F.regexp_replace(F.regexp_extract(x, r"(?is)<loc(?:\s[^>]*)?>(.*?)</loc\s*>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return F.transform(inner, lambda x: fn.strip(mk.unescape(loc(x))))


def _site_root(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)


def sitemap_walk(sites: DataFrame, sitemaps: DataFrame, most: int = 100) -> DataFrame:
    """(site, nth, url): the first product addresses, ``most`` at the most and repeats included, that the sitemaps of each site (site) give.

    sitemaps: (url, xml). The walk begins at the site's three usual places and goes on, in order, to the sitemaps they name whose
    address holds "product"; one met again is not read again. It goes level by level: each level is written, and its
    sitemaps join the table once, for all sites together. A site that has enough addresses is not walked further."""
    start = sites.select("site").distinct().select("site", F.posexplode(F.transform(F.array(*(F.lit(x) for x in lex.SITEMAP_PLACES)), lambda p: F.concat(_site_root(F.col("site")), p))).alias("k", "url"))
    level = start.select("site", "url", F.lpad(F.col("k").cast("string"), 9, "0").alias("place"))
    maps = sitemaps.groupBy("url").agg(F.min("xml").alias("xml"))
    found, seen, depth = [], None, 0
    while True:
        level = level.groupBy("site", "url").agg(F.min("place").alias("place"))
        if seen is not None:
            level = level.join(seen, ["site", "url"], "left_anti")
        read = level.join(maps, "url", "left")
        read = written(read.select("site", "url", "place", _locations(F.col("xml"), "sitemap").alias("subs"), _locations(F.col("xml"), "url").alias("urls")), "sitemaps")
        products = read.select("site", "place", F.posexplode("urls").alias("k", "link")).filter(F.col("link").rlike("(?i)" + lex.SITEMAP_PRODUCT) & ~fn.non_product_path(F.col("link")))
        found.append(products.select("site", F.lit(depth).alias("depth"), "place", "k", F.col("link").alias("url")))
        seen = read.select("site", "url") if seen is None else seen.union(read.select("site", "url"))
        enough = reduce(DataFrame.union, found).groupBy("site").agg(F.count("*").alias("n")).filter(F.col("n") >= most).select("site")
        subs = read.join(enough, "site", "left_anti").select("site", "place", F.posexplode("subs").alias("k", "link")).filter(F.lower("link").contains("product"))
        level = subs.select("site", F.col("link").alias("url"), F.concat("place", F.lpad(F.col("k").cast("string"), 9, "0")).alias("place"))
        depth += 1
        if level.isEmpty():
            break
    order = Window.partitionBy("site").orderBy("depth", "place", "k")
    return reduce(DataFrame.union, found).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).select("site", "nth", "url")


#: What a visit is for: the landing page, a collection, a page that a collection links to, a page that the landing page links to, a page of the sitemap.
LANDING, COLLECTION, FOLLOWED, LINKED, MAPPED = "landing", "collection", "followed", "linked", "sitemap"


def _products_of(visits: DataFrame, pages: DataFrame) -> DataFrame:
    """The products of visits (site, branch, visit, url), each page extracted once however many visits it has."""
    visits = written(visits, "visits")
    seen = pages.join(visits.select("url").distinct(), "url", "left_semi")
    found = pg.page_products(seen.select(F.lit(None).cast("bigint").alias("page_id"), "url", "html")).withColumnRenamed("url", "source_detail")
    return written(visits.withColumnRenamed("url", "page_url").join(found.drop("row", "page_id", "strategy", "confidence"), "page_url"), "products")


def site_crawl(sites: DataFrame, pages: DataFrame, feeds: DataFrame, sitemaps: DataFrame, collections: int = 20, links: int = 50, enough: int = 3) -> DataFrame:
    """(site, branch, visit, pos, source_detail, product_image, sku_upc, product_name, color, msrp, confidence): the products of a scan of each site.

    sites: (site), addresses of landing pages; pages: (url, html); feeds: (site, json), shop feeds; sitemaps: (url, xml). A site whose landing page is not held has none.
    A shop platform with a feed that lists products is read from it alone. Else the landing page is read, and its first
    ``collections`` collections with all product pages they link to, but for those of products already listed; a site
    that links to no collection has its first ``links`` product links read. Where fewer than ``enough`` products pass the
    filter, the first ``links`` addresses of the sitemap are read too. Each step is one plan over all sites at once. Rows
    of pages with an equal url count once, those of the smaller html."""
    held = written(pages.groupBy("url").agg(F.min("html").alias("html")), "pages")
    landing = written(sites.select("site").distinct().join(held, F.col("site") == F.col("url")).select("site", "url", "html", pg.is_shop_platform(F.col("html")).alias("shop")), "landing")
    fed = pg.shop_products(feeds.join(landing.filter("shop").select("site"), "site", "left_semi").select(F.col("site").alias("page_id"), F.col("site").alias("url"), "json"))
    fed = written(fed.select(F.col("page_id").alias("site"), F.lit("feed").alias("branch"), F.lit(0).alias("visit"), "pos", F.col("url").alias("source_detail"), *pg.RECORD), "fed")
    open_sites = landing.join(fed.select("site").distinct(), "site", "left_anti").select(F.col("site").alias("page_id"), "url", "html")

    nth = lambda df, order="link": df.withColumn("visit", F.row_number().over(Window.partitionBy("site").orderBy(order)))
    listed = written(nth(op.page_links(open_sites, lex.COLLECTION_LINK).withColumnRenamed("page_id", "site")), "collections")
    first = open_sites.select(F.col("page_id").alias("site"), F.lit(LANDING).alias("branch"), F.lit(0).alias("visit"), "url")
    gathered = listed.filter(F.col("visit") <= collections).select("site", F.lit(COLLECTION).alias("branch"), "visit", F.col("link").alias("url"))
    alone = open_sites.join(listed.select(F.col("site").alias("page_id")), "page_id", "left_anti")
    linked = nth(dom.product_links(dom.parse(alone)).withColumnRenamed("page_id", "site")).filter(F.col("visit") <= links)
    linked = linked.select("site", F.lit(LINKED).alias("branch"), "visit", F.col("link").alias("url"))
    begun = _products_of(first.union(gathered).union(linked), held)

    # pages that the collections link to, without those of the products that the collection itself lists
    listing = gathered.join(held, "url")
    onward = dom.product_links(dom.parse(listing.select(F.struct("site", "visit", "url").alias("page_id"), "url", "html")))
    shown = begun.filter(F.col("branch") == COLLECTION).select(F.struct("site", "visit", F.col("page_url").alias("url")).alias("page_id"), F.col("source_detail").alias("link")).distinct()
    onward = onward.join(shown, ["page_id", "link"], "left_anti").select("page_id.site", F.lit(FOLLOWED).alias("branch"), "page_id.visit", F.col("link").alias("url"))
    followed = _products_of(onward, held)

    columns = ["site", "branch", "visit", "pos", "source_detail", *pg.RECORD]
    plain = lambda df: df.select(*columns).withColumns({"your_cost": F.lit(""), "qty": F.lit(""), "notes": F.lit("")})
    kept = written(pg.real_products(plain(begun).union(plain(followed)).union(plain(fed))), "kept")
    few = open_sites.select(F.col("page_id").alias("site")).join(kept.groupBy("site").agg(F.count("*").alias("n")).filter(F.col("n") >= enough), "site", "left_anti")
    mapped = sitemap_walk(few, sitemaps).filter(F.col("nth") <= links).select("site", F.lit(MAPPED).alias("branch"), F.col("nth").alias("visit"), "url")
    more = pg.real_products(plain(_products_of(mapped, held)))
    return kept.unionByName(more).select(*columns, "confidence")

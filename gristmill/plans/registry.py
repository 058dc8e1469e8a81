"""Registered queries over the given tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import lexicon as lex
from gristmill.functions import scalar as fn
from gristmill.operators import products as op
from gristmill.plans import catalog, layout, sheetfiles, sites, web
from gristmill.sources.tables import RAW_OFFERS, raw_offers, state_folder, table
from gristmill.streaming.fold import ProductState, fold_batches, fold_stream

FIELDS = ["product_image", "sku_upc", "product_name", "color", "msrp", "qty", "your_cost", "notes"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = make
    if sql:
        SQL[name] = sql


def _in(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any(test: str, words: list[str]) -> str:
    return f"len(list_filter({_in(words)}, lambda w: {test})) > 0"


_PRICE_SQL = r"CASE WHEN regexp_extract({0}, '(\d+(?:[.,]\d{{1,2}})?)', 1) <> '' THEN '$' || printf('%.2f', CAST(replace(regexp_extract({0}, '(\d+(?:[.,]\d{{1,2}})?)', 1), ',', '.') AS DOUBLE)) ELSE {0} END"
_TEXT_SQL = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_NORMAL = f"""r AS ({RAW_OFFERS}), n AS (SELECT ord, product_image, source, source_detail, category,
  CASE WHEN regexp_matches(trim(sku_upc), '^\\d+\\.0$') THEN replace(trim(sku_upc), '.0', '') WHEN regexp_matches(trim(sku_upc), '^\\$\\d{{4,}}') THEN 'S' || substr(trim(sku_upc), 2) ELSE trim(sku_upc) END AS sku_upc,
  {_TEXT_SQL.format('product_name')} AS product_name, {_TEXT_SQL.format('color')} AS color, {_TEXT_SQL.format('notes')} AS notes,
  {_PRICE_SQL.format('msrp')} AS msrp, {_PRICE_SQL.format('your_cost')} AS your_cost,
  CASE WHEN trim(qty) = '' THEN 'Catalog' ELSE regexp_replace(trim(qty), '^(\\d+)\\.0$', '\\1') END AS qty FROM r)"""
_TITLE = f"(len(list_filter(string_split(lower(product_name), '|'), lambda p: {_any('starts_with(trim(p), w)', lex.TITLE_OPENERS)} OR regexp_matches(p, 'recipe|cookbook|book'))) > 0 OR len(string_split(product_name, '|')) >= 3)"
_KEPT = f"""f AS (SELECT *, lower(product_name) AS low, sku_upc = '' AND msrp = '' AS bare FROM n), k AS (SELECT * EXCLUDE (low, bare) FROM f WHERE NOT (
  (product_name = '' AND sku_upc = '') OR (bare AND (length(product_name) < 5 OR product_name LIKE '%)' OR product_name LIKE '%-'))
  OR {_any('contains(low, w)', lex.PROMO_PHRASES + lex.NON_PRODUCT_PHRASES)} OR list_contains({_in(lex.NON_PRODUCT_NAMES)}, low)
  OR (bare AND (contains(product_name, '|') OR {_any('suffix(low, w)', lex.SITE_ENDINGS)}) AND {_TITLE})
  OR (bare AND your_cost = '' AND product_image = '' AND len(string_split(product_name, ' ')) <= 2 AND NOT regexp_matches(product_name, '\\d'))))"""
_SCORE = "(CASE WHEN product_image <> '' THEN 3 ELSE 0 END + CASE WHEN sku_upc <> '' THEN 2 ELSE 0 END + CASE WHEN product_name <> '' THEN 2 ELSE 0 END + (color <> '')::INT + (msrp <> '')::INT + (your_cost <> '')::INT + (qty <> '')::INT + (notes <> '')::INT)"
_MERGE = "first(ord ORDER BY s DESC, ord) AS ord, first(notes ORDER BY s DESC, ord) AS notes, " + ", ".join(f"coalesce(first({c} ORDER BY s DESC, ord) FILTER (WHERE {c} <> ''), '') AS {c}" for c in op.MERGED)
_SKU = f"a AS (SELECT {_MERGE} FROM (SELECT *, {_SCORE} AS s, lower(sku_upc) || '|' || lower(color) AS key FROM k WHERE sku_upc <> '') GROUP BY key)"
_NAME = f"b AS (SELECT {_MERGE} FROM (SELECT *, {_SCORE} AS s, lower(product_name) || CASE WHEN color <> '' THEN '|' || lower(color) ELSE '' END AS key FROM k WHERE sku_upc = '' AND product_name <> '') GROUP BY key)"
_LIST = ", ".join(["ord", *FIELDS])
_PHANTOM = "p AS (SELECT *, {s} AS s, lower(trim(product_name)) AS nm FROM {t})"


def _phantom(source: str) -> str:
    names = "u AS (SELECT nm, max(s) AS top FROM p WHERE nm <> '' GROUP BY nm), x AS (SELECT a.nm, max(b.top) AS top FROM u a JOIN u b ON starts_with(b.nm, a.nm) AND length(b.nm) > length(a.nm) GROUP BY a.nm)"
    return f"{_PHANTOM.format(s=_SCORE, t=source)}, {names} SELECT {_LIST} FROM p WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.nm = p.nm AND x.top >= p.s)"


_normal = lambda s, d: op.normalize(raw_offers(s, d))
_kept = lambda s, d: op.filter_non_products(_normal(s, d))
_add("normalize_products", lambda s, d: _normal(s, d).select("ord", *FIELDS), f"WITH {_NORMAL} SELECT {_LIST} FROM n")
_add("filter_non_products", lambda s, d: _kept(s, d).select("ord", *FIELDS), f"WITH {_NORMAL}, {_KEPT} SELECT {_LIST} FROM k")
_add("dedupe_sku_color", lambda s, d: op.dedupe_by_sku(_kept(s, d)).select("ord", *FIELDS), f"WITH {_NORMAL}, {_KEPT}, {_SKU} SELECT {_LIST} FROM a")
_add("dedupe_name", lambda s, d: op.dedupe_by_name(_kept(s, d)).select("ord", *FIELDS), f"WITH {_NORMAL}, {_KEPT}, {_NAME} SELECT {_LIST} FROM b UNION ALL SELECT {_LIST} FROM k WHERE sku_upc = '' AND product_name = ''")
_add("phantom_removal", lambda s, d: op.remove_phantoms(_normal(s, d)).select("ord", *FIELDS), f"WITH {_NORMAL}, {_phantom('n')}")
_add("clean_dedupe_pipeline", lambda s, d: op.clean(raw_offers(s, d)).select("ord", *FIELDS), f"WITH {_NORMAL}, {_KEPT}, {_SKU}, {_NAME}, c AS (SELECT {_LIST} FROM a UNION ALL SELECT {_LIST} FROM b UNION ALL SELECT {_LIST} FROM k WHERE sku_upc = '' AND product_name = ''), {_phantom('c')}")
_HELD = f"{_LIST}, '' AS source, '' AS source_detail, '' AS category"


def _folded(batches: int) -> str:
    state = ""
    for k in range(batches):
        batch = f"SELECT {_HELD} FROM ({RAW_OFFERS}) AS o WHERE ord % {batches} = {k}"
        state = SQL["clean_dedupe_pipeline"].replace(RAW_OFFERS, batch + (f" UNION ALL SELECT {_HELD} FROM ({state}) AS s" if state else ""))
    return state


_add("incremental_fold", lambda s, d: fold_batches([raw_offers(s, d).filter(F.col("ord") % 3 == k) for k in range(3)], state_folder(s)).select("ord", *FIELDS), _folded(3))


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """The offers as a stream of three files, folded in two calls."""
    offers, folder = raw_offers(s, d), state_folder(s)
    for k in range(3):
        offers.filter(F.col("ord") % 3 == k).coalesce(1).write.mode("append").parquet(f"{folder}/offers")
        if k:
            fold_stream(s.readStream.schema(offers.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/offers"), folder).awaitTermination()
    return ProductState(s, f"{folder}/state").products(", ".join(f"`{c}` {t}" for c, t in offers.dtypes)).select("ord", *FIELDS)


_add("stream_fold", _streamed, _folded(3))
_add("catalog_stats", lambda s, d: op.stats(raw_offers(s, d)), f"WITH r AS ({RAW_OFFERS}) SELECT count(*) AS n_rows, count(*) FILTER (WHERE product_name <> '' OR sku_upc <> '') AS n_named, count(*) FILTER (WHERE product_image <> '') AS n_images FROM r")
_add("export_projection", lambda s, d: raw_offers(s, d).select("ord", *(F.col(c).alias(n) for c, n in lex.EXPORT_NAMES.items())), f"WITH r AS ({RAW_OFFERS}) SELECT ord, " + ", ".join(f'{c} AS "{n}"' for c, n in lex.EXPORT_NAMES.items()) + " FROM r")
_add("sheet_split", lambda s, d: op.sheets(raw_offers(s, d)), f"WITH r AS ({RAW_OFFERS}) SELECT substr(category, 1, 31) AS sheet, count(*) AS n_rows, min(ord) AS first_ord FROM r GROUP BY 1")
_add("data_score_histogram", lambda s, d: raw_offers(s, d).groupBy(op.data_score().cast("bigint").alias("score")).agg(F.count("*").alias("n")), f"WITH r AS ({RAW_OFFERS}) SELECT CAST({_SCORE} AS BIGINT) AS score, count(*) AS n FROM r GROUP BY 1")
_SHEET_PRICES = "CASE o_orderkey % 4 WHEN 0 THEN 'USD ' || format_number(o_totalprice, 2) WHEN 1 THEN cast(o_orderkey AS string) || ' EUR' WHEN 2 THEN 'v1.' || cast(o_orderkey AS string) || '.2' ELSE 'call us' END"
_add("price_sheet_clean", lambda s, d: table(s, d, "orders").select("o_orderkey", fn.sheet_price(F.expr(_SHEET_PRICES)).alias("price")), "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '$' || printf('%.2f', CAST(printf('%.2f', o_totalprice) AS DOUBLE)) WHEN 1 THEN '$' || o_orderkey || '.00' WHEN 2 THEN 'v1.' || o_orderkey || '.2' ELSE 'call us' END AS price FROM orders")
_SHEET_SKUS = "CASE p_partkey % 6 WHEN 0 THEN '00' || cast(p_partkey AS string) || '.0' WHEN 1 THEN '00' || cast(p_partkey AS string) || 'A' WHEN 2 THEN '000' || cast(1000000000000000 + p_partkey AS string) WHEN 3 THEN cast(p_partkey AS string) || '.50' WHEN 4 THEN cast(p_partkey AS string) || 'e2' ELSE '' END"
_add("sku_sheet_clean", lambda s, d: table(s, d, "part").select("p_partkey", fn.sheet_sku(F.expr(_SHEET_SKUS)).alias("sku")), "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN '00' || p_partkey || 'A' WHEN 2 THEN (1000000000000000 + p_partkey)::VARCHAR WHEN 3 THEN p_partkey || '.50' WHEN 4 THEN (p_partkey * 100)::VARCHAR ELSE '' END AS sku FROM part")
_SKUS = "CASE ord % 8 WHEN 0 THEN sku_upc WHEN 1 THEN 'Display' || cast(ord AS string) WHEN 2 THEN repeat('x', 51) WHEN 3 THEN 'a b c d e' || cast(ord AS string) WHEN 4 THEN '€' || cast(ord AS string) || '00' WHEN 5 THEN 'ab' WHEN 6 THEN '  A_b-1.' || cast(ord AS string) || ' ' ELSE '-x' || cast(ord AS string) END"
_add("sku_validate", lambda s, d: raw_offers(s, d).select("ord", fn.valid_sku(F.expr(_SKUS)).alias("sku")), f"WITH r AS ({RAW_OFFERS}) SELECT ord, CASE WHEN ord % 8 = 6 THEN 'A_b-1.' || ord WHEN ord % 8 = 0 AND regexp_matches(sku_upc, '^[A-Za-z0-9][A-Za-z0-9_.\\-]{{2,29}}$') THEN sku_upc ELSE '' END AS sku FROM r")
_add("qty_parse", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", fn.qty_in_text(F.concat(F.lit("stock "), F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "K now").otherwise(" pcs"))).alias("qty")), "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN format('{:,}', CAST(l_quantity AS INT) * 1000) ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS qty FROM lineitem")
_WEB_PRICES = "CASE o_orderkey % 7 WHEN 0 THEN 'now $' || format_number(o_totalprice, 2) || ' each' WHEN 1 THEN format_number(o_totalprice, 2) WHEN 2 THEN '£12.50 was ' || cast(o_orderkey AS string) WHEN 3 THEN 'sold out' WHEN 4 THEN 'from $3 lot ' || cast(10000 + o_orderkey AS string) WHEN 5 THEN 'about ' || cast(10000 + o_orderkey AS string) || ' or so' ELSE '' END"
_add("price_web_normalize", lambda s, d: table(s, d, "orders").select("o_orderkey", fn.web_price(F.expr(_WEB_PRICES)).alias("price")), "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '$' || format('{:,.2f}', o_totalprice) WHEN 1 THEN '$' || format('{:,.2f}', o_totalprice) WHEN 2 THEN '$12.50' WHEN 4 THEN '$' || format('{:,}', 10000 + o_orderkey) || '.00' WHEN 5 THEN '$' || substr((10000 + o_orderkey)::VARCHAR, 1, 3) || '.00' ELSE '' END AS price FROM orders")
_BEST_PRICES = "CASE o_orderkey % 5 WHEN 0 THEN 'Sale $12.50 Regular Price: $' || format_number(o_totalprice, 2) WHEN 1 THEN 'msrp ' || cast(10000 + o_orderkey AS string) WHEN 2 THEN 'now €45.20 only' WHEN 3 THEN 'price: $5 lot ' || cast(10000 + o_orderkey AS string) ELSE 'nothing' END"
_add("price_best", lambda s, d: table(s, d, "orders").select("o_orderkey", fn.best_price(F.expr(_BEST_PRICES)).alias("price")), "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '$' || format('{:,.2f}', o_totalprice) WHEN 1 THEN '$' || substr((10000 + o_orderkey)::VARCHAR, 1, 3) || '.00' WHEN 2 THEN '$45.20' WHEN 3 THEN '$' || format('{:,}', 10000 + o_orderkey) || '.00' ELSE '' END AS price FROM orders")
_add("product_indicators", lambda s, d: table(s, d, "documents").select("doc_id", fn.product_indicators(F.col("text")).alias("hit")), r"SELECT doc_id, regexp_matches(text, '\$\s*\d|[A-Z]\d{4,}|(?i:msrp)|\b\d+\s*[Kk]\b|\b\d+\s*(?i:ea)\b') AS hit FROM documents")
_add("url_product_test", lambda s, d: table(s, d, "pages").select("page_id", fn.product_url(F.col("url")).alias("product"), fn.non_product_url(F.col("url")).alias("other"), fn.non_product_path(F.col("url")).alias("barred")), f"SELECT page_id, regexp_matches(url, '(?i){lex.PDP_URL}') AS product, regexp_matches(url, '(?i){lex.NON_PRODUCT_URL}') AS other, list_has_any(string_split(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)), '/'), {_in(lex.NON_PRODUCT_SEGMENTS)}) AS barred FROM pages")
_add("cache_key", lambda s, d: table(s, d, "pages").select("page_id", fn.cache_file(F.col("url")).alias("file")), r"SELECT page_id, md5(url) || coalesce(nullif(regexp_extract(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '(?i)[^/](\.(?:jpg|jpeg|png|gif|webp|avif|svg))$', 1), ''), '.jpg') AS file FROM pages")
_FILES = "CASE p_partkey % 9 WHEN 0 THEN '/a.PNG?x=b.gif' WHEN 1 THEN '/a.webp#b.gif' WHEN 2 THEN '/a.jpeg;v=1' WHEN 3 THEN '/a.svg/' WHEN 4 THEN '/.png' WHEN 5 THEN '/a.gif.' WHEN 6 THEN '/b.gif/a.exe' WHEN 7 THEN '' ELSE '/a.b.avif' END"
_add("cache_key_images", lambda s, d: table(s, d, "part").select("p_partkey", fn.cache_file(F.expr(f"'https://i.example.png' || {_FILES}")).alias("file")), f"SELECT p_partkey, md5('https://i.example.png' || {_FILES}) || CASE p_partkey % 9 WHEN 0 THEN '.PNG' WHEN 1 THEN '.webp' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.svg' WHEN 8 THEN '.avif' ELSE '.jpg' END AS file FROM part")
_add("page_classify_url", lambda s, d: table(s, d, "pages").select("page_id", fn.page_type(F.col("url")).alias("page_type")), r"SELECT page_id, CASE WHEN regexp_matches(lower(url), '(/search\?|/search/|\?q=|&q=|/find\?)') THEN 'search' WHEN regexp_matches(lower(url), '/(blog|article|editorial|guide|inspiration|about|contact|faq|press)/') THEN 'editorial' WHEN regexp_matches(lower(url), '^https?://[^/]+/?$') THEN 'homepage' WHEN regexp_matches(lower(url), '(/category/|/collection[s]?/|/catalog/|/c/|/shop/)') THEN 'category' ELSE 'unknown' END AS page_type FROM pages")
_LINKS = """WITH h AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) AS root, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT DISTINCT page_id, root || regexp_replace(href, '#.*$', '') AS link FROM h WHERE href LIKE '/%' AND href NOT LIKE '//%' AND regexp_matches(regexp_extract(href, '^([^?#]*)', 1), '(?i){0}') AND NOT list_has_any(string_split(lower(regexp_extract(href, '^([^?#]*)', 1)), '/'), {1})"""
_add("page_links", lambda s, d: op.page_links(table(s, d, "pages"), "^/[a-z]"), _LINKS.format("^/[a-z]", _in(lex.NON_PRODUCT_SEGMENTS)))
_add("collection_links", lambda s, d: op.page_links(table(s, d, "pages"), lex.COLLECTION_LINK), _LINKS.format(lex.COLLECTION_LINK, _in(lex.NON_PRODUCT_SEGMENTS)))
_SUM = " + ".join(f"contains(low, '{p}')::INT" for p in lex.MERCH_PHRASES)
_TS = rf"""(CASE WHEN len(ws) < 2 THEN -2e-1 WHEN len(ws) > 12 THEN -18e-2 ELSE 0e0 END + CASE WHEN regexp_matches(t, '[.!?]$') THEN -1e-1 ELSE 0e0 END + CASE WHEN regexp_matches(t, '(?i){lex.CONNECTORS}') THEN -22e-2 ELSE 0e0 END
 + CASE WHEN list_contains({_in(lex.SENTENCE_OPENERS)}, ws[1]) THEN -18e-2 ELSE 0e0 END + least({_SUM}, 3) * -1e-1 + CASE WHEN regexp_matches(low, '\bwith\b.{{5,}}') AND len(ws) > 5 THEN -1e-1 ELSE 0e0 END
 + CASE WHEN {_any('contains(low, w)', lex.PRODUCT_NOUNS)} THEN 1e-1 ELSE 0e0 END + CASE WHEN regexp_matches(t, '^([A-Z][a-z]*[\s\-]?)+$') AND len(ws) BETWEEN 2 AND 8 THEN 5e-2 ELSE 0e0 END + CASE WHEN regexp_matches(t, '\b[A-Z]{{1,4}}\d{{2,}}|\b\d{{4,}}\b') THEN 1e-1 ELSE 0e0 END)"""
_add("title_score", lambda s, d: _normal(s, d).select("ord", F.round(op.title_score(F.col("product_name")), 9).alias("delta")), f"WITH {_NORMAL}, t AS (SELECT ord, product_name AS t, lower(product_name) AS low, string_split(lower(product_name), ' ') AS ws FROM n) SELECT ord, round({_TS}, 9) AS delta FROM t")
_PS = f"""WITH {_NORMAL}, t AS (SELECT *, product_name AS t, lower(product_name) AS low, string_split(lower(product_name), ' ') AS ws, coalesce(TRY_CAST(regexp_replace(msrp, '[^\\d.]', '', 'g') AS DOUBLE), 0) > 0 AS price FROM n),
q AS (SELECT ord, 5e-1 + (CASE WHEN length(sku_upc) >= 3 THEN 2e-1 ELSE 0e0 END) + (CASE WHEN price THEN 15e-2 ELSE 0e0 END) + (CASE WHEN starts_with(product_image, 'http') THEN 5e-2 ELSE 0e0 END) + (CASE WHEN color <> '' THEN 5e-2 ELSE 0e0 END) + {_TS} + (CASE WHEN sku_upc = '' THEN -8e-2 ELSE 0e0 END) + (CASE WHEN NOT price AND sku_upc = '' THEN -8e-2 ELSE 0e0 END) + (CASE WHEN product_image = '' THEN -5e-2 ELSE 0e0 END) AS x FROM t),
z AS (SELECT ord, round(greatest(0e0, least(1e0, x)), 9) AS score FROM q)"""
_BUCKET = "CASE WHEN score >= 65e-2 THEN 'confirmed' WHEN score >= 4e-1 THEN 'likely' WHEN score >= 15e-2 THEN 'uncertain' ELSE 'suppressed' END"


def _scored(s: SparkSession, d: str) -> DataFrame:
    score = F.round(op.product_score(F.lit(""), F.lit("unknown")), 9)
    return _normal(s, d).select("ord", score.alias("score"), "product_name", "source", "source_detail").withColumn("bucket", op.bucket(F.col("score")))


_add("product_score_bucket", lambda s, d: _scored(s, d).select("ord", "score", "bucket"), f"{_PS} SELECT ord, score, {_BUCKET} AS bucket FROM z")
_add("bucket_counts", lambda s, d: _scored(s, d).groupBy("bucket").agg(F.count("*").alias("n")), f"{_PS} SELECT {_BUCKET} AS bucket, count(*) AS n FROM z GROUP BY 1")
_NAMES = "p_name || CASE WHEN p_partkey % 3 = 0 THEN ' - ' || 'Navy Blue' WHEN p_partkey % 3 = 1 THEN ' (OFF white/2)' ELSE '' END"
_add("color_from_name", lambda s, d: table(s, d, "part").select("p_partkey", fn.color_in_name(F.expr(_NAMES)).alias("color")), "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Navy Blue' WHEN p_partkey % 3 = 1 THEN 'Off White/2' ELSE '' END AS color FROM part")
_add("looks_like_color", lambda s, d: table(s, d, "part").select("p_partkey", fn.looks_like_color(F.expr("case when p_partkey % 2 = 0 then p_name else cast(p_size as string) || ' oz' end")).alias("hit")), "SELECT p_partkey, p_partkey % 2 = 0 AND length(p_name) < 30 AS hit FROM part")

for _more in (web, catalog, layout, sites, sheetfiles):
    QUERIES |= _more.QUERIES
    SQL |= _more.SQL

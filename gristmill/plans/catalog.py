"""Queries over catalog text and sheets rendered from parts, whose SQL projects what was rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import lexicon as lex
from gristmill.operators import catalog as cat
from gristmill.sources import sheets
from gristmill.sources.tables import RAW_OFFERS, raw_offers, spread, table

QUERIES, SQL = {}, {}


def _add(name: str, make, sql: str) -> None:
    QUERIES[name], SQL[name] = make, sql


# colours: words of part names, against the known ones, in both engines
def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


_TITLE = r"array_to_string(list_transform(regexp_extract_all({0}, '\p{{L}}+|\P{{L}}+'), lambda w: upper(w[1]) || w[2:]), '')"
_FUZZY = f"""d AS (SELECT DISTINCT low, list_contains({_list(lex.KNOWN_COLORS)}, low) AS known, length(low) < 3 OR len(list_filter(string_split(low, ' '), lambda w: NOT list_contains({_list(lex.NOT_COLORS)}, w))) = 0 AS barred FROM w),
n AS (SELECT low, arg_min(k, (levenshtein(k, low), -length(k), k)) AS near FROM d, (SELECT unnest({_list(lex.KNOWN_COLORS)}) AS k) WHERE abs(length(k) - length(low)) <= greatest(length(k), length(low)) * 0.4 AND levenshtein(k, low) <= greatest(2, length(k) // 3) GROUP BY low),
f AS (SELECT d.low, CASE WHEN barred THEN '' WHEN known THEN {_TITLE.format('d.low')} ELSE coalesce({_TITLE.format('near')}, '') END AS color FROM d LEFT JOIN n USING (low))"""
_add("color_fuzzy", lambda s, d: cat.with_colors(table(s, d, "part").select("p_partkey", F.posexplode(F.split(F.lower("p_name"), " ")).alias("i", "low")), "low").drop("low"),
     f"WITH t AS (SELECT p_partkey, generate_subscripts(string_split(lower(p_name), ' '), 1) - 1 AS i, unnest(string_split(lower(p_name), ' ')) AS low FROM part), w AS (SELECT low FROM t), {_FUZZY} SELECT p_partkey, i, color FROM t JOIN f USING (low)")
_add("color_words", lambda s, d: cat.with_colors(table(s, d, "documents").select("doc_id", F.regexp_extract(F.lower("text"), "([a-z]{3,8})", 1).alias("low")), "low").drop("low"),
     f"WITH t AS (SELECT doc_id, regexp_extract(lower(text), '([a-z]{{3,8}})', 1) AS low FROM documents), w AS (SELECT low FROM t), {_FUZZY} SELECT doc_id, color FROM t JOIN f USING (low)")
_SCAN = "CASE p_partkey % 6 WHEN 0 THEN 'FAnGUE C/O COTOPAXI BLACK C/O' WHEN 1 THEN 'TERRA noo (DEEP SEA) C/O 12K' WHEN 2 THEN 'Menerai' WHEN 3 THEN 'cotoran bak' WHEN 4 THEN 'wholesale pack' ELSE 'Midnihgt, ' || 'red' END"
_add("color_line", lambda s, d: cat.with_line_colors(table(s, d, "part").select("p_partkey", F.expr(_SCAN).alias("line")), "line").select("p_partkey", F.array_join(cat.distinct_colors(F.col("colors")), ";").alias("colors")), "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Fatigue;Cotopaxi Black' WHEN 1 THEN 'Terra;Deep Sea' WHEN 2 THEN 'Mineral' WHEN 3 THEN 'Cotopaxi Black' WHEN 4 THEN '' ELSE 'Red' END AS colors FROM part")
_NAMED = "p_name || CASE p_partkey % 4 WHEN 0 THEN ' - Del Dia 2' WHEN 1 THEN ' – Navvy' WHEN 2 THEN ' (Spruse)' ELSE ' del dia' END"
_add("color_catalog_name", lambda s, d: cat.with_catalog_color(table(s, d, "part").select("p_partkey", F.expr(_NAMED).alias("name")), "name").drop("name"), "SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'Navy' WHEN 2 THEN 'Spruce' ELSE 'Del Dia' END AS color FROM part")
_add("scan_cleanup", lambda s, d: table(s, d, "part").select("p_partkey", cat.clean_scan(F.expr("'a®b  \t c * d ' || p_name || '  ™ e, f'")).alias("t")), "SELECT p_partkey, 'ab c  d ' || p_name || ' e, f' AS t FROM part")

# catalog pages of five kinds: two products; one product in two colours; names and prices; a table; blocks
_PAGE = """SELECT 'c.pdf' AS filename, p_partkey AS page_num, CASE p_partkey % 5
  WHEN 0 THEN 'NAVY\nS' || id || ' ' || p_name || ' | MSRP $20.00\n300 ea\nTEAL C/O\nS1' || id || ' Other ' || p_name || ' $35\n2K'
  WHEN 1 THEN 'FATIGUE C/O TERRA C/O\nS' || id || ' ' || p_name || ' - MSRP $20.50\n12 ea'
  WHEN 2 THEN 'Trail Mug $18.00\nlater Big Cup - Olive $7'
  WHEN 3 THEN 'catalog\n\nSKU\tProduct\tWholesale\tPrice\tQty\n' || id || '\t' || p_name || '\t4\t9.50\t1500\nalone\nX1\tSecond\t5'
  ELSE 'SKU: ' || id || '\nName: ' || p_name || '\nQty: 2K\n\nshort\n\nSome ' || lower(p_name) || ' thing\nfrom 10 to 20 ea\nprice: 9\nColour: Red' END AS text
FROM (SELECT *, lpad(cast(p_partkey AS string), 6, '0') AS id FROM {part})"""
_ID = "(SELECT *, lpad(cast(p_partkey AS string), 6, '0') AS id FROM part)"


def _pages(s: SparkSession, d: str) -> DataFrame:
    return s.sql(_PAGE, part=spread(table(s, d, "part")))


def _rows(*cases: tuple[int, int, int, dict[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT 'c.pdf' AS filename, p_partkey AS page_num, {strategy} AS strategy, {pos} AS pos, " + ", ".join(f"{values.get(c, chr(39) * 2)} AS {c}" for c in cat.FIELDS) + f" FROM {_ID} WHERE p_partkey % 5 = {k}" for k, strategy, pos, values in cases)


_add("catalog_cascade", lambda s, d: cat.catalog_products(_pages(s, d)), _rows(
    (0, 1, 0, {"sku_upc": "'S' || id", "product_name": "p_name", "color": "'Navy'", "msrp": "'$20.00'", "qty": "'300'"}),
    (0, 1, 1000, {"sku_upc": "'S1' || id", "product_name": "'Other ' || p_name", "color": "'Teal'", "msrp": "'$35'", "qty": "'2,000'"}),
    (1, 1, 0, {"sku_upc": "'S' || id", "product_name": "p_name", "color": "'Fatigue'", "msrp": "'$20.50'", "qty": "'12'"}),
    (1, 1, 1, {"sku_upc": "'S' || id", "product_name": "p_name", "color": "'Terra'", "msrp": "'$20.50'", "qty": "'12'"}),
    (2, 2, 0, {"product_name": "'Trail Mug'", "msrp": "'$18.00'"}),
    (2, 2, 1, {"product_name": "'Big Cup - Olive'", "color": "'Olive'", "msrp": "'$7'"}),
    (3, 3, 0, {"sku_upc": "id", "product_name": "p_name", "your_cost": "'4'", "msrp": "'9.50'", "qty": "'1,500'"}),
    (3, 3, 2, {"sku_upc": "'X1'", "product_name": "'Second'", "your_cost": "'5'"}),
    (4, 4, 0, {"sku_upc": "id", "product_name": "p_name", "qty": "'2,000'"}),
    (4, 4, 2, {"product_name": "'Some ' || lower(p_name) || ' thing'", "msrp": "'9'", "qty": "'20'", "color": "'Red'"}),
))

# edited grids
def _grid(s: SparkSession, d: str) -> DataFrame:
    return raw_offers(s, d).select("ord", *(F.nullif(F.col(c), F.lit("")).alias(n) for c, n in lex.EXPORT_NAMES.items()))


_LIST = ", ".join(lex.EXPORT_NAMES)
_add("grid_read_back", lambda s, d: sheets.read_back(_grid(s, d)), f"WITH r AS ({RAW_OFFERS}) SELECT {_LIST}, 'manual' AS source, '' AS source_detail, CAST(1 AS DOUBLE) AS confidence FROM r")
_add("trace_view", lambda s, d: sheets.trace(raw_offers(s, d).withColumn("confidence", F.col("ord") % 101 / 100)), f"WITH r AS ({RAW_OFFERS}) SELECT ord + 1 AS \"Row\", substr(product_name, 1, 40) AS \"Product\", source AS \"Source\", source_detail AS \"Detail\", (ord % 101)::VARCHAR || '%' AS \"Confidence\" FROM r")
_add("image_link", lambda s, d: table(s, d, "part").select("p_partkey", F.expr("CASE p_partkey % 3 WHEN 0 THEN 'abc12.png' WHEN 1 THEN 'a b.png' ELSE 'http://x/abcde.jpg' END").alias("x")).select("p_partkey", sheets.image_link("x").alias("image")), "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'https://m.media-amazon.com/images/I/abc12.png' WHEN 1 THEN 'a b.png' ELSE 'http://x/abcde.jpg' END AS image FROM part")


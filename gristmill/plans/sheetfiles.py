"""Queries over sheets rendered from parts: many at once, files of two encodings, workbooks, and the layout of an export."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import lexicon as lex
from gristmill.sources import sheets
from gristmill.sources.tables import RAW_OFFERS, raw_offers, spread, state_folder, table

QUERIES, SQL = {}, {}


def _add(name: str, make, sql: str) -> None:
    QUERIES[name], SQL[name] = make, sql


_OUT = ["sku_upc", "product_name", "msrp", "product_image", "notes", "source_detail"]
# one sheet whose header stands in its second row of data
_SHEET = """SELECT 's' AS sheet, 0L AS row, array('a', 'b', 'c', 'e', 'f') AS values UNION ALL
SELECT 's' AS sheet, p_partkey + 1 AS row, CASE WHEN p_partkey = 1 THEN array(' Style # ', 'Product Name', NULL, 'Retail Price USD', 'Photo') WHEN p_partkey % 7 = 0 THEN array(NULL, NULL, NULL) ELSE array(
  CASE WHEN p_partkey % 2 = 0 THEN '00' || cast(p_partkey AS string) ELSE 'A-' || cast(p_partkey AS string) END, ' ' || p_name || ' ', NULL, 'USD ' || cast(p_size AS string), CASE WHEN p_partkey % 3 = 0 THEN '71abc+DE.jpg' END) END AS values FROM {part}"""
_add("sheet_import", lambda s, d: sheets.sheet_products(s.sql(_SHEET, part=table(s, d, "part"))).select((F.col("row") - 1).alias("ord"), *_OUT), "SELECT p_partkey AS ord, CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR ELSE 'A-' || p_partkey END AS sku_upc, p_name AS product_name, '$' || p_size || '.00' AS msrp, CASE WHEN p_partkey % 3 = 0 THEN 'https://m.media-amazon.com/images/I/71abc+DE.jpg' ELSE '' END AS product_image, '' AS notes, 'row ' || (1 + row_number() OVER (ORDER BY p_partkey)) AS source_detail FROM part WHERE p_partkey > 1 AND p_partkey % 7 > 0")

#: A sheet of 20 parts each, of four shapes: header at the top and an empty row; a promoted header below an empty row; columns in another order with an empty one; header at the top that no alias fits but one.
_MANY = """
WITH p AS (SELECT *, p_partkey DIV 20 AS n, p_partkey % 20 AS j, cast(p_partkey AS string) AS id FROM {part}),
h AS (SELECT DISTINCT n FROM p)
SELECT cast(n AS string) AS sheet, 0L AS row, CASE n % 4 WHEN 0 THEN array('SKU', 'Name', 'Price ', 'Qty', 'Description') WHEN 1 THEN array('x', 'y', NULL) WHEN 2 THEN array('Colour', NULL, ' ITEM NO', 'Wholesale Price', 'Item') ELSE array('zzz', 'Title') END AS values FROM h
UNION ALL SELECT cast(n AS string), 1L, array(NULL, NULL, NULL) FROM h WHERE n % 4 = 1
UNION ALL SELECT cast(n AS string), 2L, array('MSRP', 'Barcode', 'Product title', NULL) FROM h WHERE n % 4 = 1
UNION ALL SELECT cast(n AS string), j + CASE WHEN n % 4 = 1 THEN 3L ELSE 1L END, CASE
  WHEN j = 5 THEN array(NULL, NULL, NULL, NULL) WHEN n % 4 = 0 THEN array('00' || id, p_name, '$1', '5', 'n' || id) WHEN n % 4 = 1 THEN array('2.5', id || '.0', p_name, CASE WHEN j = 0 THEN 'odd' END)
  WHEN n % 4 = 2 THEN array('Red', NULL, 'A' || id, '3', CASE WHEN j = 7 THEN NULL ELSE p_name END) ELSE array('z', p_name) END FROM p"""
_LINES = """SELECT CAST(p_partkey // 20 AS VARCHAR) AS sheet, CASE (p_partkey // 20) % 4 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN p_partkey::VARCHAR WHEN 2 THEN 'A' || p_partkey ELSE '' END AS sku_upc,
CASE WHEN (p_partkey // 20) % 4 = 2 AND j = 7 THEN '' ELSE p_name END AS product_name, CASE (p_partkey // 20) % 4 WHEN 2 THEN 'Red' ELSE '' END AS color, CASE (p_partkey // 20) % 4 WHEN 0 THEN '$1.00' WHEN 1 THEN '$2.50' ELSE '' END AS msrp,
CASE (p_partkey // 20) % 4 WHEN 2 THEN '$3.00' ELSE '' END AS your_cost, CASE (p_partkey // 20) % 4 WHEN 0 THEN '5' ELSE '' END AS qty, CASE (p_partkey // 20) % 4 WHEN 0 THEN 'n' || p_partkey ELSE '' END AS notes,
'row ' || CASE WHEN (p_partkey // 20) % 4 = 1 THEN row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) + 1 ELSE j + 2 END AS source_detail
FROM (SELECT *, p_partkey % 20 AS j FROM part WHERE p_partkey % 20 <> 5)"""
_FIELDS = ["sku_upc", "product_name", "color", "msrp", "your_cost", "qty", "notes"]
_many_rows = lambda s, d: s.sql(_MANY, part=table(s, d, "part"))
_add("sheet_many", lambda s, d: sheets.sheet_products(_many_rows(s, d)).select("sheet", *_FIELDS, "source_detail"), _LINES)

# names of columns that the parts give: a sheet a part, eleven columns in an order of its own
_HEADS = ["SKU", "Product Name", "Color", "MSRP", "Wholesale", "Qty", "Notes", "Style Number", "desc", "Main Image URL", "zzz"]
_WORDS = "array(" + ", ".join(f"'{h}'" for h in _HEADS) + ")"


def _headers(s: SparkSession, d: str) -> DataFrame:
    each = f"SELECT cast(p_partkey AS string) AS sheet, transform(sequence(0, {len(_HEADS) - 1}), i -> CASE WHEN i = p_size % {len(_HEADS)} THEN split_part(p_type, ' ', 1) ELSE {_WORDS}[(i * (1 + p_partkey % 10) + p_partkey) % {len(_HEADS)}] END) AS names FROM {{part}}"
    return s.sql(f"SELECT sheet, transform(names, (x, i) -> struct(i AS col, x AS name)) AS columns FROM ({each})", part=spread(table(s, d, "part")))


def _automap(s: SparkSession, d: str) -> DataFrame:
    mapped = _headers(s, d).withColumn("fields", sheets.field_columns(F.col("columns")))
    each = mapped.select("sheet", "fields", F.explode("columns").alias("c"))
    field = F.get(F.map_keys(F.map_filter("fields", lambda _, col: col == F.col("c.col"))), F.lit(0))
    return each.select("sheet", F.col("c.col").alias("col"), F.col("c.name").alias("name"), F.coalesce(field, F.lit("")).alias("field"))


_ALIASES = "[" + ", ".join(f"{{'f': '{f}', 'a': '{a}', 'i': {i}}}" for i, (f, a) in enumerate((f, a) for f, listed in lex.COLUMN_ALIASES.items() for a in listed)) + "]"
_add("column_automap", _automap, f"""
WITH RECURSIVE h AS (SELECT CAST(p_partkey AS VARCHAR) AS sheet, list_transform(range({len(_HEADS)}), lambda i: CASE WHEN i = p_size % {len(_HEADS)} THEN split_part(p_type, ' ', 1) ELSE {"[" + ", ".join(f"'{x}'" for x in _HEADS) + "]"}[1 + (i * (1 + p_partkey % 10) + p_partkey) % {len(_HEADS)}] END) AS names FROM part),
m AS (SELECT sheet, names, 0 AS n, []::VARCHAR[] AS used, '' AS field FROM h UNION ALL
  SELECT sheet, names, n + 1, list_append(used, b), b FROM (SELECT *, coalesce(list_sort(list_transform(list_filter({_ALIASES}, lambda x: NOT list_contains(used, x.f) AND (contains(lower(names[n + 1]), x.a) OR contains(x.a, lower(names[n + 1])))),
    lambda x: {{'s': CASE WHEN lower(names[n + 1]) = x.a THEN 100 WHEN contains(lower(names[n + 1]), x.a) THEN 80 ELSE 60 END, 'i': -x.i, 'f': x.f}}))[-1].f, '') AS b FROM m WHERE n < {len(_HEADS)}))
SELECT sheet, CAST(n - 1 AS INTEGER) AS col, names[n] AS name, field FROM m WHERE n > 0""")


def csv_scan(s: SparkSession, d: str) -> DataFrame:
    """Delimited files in one folder, a third of them in Latin-1, written from parts and read back."""
    folder = state_folder(s)
    rows = s.sql("""SELECT p_partkey % 12 AS file, p_partkey, 'SKU-' || lpad(cast(p_partkey AS string), 5, '0') AS `Item Number`, ' ' || p_name || ' "é", ü\\n2 ' AS `Product Name`, cast(p_retailprice AS string) AS `List Price`, CASE WHEN p_partkey % 2 = 0 THEN 'N/A' END AS Notes FROM {part}""", part=table(s, d, "part"))
    for encoding, some in (("ISO-8859-1", "file % 3 = 0"), ("UTF-8", "file % 3 > 0")):
        part = rows.filter(some).repartition("file").sortWithinPartitions("file", "p_partkey").drop("p_partkey")
        part.write.option("header", True).option("encoding", encoding).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).partitionBy("file").csv(f"{folder}/{encoding}")
    found = sheets.sheet_products(sheets.read_sheets(s, folder))
    return found.select(F.regexp_extract("sheet", r"/file=(\d+)/", 1).cast("bigint").alias("file"), *_FIELDS, "source_detail")


_add("csv_scan", csv_scan, """SELECT p_partkey % 12 AS file, 'SKU-' || lpad(p_partkey::VARCHAR, 5, '0') AS sku_upc, p_name || ' "é", ü' || chr(10) || '2' AS product_name, '' AS color, '$' || printf('%.2f', p_retailprice) AS msrp, '' AS your_cost, '' AS qty, '' AS notes,
'row ' || (1 + row_number() OVER (PARTITION BY p_partkey % 12 ORDER BY p_partkey)) AS source_detail FROM part""")

_XML = '<?xml version="1.0" encoding="UTF-8"?><{0} xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{1}</{0}>'


def workbook(rows: list[list]) -> bytes:
    """A workbook of one sheet: numbers as such, texts shared, None left out, rows that are empty too."""
    shared: dict[str, int] = {}

    def cell(r: int, c: int, v) -> str:
        place = f"{chr(65 + c)}{r + 1}"
        if isinstance(v, str):
            return f'<c r="{place}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>'
        return f'<c r="{place}"><v>{v}</v></c>'

    lines = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows) if row)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/worksheets/sheet1.xml", _XML.format("worksheet", f"<sheetData>{lines}</sheetData>"))
        book.writestr("xl/sharedStrings.xml", _XML.format("sst", "".join(f"<si><t xml:space=\"preserve\">{escape(t)}</t></si>" for t in shared)))
    return out.getvalue()


def _books(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for book in batch.to_pylist():
            rows = [["Style", "Name", "Price", "Qty"], *([p["id"], p["name"], p["price"], None] if p["id"] % 6 else [] for p in sorted(book["parts"], key=lambda p: p["id"]))]
            yield pa.RecordBatch.from_pylist([{"path": book["path"], "content": workbook(rows)}], pa.schema([("path", pa.string()), ("content", pa.binary())]))


def xlsx_scan(s: SparkSession, d: str) -> DataFrame:
    """Workbooks of fifty parts each, every sixth row left out, read as files are."""
    parts = table(s, d, "part").groupBy(F.expr("cast(p_partkey DIV 50 AS string)").alias("path")).agg(F.collect_list(F.struct(F.col("p_partkey").alias("id"), F.expr("p_name || ' & <co>'").alias("name"), F.col("p_retailprice").cast("double").alias("price"))).alias("parts"))
    found = sheets.sheet_products(sheets.xlsx_rows(parts.mapInArrow(_books, "path string, content binary")))
    return found.select("sheet", "sku_upc", "product_name", "msrp", "qty", "source_detail")


_add("xlsx_scan", xlsx_scan, "SELECT CAST(p_partkey // 50 AS VARCHAR) AS sheet, p_partkey::VARCHAR AS sku_upc, p_name || ' & <co>' AS product_name, '$' || printf('%.2f', p_retailprice) AS msrp, '' AS qty, 'row ' || (p_partkey % 50 + 2) AS source_detail FROM part WHERE p_partkey % 6 > 0")

#: Categories with a blank one, forbidden characters, and two that are equal when cut to 31 characters.
_CATEGORY = "CASE ord % 5 WHEN 0 THEN '' WHEN 1 THEN category WHEN 2 THEN 'Cook/Ware: [all] of the kitchen and more' WHEN 3 THEN 'cookware all of the kitchen and MORE yet' ELSE 'all products' END"


def sheet_cells(s: SparkSession, d: str) -> DataFrame:
    """The cells of a line sheet of all raw offers, by category."""
    return sheets.sheet_cells(raw_offers(s, d).withColumn("category", F.expr(_CATEGORY)), "Acme", "Line", "May 1", by_category=True)


_STYLES = " ".join(f"WHEN {i + 1} THEN '{x}'" for i, x in enumerate(sheets.STYLES.values()))
_VALUES = "[" + ", ".join(f"nullif({f}, '')" if f == "product_image" else f for f in sheets.STYLES) + "]"
_NAMES = "[" + ", ".join(f"'{lex.EXPORT_NAMES[f]}'" for f in sheets.STYLES) + "]"
_add("sheet_cells", sheet_cells, f"""
WITH r AS (SELECT * REPLACE (CASE WHEN ({_CATEGORY}) = '' THEN 'Uncategorized' ELSE {_CATEGORY} END AS category) FROM ({RAW_OFFERS})),
c AS (SELECT category, min(ord) AS low FROM r GROUP BY category),
n AS (SELECT NULL AS category, 0 AS k, 'All Products' AS safe UNION ALL SELECT category, row_number() OVER (ORDER BY low), substr(regexp_replace(category, '[\\\\/*?\\[\\]:]', '', 'g'), 1, 31) FROM c),
h AS (SELECT category, k + 1 AS place, safe || CASE WHEN row_number() OVER w > 1 THEN ((row_number() OVER w - 1) * 2)::VARCHAR ELSE '' END AS sheet FROM n WINDOW w AS (PARTITION BY lower(safe) ORDER BY k)),
a AS (SELECT NULL AS of, * FROM r UNION ALL SELECT category, * FROM r),
d AS (SELECT sheet, place, row_number() OVER (PARTITION BY of ORDER BY ord) AS nth, {_VALUES} AS v FROM a JOIN h ON a.of IS NOT DISTINCT FROM h.category),
e AS (SELECT sheet, place, 5 + nth AS row, nth, v, unnest(range(1, 9)) AS col FROM d)
SELECT sheet, place, row, CAST(col AS INTEGER) AS col, v[col] AS value, CASE col {_STYLES} END || CASE WHEN nth % 2 = 0 THEN ' alt' ELSE '' END AS style FROM e
UNION ALL SELECT sheet, place, row, 1, value, style FROM h CROSS JOIN (VALUES (1, 'Acme', 'title'), (2, 'Line', 'subtitle'), (3, 'Date: May 1', 'date')) AS t(row, value, style)
UNION ALL SELECT sheet, place, 5, CAST(col AS INTEGER), {_NAMES}[col], 'header' FROM h CROSS JOIN (SELECT unnest(range(1, 9)) AS col)""")

"""Product sheets: delimited files and workbooks of any columns, their headers, their columns' fields, and the products in them; sheets laid out for export."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import lexicon as lex
from gristmill.functions import scalar as fn
from gristmill.operators.products import sheet_name
from gristmill.sources.tables import written

FIELDS = list(lex.COLUMN_ALIASES)


# A sheet is rows (sheet, row, values): row counts from 0, the header's, in the sheet's own order; values are its cells as text, null where empty.

def _decoded(content: Column) -> Column:
    """The text of a file's bytes: UTF-8, else Latin-1, in which any bytes are a text."""
    utf8 = content.cast("string")
    return F.regexp_replace(F.when(F.is_valid_utf8(utf8), utf8).otherwise(F.decode(content, "ISO-8859-1")), "^\ufeff", "")


def _table(kind: str):
    """Turns (sheet, file) batches into (sheet, row, values) ones."""
    read = {"csv": csv_file, "xlsx": xlsx_file}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("sheet", pa.string()), ("row", pa.int64()), ("values", pa.list_(pa.string()))])
        for batch in batches:
            for name, file in zip(batch.column(0), batch.column(1)):
                rows = enumerate(read(file.as_py()))
                while some := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_pylist([{"sheet": name.as_py(), "row": n, "values": [None if v in lex.EMPTY_CELLS else v for v in values]} for n, values in some], schema)

    return run


def csv_file(text: str) -> Iterator[list[str]]:
    """Rows of delimited text; blank lines are no rows."""
    return (row for row in csv.reader(io.StringIO(text, newline="")) if row)


_SHEET_XML = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def xlsx_file(content: bytes) -> Iterator[list[str | None]]:
    """Rows of a workbook's first sheet, streamed from its zipped XML. A whole number is written without a fraction; an error is an empty cell; rows that the file leaves out are empty ones."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            for _, item in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
                if item.tag == _SHEET_XML + "si":
                    shared.append(_rich_text(item))
                    item.clear()
        at = 0
        for _, row in ElementTree.iterparse(book.open(_first_sheet(book))):
            if row.tag != _SHEET_XML + "row":
                continue
            n = int(row.get("r", at + 1)) - 1
            for _ in range(at, n):
                yield []
            at, values = n + 1, []
            for cell in row.iter(_SHEET_XML + "c"):
                place = _column(cell.get("r")) if cell.get("r") else len(values)
                values += [None] * (place - len(values)) + [_cell(cell, shared)]
            row.clear()
            yield values


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The part of the workbook's first sheet, by its relations; without them, the usual name."""
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    try:
        first = ElementTree.parse(book.open("xl/workbook.xml")).find(f"{_SHEET_XML}sheets/{_SHEET_XML}sheet").get(link)
        target = next(r.get("Target") for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot() if r.get("Id") == first)
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    except (KeyError, AttributeError, StopIteration):
        return "xl/worksheets/sheet1.xml"


def _rich_text(item) -> str:
    """All text of a string item but for its phonetic readings."""
    return "".join(t.text or "" for part in item if part.tag != _SHEET_XML + "rPh" for t in part.iter(_SHEET_XML + "t"))


def _column(reference: str) -> int:
    n = 0
    for letter in reference.rstrip("0123456789"):
        n = n * 26 + ord(letter.upper()) - 64
    return n - 1


def _cell(cell, shared: list[str]) -> str | None:
    kind, value = cell.get("t", "n"), cell.findtext(_SHEET_XML + "v")
    if kind == "inlineStr":
        return _rich_text(cell.find(_SHEET_XML + "is"))
    if value is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind == "n":
        number = float(value)
        return str(int(number)) if number == int(number) else repr(number)
    return value


def csv_rows(files: DataFrame) -> DataFrame:
    """Rows of delimited files (path, content), each decoded by its own bytes. Any number of files is one job; a file is read by one task."""
    return files.select(F.col("path").alias("sheet"), _decoded(F.col("content")).alias("text")).mapInArrow(_table("csv"), "sheet string, row bigint, values array<string>")


def xlsx_rows(files: DataFrame) -> DataFrame:
    """Rows of the first sheets of workbooks (path, content)."""
    return files.select(F.col("path").alias("sheet"), "content").mapInArrow(_table("xlsx"), "sheet string, row bigint, values array<string>")


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all .csv and .xlsx files of a folder and its folders, from any store that Spark reads."""
    files = lambda glob: spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")
    return csv_rows(files("*.[cC][sS][vV]")).union(xlsx_rows(files("*.[xX][lL][sS][xX]")))


def column_names(rows: DataFrame) -> DataFrame:
    """(sheet, columns array<struct<col, name>>, header): the columns of each sheet that hold anything, their names, and the row that names them.

    That is row 0, or the first row that holds anything if two of its cells hold a header word. A cell without a name there is "Unnamed: n", or nan in a promoted row."""
    data = rows.filter((F.col("row") > 0) & F.exists("values", lambda v: v.isNotNull()))
    held = data.select("sheet", F.explode(F.filter(F.transform("values", lambda v, i: F.when(v.isNotNull(), i)), lambda i: i.isNotNull())).alias("col")).distinct()
    held = held.groupBy("sheet").agg(F.array_sort(F.collect_list("col")).alias("cols"))
    first = data.groupBy("sheet").agg(F.min(F.struct("row", "values")).alias("first"))
    heads = rows.filter("row = 0").groupBy("sheet").agg(F.min("values").alias("head"))
    met = held.join(first, "sheet").join(heads, "sheet", "left")
    words = F.size(F.filter("first.values", lambda v: F.coalesce(F.lower(v).rlike("|".join(lex.HEADER_WORDS)), F.lit(False))))
    named = lambda i, names, none: F.coalesce(fn.strip(F.get(names, i)), none)
    promoted = F.transform("cols", lambda i: F.struct(i.alias("col"), named(i, F.col("first.values"), F.lit("nan")).alias("name")))
    plain = F.transform("cols", lambda i: F.struct(i.alias("col"), named(i, F.col("head"), F.concat(F.lit("Unnamed: "), i.cast("string"))).alias("name")))
    return met.select("sheet", F.when(words >= 2, promoted).otherwise(plain).alias("columns"), F.when(words >= 2, F.col("first.row")).otherwise(F.lit(0).cast("bigint")).alias("header"))


_ALIAS_END = "\0"  # no alias holds it


def _fits(name: Column) -> Column:
    """array<int>: how well a lower-case name fits each of FIELDS by its best alias: equal 100, contained in the name 80, holding the name 60, else null."""
    def fit(aliases: list[str]) -> Column:
        joined = F.lit(_ALIAS_END.join(["", *aliases, ""]))
        return F.when(name.isin(aliases), 100).when(fn.contains_any(name, aliases), 80).when(~F.contains(name, F.lit(_ALIAS_END)) & F.contains(joined, name), 60)

    return F.array(*(fit(aliases) for aliases in lex.COLUMN_ALIASES.values()))


def field_columns(columns: Column) -> Column:
    """map<field, col> of array<struct<col, name>>: each column in turn takes the field, of those left, that an alias fits best; the first of equal ones.

    Aliases are asked by field, once a column; the turns then compare one number a field."""
    fits = F.transform(columns, lambda c: F.struct(c["col"].alias("col"), fn.let(F.lower(fn.strip(c["name"])), _fits).alias("fits")))
    places = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(field).alias("field")) for i, field in enumerate(FIELDS)))

    def best(fits: Column, taken: Column) -> Column:
        left = F.filter(places, lambda p: F.get(fits, p["i"]).isNotNull() & ~F.map_contains_key(taken, p["field"]))
        return F.array_max(F.transform(left, lambda p: F.struct(F.get(fits, p["i"]).alias("fit"), (-p["i"]).alias("place"), p["field"].alias("field"))))["field"]

    def step(taken: Column, column: Column) -> Column:
        return fn.let(best(column["fits"], taken), lambda field: F.when(field.isNull(), taken).otherwise(F.map_concat(taken, F.create_map(field, column["col"]))))

    return F.aggregate(fits, F.create_map().cast("map<string,int>"), step)


def sheet_products(rows: DataFrame) -> DataFrame:
    """(sheet, row, fields…, source, source_detail): the products of any number of sheets of unlike columns, in one plan.

    Prices and SKUs are cleaned; rows without name, SKU and price go. source_detail counts as a reader of the file would: from 2 below the header at
    the top, empty rows included; below a promoted header from 2 on, over the rows that hold anything. A sheet without data has no products."""
    named = column_names(rows)
    named = named.select("sheet", "header", field_columns(F.col("columns")).alias("fields"))
    data = rows.filter((F.col("row") > 0) & F.exists("values", lambda v: v.isNotNull())).join(named, "sheet").filter(F.col("row") > F.col("header"))
    clean = {"msrp": fn.sheet_price, "your_cost": fn.sheet_price, "sku_upc": fn.sheet_sku}
    raw = data.select("sheet", "row", "header", *(F.coalesce(fn.strip(F.get("values", F.try_element_at("fields", F.lit(f)))), F.lit("")).alias(f) for f in FIELDS))
    moved = raw.filter("header > 0").select("sheet", "row", F.row_number().over(Window.partitionBy("sheet").orderBy("row")).alias("nth"))
    plain = raw.filter("header = 0").withColumn("nth", F.col("row"))
    numbered = plain.unionByName(raw.filter("header > 0").join(moved, ["sheet", "row"]))
    out = numbered.select("sheet", "row", *(clean.get(f, lambda x: x)(F.col(f)).alias(f) for f in FIELDS), F.lit("excel").alias("source"), F.concat(F.lit("row "), (F.col("nth") + 1).cast("string")).alias("source_detail"))
    return out.filter("product_name != '' or sku_upc != '' or msrp != ''").withColumn("product_image", image_link("product_image"))


def image_link(column: str):
    """A bare image file name becomes an address of the image host; all else stays."""
    x = fn.strip(F.col(column))
    return F.when(x.rlike(r"^[A-Za-z0-9+\-_]{5,}\.(jpg|jpeg|png|webp)$"), F.concat(F.lit("https://m.media-amazon.com/images/I/"), x)).otherwise(F.col(column))


def read_back(grid: DataFrame) -> DataFrame:
    """Products of an edited grid of the exported columns; where they came from is lost."""
    return grid.select(*(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).alias(c) for c, name in lex.EXPORT_NAMES.items()), F.lit("manual").alias("source"), F.lit("").alias("source_detail"), F.lit(1.0).alias("confidence"))


def trace(products: DataFrame, order: str = "ord") -> DataFrame:
    """Where each product came from. Rows are numbered by the order column, which tells them apart."""
    return numbered(products.withColumn("__all", F.lit(1)), ["__all"], order, "Row").select("Row", F.substring("product_name", 1, 40).alias("Product"), F.col("source").alias("Source"), F.col("source_detail").alias("Detail"), F.concat(F.bround(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%")).alias("Confidence"))


# ---- layout of an export

def numbered(df: DataFrame, keys: list[str], order: str, name: str = "nth") -> DataFrame:
    """df with consecutive numbers from 1 within keys, by order, which tells its rows apart.

    In two levels, so that no key's rows meet in one task: rows are dealt by ranges, counted within each range, and moved on by the counts of
    the ranges before, a row for each range and key."""
    ranged = written(df.repartitionByRange(*keys, order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.withColumn("__moved", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    moved = moved.select(*(F.col(k).alias(f"__of_{k}") for k in keys), F.col("__part").alias("__of"), "__moved")
    own = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(order))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys), F.col("__part") == F.col("__of"))
    met = ranged.withColumn("__own", own).join(moved, same).withColumn(name, F.col("__own") + F.col("__moved"))
    return met.select(*df.columns, name)


#: Of each exported field its style; every second product's cells are "alt" too.
STYLES = {"product_image": "center", "sku_upc": "left text", "product_name": "left", "color": "left", "msrp": "right", "qty": "center", "your_cost": "right", "notes": "left"}
HEADER_ROW = 5


def sheet_cells(products: DataFrame, brand: str, title: str, date: str, by_category: bool = False, order: str = "ord") -> DataFrame:
    """(sheet, place, row, col, value, style): the cells of a line sheet, or with by_category (if any product has one) of a sheet of all products and one a category.

    Rows and columns count from 1, as do sheets, by their first product. Above the header stand brand, title and date. A
    product without category is Uncategorized. Sheet names are cleaned and cut; one met again, whatever its case, gets 2, 4, … at its end. An empty
    text is an empty cell but in the image's column, where it is none."""
    grouped = by_category and not products.filter("category != ''").isEmpty()
    every = "All Products" if grouped else "Line Sheet"
    category = F.when(F.coalesce("category", F.lit("")) == "", "Uncategorized").otherwise(F.col("category"))
    first = products.select(F.lit(every).alias("name"), F.lit(None).cast("string").alias("category"), F.lit(0).cast("bigint").alias("first")).limit(1)
    if grouped:
        each = products.groupBy(category.alias("category")).agg(F.min(order).cast("bigint").alias("low"))
        each = numbered(each.withColumn("one", F.lit(1)), ["one"], "low", "first").select(F.col("category").alias("name"), "category", "first")
        first = first.union(each)
    safe = first.withColumn("safe", sheet_name(F.col("name")))
    again = F.row_number().over(Window.partitionBy(F.lower("safe")).orderBy("first")) - 1
    heads = safe.select("category", (F.col("first") + 1).alias("place"), F.concat("safe", F.when(again > 0, (again * 2).cast("string")).otherwise("")).alias("sheet"))
    heads = written(heads, "heads")
    rows = products.withColumn("category", F.lit(None).cast("string"))
    if grouped:
        rows = rows.union(products.withColumn("category", category).select(*rows.columns))
    rows = numbered(rows, ["category"], order).withColumnRenamed("category", "of").join(heads, F.col("of").eqNullSafe(F.col("category")))
    alt = F.when(F.col("nth") % 2 == 0, " alt").otherwise("")
    cells = F.array(*(F.struct(F.lit(i + 1).alias("col"), (F.nullif(F.col(f), F.lit("")) if f == "product_image" else F.coalesce(f, F.lit(""))).alias("value"), F.concat(F.lit(style), alt).alias("style")) for i, (f, style) in enumerate(STYLES.items())))
    data = rows.select("sheet", "place", (F.col("nth") + HEADER_ROW).cast("bigint").alias("row"), F.explode(cells).alias("c")).select("sheet", "place", "row", "c.*")
    top = [(1, 1, brand or "Brand Name", "title"), (2, 1, title, "subtitle"), (3, 1, f"Date: {date}", "date"), *((HEADER_ROW, i + 1, lex.EXPORT_NAMES[f], "header") for i, f in enumerate(STYLES))]
    top = F.array(*(F.struct(F.lit(r).cast("bigint").alias("row"), F.lit(c).alias("col"), F.lit(v).alias("value"), F.lit(x).alias("style")) for r, c, v, x in top))
    return heads.select("sheet", "place", F.explode(top).alias("c")).select("sheet", "place", "c.*").unionByName(data)

"""Files of sheets, as a reader meets them, and numbers in two levels."""

import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from gristmill.plans.sheetfiles import workbook
from gristmill.sources import sheets


def test_files_of_two_encodings_and_workbooks(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    text = 'Name,SKU,Price,Größe\r\n\r\n"Café, ""au"" lait",0012,"1,5",x\r\n,,,\r\nTee,7.0,,\r\n'
    for name, data in (("a.csv", text.encode()), ("b.CSV", text.encode("latin-1")), ("c.csv", b"\xef\xbb\xbf" + text.encode()), ("d.csv", b""), ("e.csv", b"Name,SKU\n")):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    with open(f"{folder}/f.xlsx", "wb") as f:
        f.write(workbook([["Name", "SKU", "Price"], [" Café ", 12, 1.5], [], ["Tee", "007", None]]))
    with zipfile.ZipFile(f"{folder}/g.xlsx", "w") as book:  # inline texts, truth values, errors, rich texts, cells without places, a sheet of another name
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        book.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="x" r:id="r9"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r9" Target="worksheets/other.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><r><t>Na</t></r><r><t>me</t></r><rPh><t>no</t></rPh></si></sst>")
        book.writestr("xl/worksheets/other.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>SKU</t></is></c><c t="str"><v>Notes</v></c></row><row r="4"><c r="A4" t="inlineStr"><is><t>Tee</t></is></c><c r="B4" t="e"><v>#N/A</v></c><c r="C4" t="b"><v>1</v></c><c r="AB4"><v>3</v></c></row></sheetData></worksheet>')
    read = sheets.read_sheets(spark, "file://" + folder)
    assert {(r["sheet"][-5], r["row"]): r["values"] for r in read.collect() if r["sheet"].endswith("b.CSV")} == {("b", 0): ["Name", "SKU", "Price", "Größe"], ("b", 1): ['Café, "au" lait', "0012", "1,5", "x"], ("b", 2): [None] * 4, ("b", 3): ["Tee", "7.0", None, None]}
    out = sorted((r["sheet"].rsplit("/", 1)[1], r["product_name"], r["sku_upc"], r["msrp"], r["notes"], r["source_detail"]) for r in sheets.sheet_products(read).collect())
    each = [("Café, \"au\" lait", "12", "$15.00", "", "row 2"), ("Tee", "7", "", "", "row 4")]
    assert out == sorted([(f, *x) for f in ("a.csv", "b.CSV", "c.csv") for x in each] + [("f.xlsx", "Café", "12", "$1.50", "", "row 2"), ("f.xlsx", "Tee", "7", "", "", "row 4"), ("g.xlsx", "Tee", "", "", "True", "row 4")])


def test_columns_take_fields_in_turn(spark):
    names = ["Description", "Item", "description", "", "Price", "Retail", "xyz"]
    df = spark.createDataFrame([([(i, n) for i, n in enumerate(names)],)], "columns array<struct<col: int, name: string>>")
    assert df.select(sheets.field_columns(F.col("columns"))).first()[0] == {"product_name": 0, "sku_upc": 1, "notes": 2, "product_image": 3, "msrp": 4}


@pytest.mark.parametrize("rows", [0, 1, 1000])
def test_numbered(spark, rows):
    df = spark.range(rows).select((F.col("id") * 7919 % 1009).alias("o"), F.when(F.col("id") % 3 > 0, "hot").alias("k"))
    out = sheets.numbered(df.repartition(5), ["k"], "o").collect()
    for k in ("hot", None):
        mine = sorted((r["o"], r["nth"]) for r in out if r["k"] == k)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
    assert len(out) == rows

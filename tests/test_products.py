"""The product layer: scalar rules by example, and every registered query against its SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from gristmill.functions import scalar as fn
from gristmill.plans import registry

DATA = "/root/testdata/sf0.001"
CASES = [
    (fn.normalize_price, "$1,579.99", "$1.57"), (fn.normalize_price, "free", "free"), (fn.normalize_price, "899.9", "$899.90"),
    (fn.sheet_price, "USD 1,579.99", "$1579.99"), (fn.sheet_price, "1.2.3", "1.2.3"), (fn.sheet_price, "", ""),
    (fn.web_price, "$1579.99", "$157.00"), (fn.web_price, "1579.99", "$1,579.99"), (fn.web_price, "-5", "$5.00"), (fn.web_price, "none", ""), (fn.web_price, "$5.00 style 12345", "$12,345.00"),
    (fn.best_price, "Sale $5.00 MSRP: $25.50", "$25.50"), (fn.clean_sku, "$12345", "S12345"), (fn.clean_sku, "123.0", "123"),
    (fn.sheet_sku, "00123", "123"), (fn.sheet_sku, "1e5", "100000"), (fn.sheet_sku, "A-1", "A-1"), (fn.sheet_sku, "00001234567890123456", "1234567890123456"), (fn.sheet_sku, "12345678901234567890123", "12345678901234567741440"), (fn.sheet_sku, "-7.0", "-7"), (fn.sheet_sku, "1.5", "1.5"), (fn.sheet_sku, "1e300", "1e300"), (fn.valid_sku, "regular price", ""), (fn.valid_sku, "AB-12.3", "AB-12.3"), (fn.valid_sku, "a", ""),
    (fn.qty_value, "1.5K", "1,500"), (fn.qty_value, "QTY: 1200", "1,200"), (fn.qty_value, "many", "many"), (fn.qty_in_text, "about 300 pcs", "300"),
    (fn.title_case, "white/BLACK o'neil (2-tone)", "White/Black O'Neil (2-Tone)"), (fn.color_in_name, "Mug - Navy Blue", "Navy Blue"), (fn.color_in_name, "Mug", ""),
    (fn.clean_text, " a \t b ", "a b"), (fn.cache_file, "https://x.example.com/p/a.Gif?b", "0d4fd53ea7c77372922a62bf35b9c37b.Gif"), (fn.cache_file, None, None),
]


def test_scalars(spark):
    for rule, given, expected in CASES:
        df = spark.createDataFrame([(given,)], "x string")
        assert df.select(rule(F.col("x"))).first()[0] == expected, (rule.__name__, given)


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.6g}" if isinstance(r[i], float) else repr(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in "part orders lineitem documents pages".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = con.execute(registry.SQL[name])
    columns, rows = [c[0] for c in found.description], found.fetchall()
    df = registry.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert norm(df.collect(), df.columns) == norm(rows, columns)

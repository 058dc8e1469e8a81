"""Colours by the index against trying each known colour."""

import random

from pyspark.sql import functions as F

from gristmill.functions import lexicon as lex
from gristmill.operators import catalog as cat


def test_index_equals_trying_each(spark):
    draw = random.Random(8)
    texts = [None, "", " ", "ab", "Navy ", "xx", "kaleidoscop", "kalaidoscpe", "blackk", "x" * 40, "cotopaxi blk", "12k 3", "new pack"]
    for _ in range(400):
        t = list(draw.choice(lex.KNOWN_COLORS))
        for _ in range(draw.randrange(5)):
            at = draw.randrange(len(t) + 1)
            t[at : at + draw.randrange(2)] = draw.choice(["", "e", " ", "q"])
        texts.append("".join(t).upper() if draw.random() < 0.3 else "".join(t))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = {r["i"]: r["c"] for r in df.select("i", cat.fuzzy_color(F.col("t")).alias("c")).collect()}
    assert {r["i"]: r["color"] for r in cat.with_colors(df, "t").collect()} == want
    assert sum(bool(c) for c in want.values()) > 200


def test_lines_by_the_index(spark):
    draw = random.Random(9)
    words = ["Midnihgt", "deep", "SEA", "red", "C/O", "terra", "noo", "wholesale", "12K", "crimsn fare", "blue spruse", "x", "(Teal)"]
    df = spark.createDataFrame([(i, " ".join(draw.choice(words) for _ in range(draw.randrange(7)))) for i in range(60)] + [(99, None), (98, "")], "i int, line string")
    want = {r["i"]: r["c"] for r in df.select("i", cat.line_colors(F.col("line")).alias("c")).collect()}
    assert {r["i"]: r["colors"] for r in cat.with_line_colors(df, "line").collect()} == want


def test_context_by_the_index(spark):
    draw = random.Random(10)
    words = ["Midnihgt", "deep", "SEA", "red", "C/O", "terra", "noo", "wholesale", "12K", "crimsn fare", "blue spruse", "\n", "Color: navvy, Teal|blak\n", "$20", "S12345", "(Teal)", "del dia"]
    near = lambda: " ".join(draw.choice(words) for _ in range(draw.randrange(14)))
    names = ["Mug - Del Dia 2", "Cup – Navvy", "Bag (Spruse)", "bag del dia", "Jar (Teal) - blak", "", "plain"]
    rows = [(i, near(), f"x S12345 {near()}", "S12345" if i % 3 else "none", draw.choice(names)) for i in range(60)] + [(98, None, None, None, None), (99, "", "", "", "")]
    df = spark.createDataFrame(rows, "i int, beside string, text string, sku string, name string")
    held = [F.col(c) for c in ("beside", "text", "sku", "name")]
    plain = df.select("i", cat.context_colors(*held).alias("colors"), cat.catalog_color(held[3]).alias("color"))
    asked = cat.with_nearest(df, F.concat(cat.context_texts(*held[:3]), cat.name_texts(held[3])))
    found = asked.select("i", cat.context_colors(*held, cat.by_map()).alias("colors"), cat.catalog_color(held[3], cat.by_map()).alias("color"))
    want = sorted(plain.collect())
    assert sorted(found.collect()) == want
    assert sum(bool(r["colors"]) for r in want) > 30 and {r["color"] for r in want} >= {"Del Dia", "Navy", "Spruce", "Black", ""}
    assert {r["i"]: r["color"] for r in cat.with_catalog_color(df, "name").collect()} == {r["i"]: r["color"] for r in want}


def test_pages_without_a_name(spark):
    df = spark.createDataFrame([(None, 1, "Trail Mug $18.00"), ("a.pdf", None, "Big Cup - Olive $7"), ("a.pdf", 2, None), ("a.pdf", 3, "")], "filename string, page_num int, text string")
    assert sorted((r["product_name"], r["color"], r["msrp"]) for r in cat.catalog_products(df).collect()) == [("Big Cup - Olive", "Olive", "$7"), ("Trail Mug", "", "$18.00")]

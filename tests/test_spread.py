"""Work that is heavy a row is dealt over all cores, and asks no more than it must."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gristmill.functions import lexicon as lex
from gristmill.functions import scalar as fn
from gristmill.operators import dom
from gristmill.operators import pages as pg
from gristmill.operators import products as op
from gristmill.plans import catalog, layout, sheetfiles, web
from gristmill.sources import sheets, tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("made", [sheetfiles._headers, layout.grid_pages, web.rendered, catalog._pages, tables.raw_offers], ids=lambda f: f.__name__)
def test_a_small_file_is_many_tasks(spark, made):
    assert made(spark, SF).rdd.getNumPartitions() >= 4


def test_columns_take_fields_as_one_by_one(spark):
    aliases = [(f, a) for f, listed in lex.COLUMN_ALIASES.items() for a in listed]

    def one_by_one(names):
        taken = {}
        for col, name in enumerate(names):
            low = (name or "").strip().lower()
            fits = [(100 if low == a else 80 if a in low else 60, -i, f) for i, (f, a) in enumerate(aliases) if name is not None and f not in taken and (a in low or low in a)]
            if fits:
                taken[max(fits)[2]] = col
        return taken

    rng = random.Random(7)
    words = [*(a for _, a in aliases), "", " ", "x", "e", "\0", "\0sku", "sku\0upc", "Ünit", "%", "price (usd)", None, "it", "c", "QTY ", "\n", "no\ntes"]
    sheets_ = [[rng.choice(words) if rng.random() < 0.7 else f"{rng.choice(words)} {rng.choice(words)}" for _ in range(rng.randint(0, 9))] for _ in range(400)]
    df = spark.createDataFrame([(n, [(i, x) for i, x in enumerate(s)]) for n, s in enumerate(sheets_)], "n int, columns array<struct<col: int, name: string>>")
    got = {r[0]: r[1] for r in df.select("n", sheets.field_columns(F.col("columns"))).collect()}
    assert got == {n: one_by_one(s) for n, s in enumerate(sheets_)}


def test_signs_are_held_by_all_that_selectors_find():
    signs = [w for w in pg.CARD_SIGN.split("|")]
    assert all(any(w in c for w in signs) for c in pg.CARDS)
    signs = ["price", "money", "sku", "product", "item", "model", "upc", "name", "title", "color", "<h2", "<h3", "<h4"]
    assert all(any(w in c.lower() for w in signs) for c in [*pg.SKUS, *pg.PRICES, *pg.NAMES, *pg.COLOR_MARK.split("|<")])


def test_signs_of_each_field_are_shown_by_all_tags_that_selectors_find():
    rng = random.Random(3)
    names = ["class", "itemprop", "id", "data-sku", "data-upc", "data-model", "data-price", "data-sale-price", "data-regular-price", "data-product", "data-product-id", "data-item-id", "data-product-handle", "data-product-listing"]
    words = ["price", "Price", "money", "sku", "Sku", "model", "name", "product-name", "ProductTitle", "item-title", "item-name", "product-card", "x ProductTile", "grid-product", "plp-item", "plp-x", "search-result-item", "product", "product-item-info", "style-number", "product-id", ""]
    groups = [(pg.SKUS, pg.SKU_SIGN), (pg.PRICES, pg.PRICE_SIGN), (pg.NAMES, pg.NAME_SIGN), (pg.CARDS, pg.CARD_TAG), (pg.CARDS, pg.CARD_SIGN), (pg._PATTERN_PRICES, pg._PATTERN_SIGN), (pg._PATTERN_SKUS, pg._PATTERN_SKU_SIGN)]
    found = [0] * len(groups)
    for _ in range(3000):
        tag = f"<{rng.choice(['div', 'li', 'h2', 'h4', 'span'])}" + "".join(f"{rng.choice(' \n')}{rng.choice(names)}{rng.choice(['=', ' = '])}{q}{rng.choice(words)} {rng.choice(words)}{q}" for q in rng.choices("'\"", k=rng.randint(0, 3))) + ">"
        for i, (selectors, sign) in enumerate(groups):
            if any(re.search(s, tag) for s in selectors):
                assert re.search(sign, tag), (tag, sign)
                found[i] += 1
    assert min(found) > 100


def test_only_pages_that_may_hold_cards_are_parsed(spark, monkeypatch):
    rng = random.Random(5)
    bits = ['<div class="product-card" data-sku="A12345">', "<li>", '<li class="product">', "</li>", "</div>", "<ul>", "</ul>", '<a href="/products/1">x</a>', "<IMG src=/a.jpg>", '<h3 class="title">Mug one</h3>', '<span class="price">$12.50</span>', "text of it", '<div class="grid__item">', '<p class="grid-product">', "<script>product Product plp-</script>"]
    grid = "<ul>" + "<li><img src=/b.jpg>Blue mug $5</li>" * 4 + "</ul>"
    cards = ['<div data-sku="B12345">Red mug</div>' * n for n in (2, 3)]
    html = [None, "", "<p>plain</p>", grid, grid.replace("img", "iMg"), *cards, *("".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(300))]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id int, html string").withColumn("url", F.lit("https://s.example.com/"))
    expected = pg.cards_to_products(dom.cards(dom.parse(pages), pg.CARD_SELECTORS)).drop("row").collect()
    parse, parsed = dom.parse, []
    monkeypatch.setattr(dom, "parse", lambda p: (parsed.append(p.select("page_id").collect()), parse(p))[1])
    assert sorted(pg.card_products(pages).drop("row").collect()) == sorted(expected)
    took = {r[0] for r in parsed[0]}
    assert {r["page_id"] for r in expected} <= took and not took & {0, 1, 2, 5} and {3, 4, 6} <= took and len({r["page_id"] for r in expected}) > 30


def test_offers_are_cleaned_once_and_not_in_the_task_that_reads_them(spark, monkeypatch):
    offers, plans = tables.raw_offers(spark, SF), []
    monkeypatch.setattr(op, "written", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), tables.written(df, name))[1])
    out = op.clean(offers)
    assert len(plans) == 1
    # what stands beneath the exchange only reads; the rest is read from the written table
    below = plans[0][plans[0].index("Repartition ") :]
    assert "p_partkey" in below and "rlike" not in below.lower() and "regexp" not in below
    assert "regexp_extract" not in out._jdf.queryExecution().optimizedPlan().toString()
    names = [(None,), ("",), ("Mug",), ("Privacy Policy",), ("Blue mug 12 oz",), (" FAQ ",)]
    rows = spark.createDataFrame([(i, *n, "", "", "", "") for i, n in enumerate(names)], "ord int, product_name string, sku_upc string, msrp string, your_cost string, product_image string")
    assert sorted(r["ord"] for r in op.filter_non_products(rows).collect()) == sorted(r["ord"] for r in rows.filter(~op.is_non_product(F.col("product_name"))).collect()) == [4]
    assert op.filter_non_products(rows).columns == rows.columns


def test_patterns_look_for_a_page_s_headings_once(spark):
    pages = spark.createDataFrame([(1, "https://s.example.com/a", '<title>T | S</title><h1>Mug</h1><p class="price">$5.00</p><img src=x.jpg>'), (2, "u", "<title>Only – s</title>"), (3, "u", "<h1> </h1><p class=price>$5</p>"), (4, "u", None)], "page_id int, url string, html string")
    out = pg.pattern_products(pages)
    assert sorted((r["page_id"], r["product_name"], r["msrp"], r["product_image"]) for r in out.collect()) == [(1, "Mug", "$5.00", "https://s.example.com/x.jpg"), (2, "Only", "", "")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("^<h1[") == 1


def test_nesting_of_a_batch(spark):
    import pyarrow as pa

    rng = random.Random(9)
    bits = ["<div>", "</div>", "<p>", "<LI>", "</li>", "<ul>", "</ul>", "text", "", "<br>", "<td>", "<tr>", "<table>", "</table>", "<script>a<b>c</script>", "<!-- x -->", "</x>", "<h1 a='b>c'>", "<"]
    made = [rng.choices(bits, k=rng.randint(0, 30)) for _ in range(300)] + [None, []]
    rng.shuffle(made)
    for batch in (pa.array(made, pa.list_(pa.string())), pa.array(made, pa.list_(pa.string())).slice(50, 200), pa.array([], pa.list_(pa.string())), pa.array([None], pa.list_(pa.string()))):
        expected = [[(n[0], *n[1:6], n[6]) for n in dom.nested(page or [])] for page in batch.to_pylist()]
        assert [[(n["name"], *(n[c] for c in ("open", "close", "depth", "parent", "last", "kids"))) for n in page] for page in dom.nest.func(batch).to_pylist()] == expected


def test_prices_and_urls_stand_once_in_their_plan(spark):
    row = spark.createDataFrame([("$1,579.99", "https://x.example.com/a/b", "../c")], "p string, b string, h string")
    out = row.select(fn.web_price(F.concat("p", F.lit(" "))).alias("price"), fn.absolute_url(F.col("b"), F.lower("h")).alias("url"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("concat(p#") == 1 and plan.count("lower(h#") == 1
    assert tuple(out.first()) == ("$1,579.99", "https://x.example.com/c")


def test_variants_of_a_shop_stay_in_their_product_s_row(spark):
    def feed(*variants):
        return '{"products":[{"title":"t","handle":"h","images":[],"variants":[' + ",".join(variants) + "]}]}"

    red, navy, none = '{"id":%d,"sku":"R","option1":"Red"}', '{"id":%d,"sku":"N","option2":"NAVY"}', '{"id":%s,"sku":"X","option1":"12 oz"}'
    json = feed(none % "7", red % 1, navy % 2, red % 3, none % "7", none % "8", none % "null", none % "null", "null")
    rows = spark.createDataFrame([(1, "https://a.example.com/x", json), (1, "https://a.example.com/x", feed()), (2, "https://a.example.com/", None)], "page_id bigint, url string, json string")
    out = pg.shop_products(rows)
    assert sorted((r["pos"], r["sku_upc"], r["color"]) for r in out.collect()) == [(0, "X", ""), (1, "R", "Red"), (2, "N", "NAVY"), (5, "X", ""), (6, "X", "")]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().replace("RoundRobinPartitioning", "")


def test_a_merge_asks_ranks_of_its_neighbours_only():
    from gristmill.llm.bpe import WordBpe, default_tokenizer_path

    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

    bpe = WordBpe(default_tokenizer_path())
    word = "abcdefghijklmnopqrstuvwxyz"
    # each letter joins what is held of those before it
    bpe.rank = Counted({(word[:i], word[i]): i for i in range(1, 26)})
    assert bpe.merge(tuple(word)) == (word,)
    assert bpe.rank.asked <= 3 * len(word)
    bpe.rank = Counted({("a", "a"): 0, ("aa", "a"): 1, ("a", "b"): 2})
    assert bpe.merge(tuple("aaaaab")) == ("aa", "aaa", "b")

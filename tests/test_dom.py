"""Pages as nested elements: broken markup, links by their card, repeated pages, deep framework data."""

import re

from pyspark.sql import functions as F

from gristmill.operators import dom
from gristmill.operators import pages as pg

SCHEMA = "page_id int, url string, html string"


def test_nesting_of_broken_markup():
    tokens = re.findall(r"<[^>]+>|[^<]+", "<div><p>a<p>b<ul><li>c<li>d<br></ul></span><table><tr><td>1<td>2<tr><td>3</table>e</div></div><i>f")
    found = [(n[0], n[3], n[4]) for n in dom.nested(tokens)]
    assert found == [("div", 0, -1), ("p", 1, 0), ("p", 1, 0), ("ul", 1, 0), ("li", 2, 3), ("li", 2, 3), ("br", 3, 5), ("table", 1, 0), ("tr", 2, 7), ("td", 3, 8), ("td", 3, 8), ("tr", 2, 7), ("td", 3, 11), ("i", 0, -1)]
    assert dom.nested([]) == [] and dom.nested(["</a>", "text"]) == []


def test_pages(spark):
    html = '<!-- <b> --><script>if (a<b) "<i>"</script><DIV title="a>b" class=x>T &lt; <b>u</b></DIV><'
    pages = spark.createDataFrame([(1, "https://s.example.com/", html), (2, "u", None), (3, "u", "")], SCHEMA)
    parsed = dom.parse(pages)
    assert {r["page_id"]: r["html"] for r in dom.html_of(parsed).collect()} == {1: html, 2: "", 3: ""}
    nodes = {r["page_id"]: [(n["name"], n["tag"]) for n in r["nodes"]] for r in parsed.collect()}
    assert nodes == {1: [("script", "<script>"), ("div", '<DIV title="a>b" class=x>'), ("b", "<b>")], 2: [], 3: []}
    text = parsed.filter("page_id = 1").select(dom.text_of(F.col("tokens"), F.get("nodes", F.lit(1)))).first()[0]
    assert text == "T <u"


def test_links_by_their_card(spark):
    html = """<div class="product-tile"><a href="/mugs/blue-mug">x</a></div><a href=/products/1#a>y</a><a href="/mugs/red-mug">z</a><div class=grid><p><a href=/abcdef>l</a><p>t</div>
      <div class="my grids"><a href="/mugs/green-mug">g</a></div><div class='x Collection'><a href='/mugs/pink-mug'>g</a></div><ul class='a collection'><li><a href='/five'>5</a><a href="/sixsix">6</a></ul>
      <div class="Card"><a href="/cardcard">c</a></div><div data-class="card"><a href="/datadata">c</a></div><div class="card"><a href="/about/us">c</a><a href="https://o.example.com/other">o</a><a>n</a></div>"""
    links = dom.product_links(dom.parse(spark.createDataFrame([(1, "https://s.example.com/", html)] * 2, SCHEMA)))
    assert sorted(r["link"].removeprefix("https://s.example.com") for r in links.collect()) == ["/abcdef", "/mugs/blue-mug", "/products/1", "/sixsix"]


def test_repeated_pages_and_deep_data(spark):
    page = '<html><head><meta property="og:title" content="Blue mug, Blue"></head><body></body></html>'
    deep = '{"name":"Deep mug","price":5}'
    for i in range(8):
        deep = f'{{"k{i}":[0,{deep}]}}' if i % 2 else f'{{"k{i}":{deep}}}'
    data = f'<script id="__NEXT_DATA__" type="application/json">{deep}</script>'
    too_deep = f'<script id="__NEXT_DATA__" type="application/json">[[[[[[[[[[[{{"name":"Lost mug","price":5}}]]]]]]]]]]]</script>'
    pages = spark.createDataFrame([(1, "https://s.example.com/products/a", page)] * 2 + [(1, "https://s.example.com/products/b", page), (2, "https://s.example.com/c", too_deep)], SCHEMA)
    assert sorted(r["page_url"][-1] for r in pg.page_products(pages).collect()) == ["a", "a", "b"]
    walked = pg.framework_products(spark.createDataFrame([(2, "u", data.replace("Deep", "Other")), (3, "u", too_deep)], SCHEMA), depth=12).collect()
    assert sorted(r["product_name"] for r in walked) == ["Lost mug", "Other mug"]
    assert pg.framework_products(spark.createDataFrame([(3, "u", too_deep)], SCHEMA)).count() == 0

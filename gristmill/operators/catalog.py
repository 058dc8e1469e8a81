"""Products out of catalog text: colours by edit distance, and four ways to read a page (filename, page_num, text), the first that finds rows wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import lexicon as lex
from gristmill.functions import scalar as fn
from gristmill.sources.tables import written

FIELDS = ["sku_upc", "product_name", "color", "msrp", "your_cost", "qty", "notes"]
_BY_LENGTH = sorted(lex.KNOWN_COLORS, key=lambda c: (-len(c), c))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(words: list[str]) -> Column:
    return F.split(F.lit("|".join(words)), r"\|")


def clean_scan(text: Column) -> Column:
    """Text without trademark signs, runs of blanks and lone punctuation."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[®©™]", ""), r"[ \t]+", " "), r"(?U)(?<=\s)[^\w\s$](?=\s)", "")


def corrected_color(text: Column) -> Column:
    """The colour that a known misreading stands for, also if only blanks differ; all else stays."""
    table = F.create_map(*(F.lit(x) for pair in lex.MISREAD_COLORS.items() for x in pair))
    joined = {}
    for key, value in lex.MISREAD_COLORS.items():
        joined.setdefault(key.replace(" ", ""), value)
    close = F.create_map(*(F.lit(x) for pair in joined.items() for x in pair))
    low = F.lower(fn.strip(text))
    brand = low.contains("cotop") & (low.contains("black") | low.contains("blk") | low.contains("blac")) | low.rlike("cotoran|cotopan|cotopam")
    return F.coalesce(F.try_element_at(table, low), F.try_element_at(close, F.replace(low, F.lit(" "), F.lit(""))), F.when(brand, "Cotopaxi Black").otherwise(text))


def _nearest_of_all(low: Column) -> Column:
    """The nearest known colour of a text, tried against each."""
    far = F.transform(_words(_BY_LENGTH), lambda k, i: F.struct(F.levenshtein(k, low).alias("d"), i.alias("i"), k.alias("k")))
    return F.array_min(F.filter(far, lambda x: _able(x["k"], low, x["d"])))["k"]


def _able(known: Column, low: Column, distance: Column) -> Column:
    """Whether a text may stand for a colour at that distance."""
    return (F.abs(F.length(known) - F.length(low)) <= F.greatest(F.length(known), F.length(low)) * 0.4) & (distance <= F.greatest(F.lit(2), F.floor(F.length(known) / 3)))


def _shortened(text: Column, most: int) -> Column:
    """A text and all that up to ``most`` deletions of a character leave of it."""
    one = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    more = lambda held: F.array_union(held, F.flatten(F.transform(F.filter(held, lambda x: x != ""), one)))
    return reduce(lambda held, _: fn.let(held, more), range(most), F.array(text))


def color_index(spark: SparkSession) -> DataFrame:
    """(most, variant, known, place): what deletions leave of each known colour, up to the distance at which a text still stands for it. Its size is that of the fixed list."""
    known = spark.createDataFrame([(c, i, max(2, len(c) // 3)) for i, c in enumerate(_BY_LENGTH)], "known string, place int, most int")
    parts = [known.filter(F.col("most") == n).select("most", F.explode(_shortened(F.col("known"), n)).alias("variant"), "known", "place") for n in sorted({max(2, len(c) // 3) for c in _BY_LENGTH})]
    return reduce(DataFrame.union, parts)


def nearest_colors(texts: DataFrame) -> DataFrame:
    """(low, near): the nearest known colour of each distinct text (low) that has one.

    Two texts within a distance share a text that deletions, no more than that, leave of both. So the texts' shortened forms
    meet the index by equality, and only pairs that meet are measured."""
    low = texts.select("low").distinct()
    index = color_index(texts.sparkSession)
    tried = []
    for n in sorted({max(2, len(c) // 3) for c in _BY_LENGTH}):
        sizes = [len(c) for c in _BY_LENGTH if max(2, len(c) // 3) == n]
        fit = low.filter(F.length("low").between(min(sizes) - n, max(sizes) + n))
        tried.append(fit.select("low", F.lit(n).alias("most"), F.explode(_shortened(F.col("low"), n)).alias("variant")))
    met = reduce(DataFrame.union, tried).join(index, ["most", "variant"]).select("low", "known", "place").distinct()
    measured = met.withColumn("d", F.levenshtein("known", "low")).filter(_able(F.col("known"), F.col("low"), F.col("d")))
    return measured.groupBy("low").agg(F.min(F.struct("d", "place", "known"))["known"].alias("near"))


def _asked(text: Column) -> Column:
    return F.lower(fn.strip(text))


def with_colors(rows: DataFrame, text: str, name: str = "color") -> DataFrame:
    """rows with the colour that a text is or resembles: fuzzy_color, but each distinct text is looked up once, in the index."""
    keyed = rows.withColumn("__low", _asked(F.col(text)))
    near = nearest_colors(keyed.select(F.col("__low").alias("low"))).select(F.col("low").alias("__known"), F.col("near").alias("__near"))
    met = keyed.join(near, F.col("__low") == F.col("__known"), "left")
    return met.withColumn(name, fuzzy_color(F.col("__low"), lambda _: F.col("__near"))).drop("__low", "__known", "__near")


def _line_tokens(line: Column) -> Column:
    """The parts of a line between carry-over marks."""
    clean = fn.clean_text(F.regexp_replace(line, "[®©™@(){}]", ""))
    return F.filter(F.transform(F.split(clean, lex.CARRY_OVER), fn.strip), lambda t: (F.length(t) >= 3) & ~t.rlike(r"^\d+[Kk]?\s*$"))


def line_texts(line: Column) -> Column:
    """All texts of a line that its colours may be asked of: its parts, their words, and pairs of these."""
    words = lambda t: F.split(t, r"\s+")
    pairs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    return F.array_distinct(F.flatten(F.transform(_line_tokens(line), lambda t: F.transform(F.concat(F.array(t), words(t), pairs(words(t))), _asked))))


def with_line_colors(rows: DataFrame, line: str, name: str = "colors") -> DataFrame:
    """rows with the colours of a line: line_colors, but each distinct text of all lines is looked up once, in the index."""
    lines = rows.select(F.col(line).alias("line")).distinct()
    each = lines.select("line", F.explode(line_texts(F.col("line"))).alias("low"))
    held = each.join(nearest_colors(each), "low").groupBy("line").agg(F.map_from_entries(F.collect_list(F.struct("low", "near"))).alias("near"))
    found = lines.join(held, "line", "left").withColumn("near", F.coalesce("near", F.create_map().cast("map<string,string>")))
    found = found.select(F.col("line").alias("__line"), line_colors(F.col("line"), lambda low: F.try_element_at(F.col("near"), low)).alias(name))
    return rows.join(found, F.col(line).eqNullSafe(F.col("__line"))).drop("__line")


def fuzzy_color(text: Column, nearest=_nearest_of_all) -> Column:
    """The known colour that a text is or resembles, in title case, else ''. Of equally near ones the longest, then the first by code point. nearest: finds the nearest one of a lower-case text."""
    def of(low: Column) -> Column:
        barred = _words(lex.NOT_COLORS)
        no = (F.length(low) < 3) | F.array_contains(barred, low) | F.forall(F.split(low, r"\s+"), lambda w: F.array_contains(barred, w)) | low.rlike(r"^\d+[Kk]?\s*\d*[Kk]?$")
        fixed = corrected_color(low)
        near = nearest(low)
        found = F.when(F.array_contains(_words(lex.KNOWN_COLORS), low), low).when(F.array_contains(_words(lex.KNOWN_COLORS), F.lower(fixed)), fixed).otherwise(near)
        return F.when(no, "").otherwise(F.coalesce(fn.title_case(found), F.lit("")))

    return _let(F.lower(fn.strip(text)), of)


def distinct_colors(colors: Column) -> Column:
    """Without repeats, whatever their case; the first of each stays, in order."""
    return _let(F.filter(colors, lambda c: fn.strip(c) != ""), lambda held: F.filter(held, lambda c, i: F.array_position(F.transform(held, lambda x: F.lower(fn.strip(x))), F.lower(fn.strip(c))) == i + 1))


def line_colors(line: Column, nearest=_nearest_of_all) -> Column:
    """Colours of a line: of each part between carry-over marks, or else of its words, pairs first."""
    def of_words(words: Column) -> Column:
        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("out"))

        def step(state: Column, at: Column) -> Column:
            pair = F.when(at["i"] + 1 < F.size(words), fuzzy_color(F.concat_ws(" ", F.get(words, at["i"]), F.get(words, at["i"] + 1)), nearest)).otherwise("")
            add = lambda found, n: F.struct((at["i"] + n).cast("int").alias("next"), F.when(found != "", F.concat(state["out"], F.array(found))).otherwise(state["out"]).alias("out"))
            single = _let(fuzzy_color(F.get(words, at["i"]), nearest), lambda one: add(one, 1))
            return F.when(at["i"] < state["next"], state).otherwise(_let(pair, lambda two: F.when(two != "", add(two, 2)).otherwise(single)))

        places = F.transform(words, lambda _, i: F.struct(i.alias("i")))
        return F.when(F.size(words) >= 2, F.aggregate(places, start, step)["out"]).otherwise(F.array().cast("array<string>"))

    def of_token(token: Column) -> Column:
        return _let(fuzzy_color(token, nearest), lambda whole: F.when(whole != "", F.array(whole)).otherwise(_let(F.split(token, r"\s+"), of_words)))

    return F.flatten(F.transform(_line_tokens(line), of_token))


def _context_lines(near: Column) -> Column:
    """The lines near a product that may name colours."""
    return F.filter(F.transform(F.split(clean_scan(near), "\n"), fn.strip), lambda x: (x != "") & ~x.rlike(r"^\$\d+|^[A-Z$]\d{4,}|^\d+[Kk]\s") & (F.length(x) <= 80))


def _labelled(text: Column, sku: Column) -> Column:
    """What a colour label lists after a product's SKU."""
    at = F.instr(text, sku)
    label = F.regexp_extract(F.when(at > 0, F.substring(text, at, F.lit(300))).otherwise(""), r"[Cc]olou?rs?\s*[:=]\s*(.+?)(?:\n|$)", 1)
    return F.split(label, r"[,/|]+")


def context_texts(near: Column, text: Column, sku: Column) -> Column:
    """All texts that context_colors may ask a colour of."""
    return F.concat(F.flatten(F.transform(_context_lines(near), line_texts)), F.transform(_labelled(text, sku), _asked))


def context_colors(near: Column, text: Column, sku: Column, name: Column, nearest=_nearest_of_all) -> Column:
    """Colours named in the lines near a product, after a colour label of its SKU, or by its name."""
    found = F.flatten(F.transform(_context_lines(near), lambda x: line_colors(x, nearest)))
    labelled = F.filter(F.transform(_labelled(text, sku), lambda x: fuzzy_color(x, nearest)), lambda c: c != "")
    both = F.concat(found, labelled)
    extra = F.lower(name).contains("del dia") & ~F.exists(both, lambda c: F.lower(c).contains("del dia"))
    return distinct_colors(F.concat(both, F.when(extra, F.array(F.lit("Del Dia"))).otherwise(F.array().cast("array<string>"))))


def _name_ends(name: Column) -> tuple[Column, Column]:
    """What follows a dash in a catalog name, and what stands in parentheses."""
    return fn.strip(F.regexp_extract(name, r"\s[-–]\s+(.+)$", 1)), fn.strip(F.regexp_extract(name, r"\(([^)]+)\)", 1))


def name_texts(name: Column) -> Column:
    """All texts that catalog_color may ask a colour of."""
    return F.transform(F.array(*_name_ends(name)), _asked)


def catalog_color(name: Column, nearest=_nearest_of_all) -> Column:
    """The colour in a catalog name: after a dash, in parentheses, or Del Dia anywhere."""
    tail, inner = _name_ends(name)
    dia = F.lower(name).contains("del dia")
    found = F.coalesce(F.when(F.lower(tail).contains("del dia"), "Del Dia"), F.nullif(fuzzy_color(tail, nearest), F.lit("")), F.nullif(fuzzy_color(inner, nearest), F.lit("")), F.when(dia, "Del Dia"))
    return F.coalesce(found, F.lit(""))


def with_nearest(rows: DataFrame, texts: Column, name: str = "near") -> DataFrame:
    """rows with a map from each of its texts to the known colour nearest to it, where one is near: each distinct text of all rows is looked up once, in the index.

    The rows are written first, so that they keep their numbers. Null texts have no colour."""
    held = written(rows.withColumns({"__row": F.monotonically_increasing_id(), "__texts": F.array_distinct(F.coalesce(texts, F.array().cast("array<string>")))}), "asked")
    each = held.select("__row", F.explode("__texts").alias("low"))
    found = each.join(nearest_colors(each), "low").groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("low", "near"))).alias(name))
    return held.join(found, "__row", "left").withColumn(name, F.coalesce(name, F.create_map().cast("map<string,string>"))).drop("__row", "__texts")


def by_map(name: str = "near"):
    """The nearest colour of a text as with_nearest holds it."""
    return lambda low: F.try_element_at(F.col(name), low)


def with_catalog_color(rows: DataFrame, name: str, color: str = "color") -> DataFrame:
    """rows with the colour in a catalog name: catalog_color, but each distinct text is looked up once, in the index."""
    return with_nearest(rows, name_texts(F.col(name)), "__near").withColumn(color, catalog_color(F.col(name), by_map("__near"))).drop("__near")


def page_quantities(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(\d+(?:\.\d+)?)\s*K\b|\b(\d[\d,]*)\s*ea\b"), 0), lambda q: fn.qty_value(fn.strip(q)))


def _out(rows: DataFrame, **values: Column) -> DataFrame:
    return rows.select("filename", "page_num", "pos", *(F.coalesce(values.get(c, F.lit("")), F.lit("")).alias(c) for c in FIELDS))


def sku_lines(pages: DataFrame) -> DataFrame:
    """Lines of SKU, name and price, with the colours around them: one row a colour on a page of one product, else one a line."""
    found = [F.regexp_extract_all("text", F.lit("(?U)" + lex.SKU_LINE), i) for i in (1, 2, 3)]
    rows = pages.withColumns({"skus": found[0], "names": F.transform(found[1], lambda n: fn.strip(F.regexp_replace(F.regexp_replace(fn.strip(n), r"\|+$", ""), "-+$", ""))), "prices": found[2], "gaps": F.split("text", "(?U)" + lex.SKU_LINE), "qtys": page_quantities(F.col("text"))}).filter(F.size("skus") > 0)
    bases = F.array_distinct(F.transform("names", lambda n: F.lower(fn.strip(F.regexp_replace(n, r"(?i)\s*[-–]\s*(Del\s+Dia|Del).*$", "")))))
    rows = rows.withColumn("multi", (F.size("skus") >= 2) & (F.size(bases) > 1))

    def sides(i: Column) -> Column:
        after = F.get("gaps", i + 1)
        return F.array(F.get("gaps", i), F.when(i + 1 < F.size("skus"), after).otherwise(F.substring(after, 1, 400)))

    def asked(sku: Column, i: Column) -> Column:
        return F.concat(F.flatten(F.transform(sides(i), lambda side: context_texts(side, F.col("text"), sku))), name_texts(F.get("names", i)))

    def around(sku: Column, i: Column) -> Column:
        return distinct_colors(F.flatten(F.transform(sides(i), lambda side: context_colors(side, F.col("text"), sku, F.get("names", i), by_map()))))

    rows = with_nearest(rows, F.flatten(F.transform("skus", asked))).withColumn("colors", F.transform("skus", around))
    rows = rows.withColumn("all", distinct_colors(F.flatten("colors"))).select("*", F.posexplode("skus").alias("i", "sku")).withColumn("name", F.get("names", F.col("i"))).filter(F.length("name") >= 3)
    own, named = F.get("colors", F.col("i")), catalog_color(F.col("name"), by_map())
    chosen = F.when(F.size(own) > 0, own).when(~F.col("multi") & (F.size("all") > 0), F.col("all")).otherwise(F.array(named))
    rows = rows.select("*", F.posexplode(F.when(F.col("multi"), F.slice(chosen, 1, 1)).otherwise(chosen)).alias("k", "shade")).withColumn("pos", F.col("i") * 1000 + F.col("k"))
    return _out(rows, sku_upc=F.col("sku"), product_name=F.col("name"), color=F.col("shade"), msrp=F.concat(F.lit("$"), F.get("prices", F.col("i"))), qty=F.get("qtys", F.col("i")))


def name_lines(pages: DataFrame) -> DataFrame:
    """Names followed by a price."""
    pairs = F.arrays_zip(*(F.regexp_extract_all("text", F.lit("(?U)" + lex.NAME_LINE), i).alias(c) for i, c in ((1, "n"), (2, "p"))))
    rows = pages.select("filename", "page_num", F.posexplode(pairs).alias("pos", "x")).withColumn("name", fn.clean_text(F.col("x.n")))
    rows = rows.filter((F.length("name") >= 4) & ~F.lower("name").rlike("^(?:fall ats|august ship|packs &)"))
    rows = with_catalog_color(rows, "name")
    return _out(rows, product_name=F.col("name"), color=F.col("color"), msrp=F.concat(F.lit("$"), F.col("x.p")))


def _kind(cell: Column, words: list[tuple[str, list[str]]]) -> Column:
    low = F.lower(fn.strip(cell))
    return reduce(lambda a, w: a.when(fn.contains_any(low, w[1]), w[0]), words[1:], F.when(fn.contains_any(low, words[0][1]), words[0][0]))


def header_score(line: Column) -> Column:
    return reduce(lambda a, b: a + b, (F.when(fn.contains_any(F.lower(line), w), 1).otherwise(0) for w in lex.HEADER_CLASSES))


def table_lines(pages: DataFrame) -> DataFrame:
    """Rows of a table whose header stands in the first ten lines."""
    lines = F.filter(F.transform(F.split("text", "\n"), fn.strip), lambda x: x != "")
    rows = pages.withColumn("lines", lines)
    heads = F.filter(F.transform(F.slice("lines", 1, 10), lambda x, i: F.struct(i.alias("i"), header_score(x).alias("score"))), lambda h: h["score"] >= 2)
    rows = rows.withColumn("head", F.get(heads, F.lit(0))["i"]).filter(F.col("head").isNotNull())
    cells = lambda line: F.split(line, r"\s{2,}|\t")
    rows = rows.withColumn("kinds", F.transform(cells(F.get("lines", F.col("head"))), lambda c: _kind(c, lex.TABLE_WORDS))).filter(F.size(F.filter("kinds", lambda x: x.isNotNull())) >= 2)
    rows = rows.select("filename", "page_num", "kinds", F.posexplode(F.slice("lines", F.col("head") + 2, F.size("lines"))).alias("pos", "line")).withColumn("cells", cells(F.col("line"))).filter(F.size("cells") >= 2)
    last = lambda c: F.coalesce(F.try_element_at(F.filter(F.transform("cells", lambda x, j: F.struct(F.get("kinds", j).alias("kind"), fn.strip(x).alias("v"))), lambda x: x["kind"] == c), F.lit(-1))["v"], F.lit(""))
    rows = rows.select("*", *(last(c).alias(c) for c in FIELDS)).filter("product_name != '' or sku_upc != ''")
    return _out(rows, **{c: F.col(c) for c in FIELDS if c != "qty"}, qty=F.when(F.col("qty") != "", fn.qty_value(F.col("qty"))))


def block_lines(pages: DataFrame) -> DataFrame:
    """Blocks of key: value lines; other lines give a first quantity, prices and name."""
    names = ["sku_upc", "product_name", "color", "your_cost", "msrp", "qty"]
    blocks = F.split("text", r"\n\s*\n|\n-{3,}\n|\n={3,}\n")
    rows = pages.withColumn("blocks", blocks).filter(F.size("blocks") >= 2).select("filename", "page_num", F.posexplode("blocks").alias("pos", "block")).filter(F.length(fn.strip(F.col("block"))) >= 10)
    lines = F.filter(F.transform(F.split(fn.strip(F.col("block")), "\n"), fn.strip), lambda x: x != "")

    def step(held: Column, line: Column) -> Column:
        pair = r"(?U)^([\w\s/]+?):\s*(.+)$"
        kind, value = _kind(F.regexp_extract(line, pair, 1), lex.BLOCK_WORDS), fn.strip(F.regexp_extract(line, pair, 2))
        keyed = F.struct(*(F.when(kind == c, fn.qty_value(value) if c == "qty" else value).otherwise(held[c]).alias(c) for c in names))
        prices = F.regexp_extract_all(line, F.lit(r"\$\s*(\d+(?:\.\d{2})?)"), 1)
        first = held["msrp"].isNull() & (F.size(prices) > 0)
        plain = {
            "sku_upc": held["sku_upc"], "color": held["color"],
            "qty": F.coalesce(held["qty"], F.nullif(fn.qty_in_text(line), F.lit(""))),
            "msrp": F.when(first, F.concat(F.lit("$"), F.get(prices, F.lit(0)))).otherwise(held["msrp"]),
            "your_cost": F.when(first & (F.size(prices) > 1) & held["your_cost"].isNull(), F.concat(F.lit("$"), F.get(prices, F.lit(1)))).otherwise(held["your_cost"]),
            "product_name": F.when(held["product_name"].isNull() & (F.length(line) > 5) & ~line.startswith("$"), line).otherwise(held["product_name"]),
        }
        return F.when(line.rlike(pair), keyed).otherwise(F.struct(*(plain[c].alias(c) for c in names)))

    start = F.struct(*(F.lit(None).cast("string").alias(c) for c in names))
    rows = rows.withColumn("d", F.aggregate(lines, start, step)).filter("coalesce(d.product_name, '') != '' or coalesce(d.sku_upc, '') != ''")
    return _out(rows, **{c: F.col(f"d.{c}") for c in names})


def catalog_products(pages: DataFrame) -> DataFrame:
    """(filename, page_num, strategy, pos, …): of each page the rows of the first way to read it that finds any. Pages of equal filename and page_num, nulls too, are one page."""
    every = reduce(DataFrame.unionByName, (f(pages).withColumn("strategy", F.lit(i + 1)) for i, f in enumerate((sku_lines, name_lines, table_lines, block_lines))))
    best = F.min("strategy").over(Window.partitionBy("filename", "page_num"))
    return every.withColumn("best", best).filter("strategy = best").select("filename", "page_num", "strategy", "pos", *FIELDS)

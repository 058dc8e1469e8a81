"""License scans by diagonal voting, in DataFrame functions only.

Every rolling k-gram of words is hashed and joined to the positions of the same k-gram in the templates (a short fixed
list, so that side is broadcast). A hit, whose words must be equal and not just their hash, votes for its
diagonal (place in the document minus place in the template); neighbouring diagonals, as a word put in
or left out makes them, are merged; and a merged span is verified by the share of the template's words
that equal k-grams cover. Only hits are shuffled, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import let, row_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases whose exact places are counted, with their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Notices of common licenses: family (only the best covered of a family counts in a document), label, words.
NOTICES = [
    ("mit", "mit", "released under the mit license"),
    ("mit", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "apache-2", "licensed under the apache license version 2 0"),
    ("apache", "apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("gpl", "gpl-3", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "gpl-2", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl", "lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("gpl", "agpl-3", "licensed under the gnu affero general public license version 3"),
    ("bsd", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc", "cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc", "cc-by", "licensed under cc by 4 0"),
    ("cc", "cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc", "cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc", "cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc", "cc-by", "licensed under a creative commons attribution 4 0 international license"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More template k-grams than this are refused, since the templates are broadcast.
MOST_GRAMS = 100_000
SPANS = "array<struct<start:bigint,end:bigint,covered:double,parts:int>>"


def license_words(text: Column) -> Column:
    """Words: runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased; null: none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def word_grams(words: Column, k: int) -> Column:
    """The text's rolling k-grams of words, each as its words joined by spaces."""
    def rolled(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(k))))

    return F.when(F.size(words) >= k, let(words, rolled)).otherwise(F.array().cast("array<string>"))


def verified(run: Column, n: Column, least: Column, k: int, shift: Column) -> Column:
    """Of a run of neighbouring diagonals (diagonal, at) the spans (start, end, covered) that cover ``least`` of a template's n words.

    The whole run is one span, if it is not much longer than the template. Else each diagonal is a span of its own,
    and if none of them is enough, all parts of the run whose diagonals are at most ``shift`` apart are tried; those of the fewest diagonals count.
    """
    def span(parts: Column) -> Column:
        places = F.flatten(F.transform(parts, lambda x: F.flatten(F.transform(x["at"], lambda p: F.sequence(p, p + (k - 1))))))
        start = F.array_min(F.transform(parts, lambda x: F.array_min(x["at"]) + x["diagonal"]))
        end = F.array_max(F.transform(parts, lambda x: F.array_max(x["at"]) + x["diagonal"])) + k
        return F.struct(start.alias("start"), end.alias("end"), (F.size(F.array_distinct(places)) / n).alias("covered"), F.size(parts).alias("parts"))

    def good(spans: Column) -> Column:
        return F.filter(spans, lambda s: (s["covered"] >= least) & ((s["end"] - s["start"]) * least <= n))

    def fewest(spans: Column) -> Column:
        return let(F.array_min(F.transform(spans, lambda s: s["parts"])), lambda m: F.filter(spans, lambda s: s["parts"] == m))

    def first(*choices: Column) -> Column:
        return choices[0] if len(choices) == 1 else let(good(choices[0]), lambda g: F.when(F.size(g) > 0, g).otherwise(first(*choices[1:])))

    def longer(x: Column, i: Column) -> Column:
        reach = F.size(F.filter(run, lambda y: (y["diagonal"] > x["diagonal"]) & (y["diagonal"] - x["diagonal"] <= shift)))
        return F.when(reach > 0, F.transform(F.sequence(F.lit(2), reach + 1), lambda m: span(F.slice(run, i + 1, m)))).otherwise(F.array().cast(SPANS))

    parts = F.filter(F.flatten(F.transform(run, longer)), lambda s: s["parts"] > 1)
    return first(F.array(span(run)), F.transform(run, lambda x: span(F.array(x))), let(good(parts), lambda g: F.when(F.size(g) > 0, fewest(g)).otherwise(g)))


def template_table(spark: SparkSession, base: list[tuple[str, str]], notices: list[tuple[str, str, str]], k: int) -> DataFrame:
    """(template, family, label, exact, n, t_pos, gram, hash) of each k-gram of each template."""
    if sum(len(x[-1].split()) for x in notices) + sum(len(x[0].split()) for x in base) > MOST_GRAMS:
        raise ValueError("too many template words to broadcast")
    if any(len(p.split()) < k for p in [b[0] for b in base] + [n[2] for n in notices]):
        raise ValueError(f"a template has fewer than {k} words")
    rows = [(i, p, label, True, p.split()) for i, (p, label) in enumerate(base)] + [(len(base) + i, family, label, False, p.split()) for i, (family, label, p) in enumerate(notices)]
    templates = spark.createDataFrame(rows, "template int, family string, label string, exact boolean, words array<string>")
    at = templates.select("template", "family", "label", "exact", F.size("words").alias("n"), F.posexplode(word_grams(F.col("words"), k)).alias("t_pos", "gram"))
    return at.withColumn("hash", F.xxhash64("gram"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: list[tuple[str, str]] = BASE, notices: list[tuple[str, str, str]] = NOTICES, k: int = 3, max_shift: int = 3, min_cover: float = 0.8) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts all places of the base phrases, first_word and last_word are the smallest and largest
    start of one. A notice is found where merged diagonals cover min_cover of its words; one diagonal follows another
    at max_shift words at most, or at as many as fit into a notice that is covered so: n / min_cover - n * min_cover of n words. labels joins base and notice labels; score is 1 if a base phrase stands
    there, else the largest share covered, else 0. Of a family of notices those covered best count, all
    of them at a tie; spans holds (label, start, end, covered) of all
    finds. A null or empty text has no words and finds nothing: null places, empty labels, score 0.
    Repeated rows and null ids are scanned each. Other columns of docs are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), row_key(F.col(id_col), F.col(text_col)).alias("key"))
    templates = template_table(docs.sparkSession, base, notices, k)
    # a row of a k-gram holds its k words and nothing else of the text, so a text twice as long costs twice as much
    grams = rows.select("id", "key", license_words(F.col("t")).alias("words")).select("id", "key", F.posexplode(word_grams(F.col("words"), k)).alias("pos", "gram"))
    hits = grams.withColumn("hash", F.xxhash64("gram")).join(F.broadcast(templates), ["hash", "gram"])
    votes = hits.select("id", "key", "template", "family", "label", "exact", "n", "t_pos", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
    by = ["id", "key", "template", "family", "label", "exact", "n"]
    lines = votes.groupBy(*by, "diagonal").agg(F.collect_set("t_pos").alias("at"))
    order = Window.partitionBy("id", "key", "template").orderBy("diagonal")
    shift = F.greatest(F.lit(max_shift), F.floor(F.col("n") / min_cover - F.col("n") * min_cover))
    # base phrases stand alone on their diagonals
    fresh = F.col("exact") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > shift, F.lit(True))
    lines = lines.withColumn("fresh", fresh.cast("int")).withColumn("group", F.sum("fresh").over(order))
    groups = lines.groupBy(*by, "group").agg(F.sort_array(F.collect_list(F.struct("diagonal", "at"))).alias("run"))
    found = groups.withColumn("span", F.explode(verified(F.col("run"), F.col("n"), F.when(F.col("exact"), 1.0).otherwise(min_cover), k, shift))).select(*by, "span.start", "span.end", "span.covered")
    best = F.max("covered").over(Window.partitionBy("id", "key", "family"))
    found = found.withColumn("best", best).filter("covered = best")
    start = F.when(F.col("exact"), F.col("start"))
    found = found.groupBy("id", "key").agg(
        F.sum(F.col("exact").cast("bigint")).alias("n_base"),
        F.min(start).cast("bigint").alias("first_word"),
        F.max(start).cast("bigint").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("covered").alias("score"),
        F.sort_array(F.collect_list(F.struct("start", "end", "label", "covered"))).alias("spans"),
    )
    counts = rows.select("id", "key", F.regexp_count(F.coalesce("t", F.lit("")), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("bigint").alias("n_words"))
    joined = counts.join(found.withColumnRenamed("id", "id_").withColumnRenamed("key", "key_"), (F.col("key") == F.col("key_")) & F.col("id").eqNullSafe(F.col("id_")), "left")
    empty = F.lit("")
    return joined.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0).cast("bigint")).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", empty).alias("base_labels"), F.coalesce("labels", empty).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans")

"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Every document's word n-grams (orders 1 to ``order``) fall into ``buckets`` hashed buckets. Two
multinomials over the buckets, one of trusted documents and one of all documents, give each bucket a
log ratio; a document's score is the mean log ratio of its n-grams (so its length is normalised away),
and every document is kept or not by one fixed threshold: no sampling, no random draw.

All steps are DataFrame functions. The bucket counts are pre-aggregated in each task and hold at most
``buckets`` rows whatever the input, and the table of ratios enters the scoring pass as one value of
``buckets`` doubles. Scoring is a narrow pass without a shuffle, so no document or n-gram can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import WS, let, materialize, unused, words_of

#: Fixed characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Trusted keys are broadcast up to this number, each of at most KEY_BYTES bytes: 64 MB of keys.
MOST_IDS, KEY_BYTES = 1_000_000, 64


def _bucket_at(hashes: Column, n: int, buckets: int):
    return lambda i: F.pmod(F.xxhash64(*(F.get(hashes, i + k) for k in range(n))), F.lit(buckets)).cast("int")


def gram_buckets(words: Column, order: int, buckets: int) -> Column:
    """Bucket numbers of all n-grams of orders 1 to order, as one array."""
    def of(hashes: Column) -> Column:
        grams = [F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))]
        for n in range(2, order + 1):
            starts = F.coalesce(F.when(F.size(hashes) >= n, F.sequence(F.lit(0), F.size(hashes) - n)), F.array().cast("array<int>"))
            grams.append(F.transform(starts, _bucket_at(hashes, n, buckets)))
        return F.concat(*grams)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def repeated_words(words: Column, window: int = 5) -> Column:
    """Number of words that stand in a window of ``window`` words found twice or more in the text, the first place included."""
    def spread(sorted_places: Column) -> Column:
        twice = F.filter(sorted_places, lambda x, i: (F.get(sorted_places, i - 1)["h"] == x["h"]) | (F.get(sorted_places, i + 1)["h"] == x["h"]))
        covered = lambda at: F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - p, F.lit(window)))), F.lit(0), lambda a, b: a + b)
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def count(hashes: Column) -> Column:
        places = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(places, spread))

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - window), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(window))))

    found = let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: let(windows(hashes), count))
    return F.when(F.size(words) >= window, found).otherwise(F.lit(0)).cast("bigint")


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed added.

    A null or empty text has no words and fails. Repeated rows are judged each. Columns of the added names are replaced, all others stay.
    """
    words = unused(docs, "__words")
    return _ruled(docs, text_col, words).drop(words)


def _ruled(docs: DataFrame, text_col: str, words: str) -> DataFrame:
    """base_rules with the text's words in a column of the name ``words``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    worded = F.filter(F.split(text, "\n"), lambda line: line.rlike(rf"[^{WS}]"))
    n_words, repeats = F.col("n_words"), F.col("n_repeat_words")
    return (
        docs.withColumn(words, words_of(F.col(text_col)))
        .withColumn("n_words", F.size(words).cast("bigint"))
        .withColumn("word_chars", F.length(F.regexp_replace(text, rf"[{WS}]+", "")).cast("bigint"))
        .withColumn("n_symbols", F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint"))
        .withColumn("n_dup_lines", let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
        .withColumn("n_repeat_words", repeated_words(F.col(words)))
        .withColumn("base_failed", (n_words < 10) | (repeats * 100 > n_words * 20))
    )


def bucket_counts(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, t, r): how often each bucket occurs in the trusted ones of texts (text, trusted) and in all of them; at most ``buckets`` rows."""
    grams = texts.select("trusted", F.explode(gram_buckets(words_of(F.col("text")), order, buckets)).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count_if("trusted").alias("t"), F.count("*").alias("r"))


def log_ratios(texts: DataFrame, order: int, buckets: int, smoothing: float) -> DataFrame:
    """One row with one array ``ratios`` of ``buckets`` doubles: ln of a bucket's share in the trusted texts over its share in all.

    Both shares are smoothed by ``smoothing`` counts a bucket, so that none is zero. The array is null if
    the trusted texts have no n-gram at all. Both multinomials are counted in one pass.
    """
    zero = F.lit(0).cast("bigint")
    every = texts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), zero.alias("t"), zero.alias("r"))
    by = bucket_counts(texts, order, buckets).unionByName(every).groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("r").alias("r"))
    one = by.agg(F.sort_array(F.collect_list(F.struct("bucket", "t", "r"))).alias("c"), F.sum("t").alias("ts"), F.sum("r").alias("rs"))
    share = lambda n, total: (n + F.lit(smoothing)) / (total + F.lit(smoothing * buckets))
    return one.select(F.when(F.col("ts") > 0, F.transform("c", lambda x: F.log(share(x["t"], F.col("ts")) / share(x["r"], F.col("rs"))))).alias("ratios"))


def flagged(docs: DataFrame, trusted: DataFrame, text_col: str, key: str, most_ids: int = MOST_IDS) -> DataFrame:
    """(text, trusted) of each row of docs.

    The distinct trusted keys are written and measured. Up to ``most_ids`` keys of ``KEY_BYTES`` bytes at most go to
    every executor and no text moves; beyond that both sides are sorted by key, and rows without a key stay where they are.
    """
    texts = docs.select(F.col(key).alias("id"), F.col(text_col).alias("text"))
    ids = materialize(trusted.select(F.col(key).alias("trusted_id")).filter("trusted_id is not null").distinct(), "trusted")
    n, widest = ids.agg(F.count("*"), F.max(F.octet_length(F.col("trusted_id").cast("string")))).first()
    small = n <= most_ids and (widest or 0) <= KEY_BYTES
    held = F.broadcast(ids) if small else ids.hint("merge")
    keyed = texts if small else texts.filter("id is not null")
    known = keyed.join(held, F.col("id") == F.col("trusted_id"), "left").select("text", F.col("trusted_id").isNotNull().alias("trusted"))
    return known if small else known.unionByName(texts.filter("id is null").select("text", F.lit(False).alias("trusted")))


def score_quality(docs: DataFrame, trusted: DataFrame, text_col: str = "text", key: str = "doc_id", order: int = 2, buckets: int = 1 << 16, smoothing: float = 1.0, threshold: float = -0.5) -> DataFrame:
    """docs with the columns of base_rules, ``llr`` (mean log ratio) and ``kept`` added.

    trusted: a table with column ``key`` naming the trusted documents; its rows may repeat, and null
    keys name none. kept is false if base_failed, else llr >= threshold; with no trusted document at
    all the method has no verdict, and the base rules decide. A document without words has a null llr
    and is not kept. Ties at the threshold are kept. Columns of docs stay, except that columns of the
    added names are replaced.
    """
    found = log_ratios(flagged(docs, trusted, text_col, key), order, buckets, smoothing).first()["ratios"]  # `buckets` doubles, whatever the input
    words = unused(docs, "__words")
    # one literal: Spark folds the split and the cast before the job starts
    table = F.split(F.lit(",".join(map(repr, found))), ",").cast("array<double>") if found else None
    total = lambda grams: F.aggregate(grams, F.lit(0.0), lambda s, b: s + F.get(table, b)) / F.size(grams)
    mean = let(gram_buckets(F.col(words), order, buckets), total) if found else F.lit(None).cast("double")
    return (
        _ruled(docs, text_col, words)
        .withColumn("llr", F.when(F.col("n_words") > 0, mean))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(True)))
        .drop(words)
    )

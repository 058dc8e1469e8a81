"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import ann, bpe, decontaminate, license_scan, line_dedup, lm, mixing, near_dup, quality, ranked, toxicity, vq, warc
from gristmill.llm.common import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    return warc.archived(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm.stupid_backoff(_table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", F.round("mean_score", 6).alias("mean_score"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), k=2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out)
    scored = toxicity.score_toxicity(_table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").filter("quality = 1")
    return quality.score_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), trusted).drop("text")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vq.compress(_table(spark, sf_dir, "embeddings")).drop("codebooks")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def licenses_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5_licenses that SQL can express."""
    return op5_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_mixing that SQL can express."""
    return op7_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def quality_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_quality that SQL can express."""
    return quality.base_rules(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds of op12, one after the other."""
    far = "list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))"
    nearest = f"SELECT p.r, p.part, min({{{{'d': {far}, 'e': b.e}}}}) AS m FROM p JOIN {{books}} b USING (part) GROUP BY p.r, p.part"
    steps = []
    for n in range(rounds):
        steps.append(f"""a{n} AS MATERIALIZED ({nearest.format(books=f"b{n}")}),
s{n} AS (SELECT part, m.e AS e, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT part, m, v, unnest(range(1, len(v) + 1)) AS i FROM a{n} JOIN p USING (r, part)) GROUP BY ALL),
m{n} AS (SELECT part, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{n} GROUP BY part, e),
b{n + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m{n}.v, b.v) AS v FROM b{n} b LEFT JOIN m{n} USING (part, e)),""")
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096e0 * c) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS MATERIALIZED (SELECT r, part, x[part * (len(x) // {parts}) + 1 : (part + 1) * (len(x) // {parts})] AS v FROM k, range({parts}) AS t(part)),
b0 AS (SELECT part, r - 1 AS e, v FROM p WHERE r <= {entries}),
{" ".join(steps)}
z AS MATERIALIZED ({nearest.format(books=f"b{rounds}")}),
c AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM z GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c USING (r) CROSS JOIN h"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_lm_scores, op3_near_dup, op4_toxicity, op5_licenses, op6_line_dedup, op7_mixing, op8_bpe, op9_quality, op10_neighbours, op11_decontamination, op12_vector_codes, op13_ranked_search, licenses_base_places, mixing_targets, quality_base_rules)
}

#: DuckDB SQL for the same rows.
SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS head FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND head > coalesce(page_id, head - 1) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND head > coalesce(page_id, head - 1) THEN head END AS refers_to
FROM g""",
    "op2_lm_scores": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS ws FROM documents),
t AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM d WHERE ws <> ['']),
b AS (SELECT *, lag(w) OVER (PARTITION BY r ORDER BY i) AS v FROM t),
uni AS (SELECT w, count(*) AS n FROM t GROUP BY w),
bi AS (SELECT v, w, count(*) AS n FROM b WHERE v IS NOT NULL GROUP BY v, w HAVING count(*) >= 2),
total AS (SELECT count(*) AS n FROM t),
s AS (SELECT b.r, CASE WHEN bi.n IS NOT NULL THEN ln(bi.n) - ln(uv.n) ELSE ln(uw.n) - ln(total.n) + CASE WHEN b.v IS NULL THEN 0 ELSE ln(4e-1) END END AS x
  FROM b CROSS JOIN total JOIN uni uw ON b.w = uw.w LEFT JOIN uni uv ON b.v = uv.w LEFT JOIN bi ON b.v = bi.v AND b.w = bi.w),
a AS (SELECT r, count(*) AS n, avg(x) AS m FROM s GROUP BY r)
SELECT doc_id, CAST(coalesce(a.n, 0) AS BIGINT) AS n_words, round(a.m, 6) AS mean_score FROM d LEFT JOIN a USING (r)""",
    "op3_near_dup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.c = e.a),
comp AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(n.n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN comp USING (doc_id)""",
    "op6_line_dedup": r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
t AS (SELECT r, source, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM d),
b AS (SELECT r, source, i, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k FROM t),
g AS (SELECT k, min(r) AS first FROM b WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 10),
f AS (SELECT b.r, b.i, b.line, g.k IS NOT NULL AND g.first <> b.r AS gone FROM b LEFT JOIN g ON b.k = g.k),
a AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text FROM f GROUP BY r)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, a.text AS text FROM d LEFT JOIN a USING (r)""",
    "licenses_base_places": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT r, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS w FROM d),
s AS (SELECT r, i, w, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3 FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
f AS (SELECT r, i, 'mit' AS label FROM s WHERE w = 'under' AND w1 = 'the' AND w2 = 'mit' AND w3 = 'license'
  UNION ALL SELECT r, i, 'apache-2' FROM s WHERE w = 'apache' AND w1 = 'license' AND w2 = 'version' AND w3 = '2'
  UNION ALL SELECT r, i, 'cc-by-nc' FROM s WHERE w = 'cc' AND w1 = 'by' AND w2 = 'nc'),
a AS (SELECT r, count(*) AS n, min(i) AS low, max(i) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(low AS BIGINT) AS first_word, CAST(high AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN a USING (r)""",
    "mixing_targets": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS w FROM d GROUP BY source),
c AS (SELECT *, 2e0 * n / w AS stop, sum(2e0 * n) OVER before AS capped, sum(w) OVER rest AS open, 15e-1 * sum(n) OVER () AS total FROM s
  WINDOW before AS (ORDER BY 2e0 * n / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rest AS (ORDER BY 2e0 * n / w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT arg_min((total - coalesce(capped, 0)) / open, stop) AS x FROM c WHERE (total - coalesce(capped, 0)) / open <= stop)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, CAST(c.n AS BIGINT) AS source_size, round(least(2e0 * c.n, level.x * c.w), 3) AS target
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source CROSS JOIN level""",
    "quality_base_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
u AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM d),
g AS (SELECT r, i, w, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4 FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
m AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w1, w2, w3, w4) AS n FROM g WHERE w4 IS NOT NULL),
c AS (SELECT r, count(DISTINCT i + j) AS n FROM m CROSS JOIN range(5) AS z(j) WHERE n > 1 GROUP BY r),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(ws) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(ws) AS base_failed
FROM l LEFT JOIN c USING (r)""",
    "op11_decontamination": r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
q AS (SELECT item_id, ws, least(len(ws), 10) AS m FROM i WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, m, array_to_string(ws[p : p + m - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS p FROM q)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT r, m, p, array_to_string(ws[p : p + m - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT m FROM w))),
h AS (SELECT r, p, m, item_id FROM g JOIN w USING (m, g)),
n AS (SELECT r, count(DISTINCT p + j) AS n_hit FROM (SELECT r, p, unnest(range(m)) AS j FROM h) GROUP BY r),
t AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)""",
    "op12_vector_codes": _codes_sql(),
    "op13_ranked_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
z AS (SELECT count(*) FILTER (WHERE len(ws) > 0) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d),
f AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS ws FROM (SELECT DISTINCT item_id, text FROM benchmark)),
t AS (SELECT q, unnest(ws) AS w FROM i),
k AS (SELECT w, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT w, count(*) AS df FROM f GROUP BY w) CROSS JOIN z),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * len(ws) * n) // l) AS m FROM d CROSS JOIN z),
s AS (SELECT q, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM t JOIN k USING (w) JOIN f USING (w) JOIN m USING (r) GROUP BY q, r),
o AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o JOIN i USING (q) WHERE rank <= 10""",
}

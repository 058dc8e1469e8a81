"""The corpus operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, and brute force."""

import hashlib
import math
import random
from collections import Counter

import pytest

pytest.importorskip("gristmill.llm.bpe")
from pyspark.sql import functions as F  # noqa: E402

from gristmill.llm import ann, bpe, license_scan, line_dedup, lm, mixing, near_dup, quality, toxicity, warc  # noqa: E402
from gristmill.llm.common import scratch_path  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, `key` string, score double, h string"
LONG = " ".join(f"word{i} again" for i in range(6000))


def rows(*texts, ids=None, sources=None):
    ids = ids or list(range(1, len(texts) + 1))
    return [(i, t, None, (sources or ["s"] * len(texts))[k], None, 7, "k", 0.5, "h") for k, (i, t) in enumerate(zip(ids, texts))]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " \n\t ", "under the MIT license", LONG, LONG, "a b c d e f g h i j k l", "under the MIT license", None]
    return spark.createDataFrame(rows(*texts, ids=[1, 2, 3, 4, 5, 6, 7, 4, None], sources=["a", None, "b", "a", "a", "b", "c", "a", None]), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer_path())
    odd = ["It's 3.5 ΟΔΟΣ <|endoftext|>x<|startoftext|>", "é  　 ﬁ İ 日本語 🙂🙂", "don't WE'LL 've", "\x1c\x85a", None, "", "ẞß Ǆ", LONG]
    w = bpe.WordBpe(bpe.default_tokenizer_path(), cache_entries=50)
    for x in odd:
        ids = t.encode(x or "", add_special_tokens=False).ids
        n, joined, decoded = w.encode(x)
        assert (n, joined, decoded) == (len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))
    out = bpe.encode(docs, outputs=("n_tokens", "ids", "decoded", "ids_sha256")).collect()
    assert len(out) == 9 and all(len(r["ids"]) == r["n_tokens"] and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest() for r in out)
    assert bpe.encode(none).count() == 0


def test_warc(spark):
    big = "é" * 60_000
    pages = spark.createDataFrame([(1, "http://a/\r\nx", None, "q"), (2, None, big, "q"), (3, "u", big, "q"), (3, "u", big, "q"), (None, "u", big, "q"), (5, "u", "WARC/1.1\r\n\r\n0\r\n\r\n", "q"), (6, "u", "x" * 999, "q"), (7, "u", "x" * 999, "q")], "page_id bigint, url string, html string, payload string")
    path = scratch_path(spark, "warc")
    warc.write_warc(pages, path, segment_bytes=10_000, chunk_bytes=777)
    read = warc.read_warc(spark, path).collect()
    assert len(read) == 8 and all(r["problem"] is None for r in read)
    assert {r["page_id"]: bytes(r["payload"]) for r in read if r["record_type"] == "response"} == {1: b"", 3: big.encode(), 5: b"WARC/1.1\r\n\r\n0\r\n\r\n", 6: b"x" * 999, 7: b"x" * 999}
    out = warc.archived(spark, path).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in out) == [(0, "revisit", 3), (1, "response", None), (2, "revisit", 3), (3, "response", None), (3, "response", None), (5, "response", None), (6, "response", None), (7, "response", None)]
    assert all(r["payload_bytes"] == 120_000 and r["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() for r in out if r["page_id"] in (None, 2, 3))
    assert warc._dechunk(b"5\r\nab") == (None, "broken chunk")
    empty = scratch_path(spark, "warc")
    warc.write_warc(pages.limit(0), empty)
    assert warc.archived(spark, empty).count() == 0


def test_warc_reports_damage(spark):
    import gzip
    import os
    import tempfile

    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    record = lambda name, kind, block, more=b"": b"WARC/1.1\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <" + name + b">\r\n" + more + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    segment = lambda n, origin: b"WARC-Segment-Number: %d\r\nWARC-Segment-Origin-ID: <" % n + origin + b">\r\n"
    folder = tempfile.mkdtemp(prefix="spark-")
    files = {
        "a.warc": record(b"u1", b"response", body) + b"rubbish\r\n\r\n" + record(b"u2", b"response", body),
        "b.warc.gz": gzip.compress(record(b"u3", b"response", body)) + gzip.compress(record(b"u4", b"response", body)),
        "c.warc.gz": gzip.compress(record(b"u5", b"response", body))[:-6],
        "d.warc": record(b"u6/2", b"continuation", b"lo", segment(2, b"u6")) + record(b"u7/2", b"continuation", b"lo", b"WARC-Segment-Origin-ID: <u7>\r\n"),
        "e.warc": record(b"u8", b"response", body)[:-8],
    }
    for name, data in files.items():
        with open(os.path.join(folder, name), "wb") as f:
            f.write(data)
    out = sorted((r["record_id"], bytes(r["payload"]) if r["payload"] is not None else None, r["problem"]) for r in warc.read_warc(spark, "file://" + folder).collect())
    assert [x for x in out if x[2] is None] == [(f"u{i}", b"hello", None) for i in (1, 2, 3, 4, 5)]
    assert [x[::2] for x in out if x[2]] == [("", "broken gzip"), ("", "not a WARC record"), ("u6", "segment missing"), ("u7", "no segment number"), ("u8", "cut off")]
    assert warc.read_warc(spark, "file://" + folder, files="b*").count() == 2


def test_lm(docs, none):
    out = lm.stupid_backoff(docs, block_bytes=1000, partition_grams=500).collect()
    assert len(out) == 9
    assert all(r["log_score"] == 0 and r["mean_score"] is None for r in out if r["n_words"] == 0)
    assert sum(r["n_words"] for r in out) == 4 * 2 + 12_000 * 2 + 12
    assert lm.stupid_backoff(none).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_lm_orders(spark, order):
    draw = random.Random(order)
    texts = [" ".join(draw.choice("abcdef") for _ in range(draw.choice([0, 1, 2, 3, 40, 200]))) for _ in range(60)] + [None, "A b\tC  a", "a b c a"]
    words = [(t or "").lower().split() for t in texts]
    counts = Counter(tuple(w[i : i + n]) for w in words for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, words))

    def score(gram):
        if len(gram) == 1:
            return math.log(counts[gram] / total)
        return math.log(counts[gram] / counts[gram[:-1]]) if counts[gram] >= 3 else math.log(0.4) + score(gram[1:])

    want = [sum(score(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w))) for w in words]
    out = lm.stupid_backoff(spark.createDataFrame(rows(*texts), SCHEMA), order=order, min_count=3, block_bytes=900, partition_grams=200).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(texts)
    for i, (w, x) in enumerate(zip(words, want)):
        assert got[i + 1]["n_words"] == len(w) and abs(got[i + 1]["log_score"] - x) < 1e-6, i
        assert w == [] and got[i + 1]["mean_score"] is None or abs(got[i + 1]["mean_score"] - x / len(w)) < 1e-6


def test_near_dup(spark, docs, none):
    out = near_dup.near_duplicates(docs, k=2).collect()
    by = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in out)
    assert [b for b in by if b[0] in (0, 1, 2, 3)] == [(0, 0, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    assert [(b[0], b[2], b[3]) for b in by if b[0] >= 4] == [(4, 4, True), (4, 4, True), (5, 5, True), (6, 5, False), (7, 7, True)]
    assert near_dup.near_duplicates(none).count() == 0
    draw = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for g in range(12):
        base = [draw.choice(words) for _ in range(draw.randint(20, 60))]
        for _ in range(6):
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(" ".join(copy))
    found = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows(*texts), SCHEMA), k=2).collect()}
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = [low if c == high else c for c in comp]
    assert found == {i + 1: c + 1 for i, c in enumerate(comp)}


def test_toxicity(spark, docs, none):
    texts = [f"you moron number {i}" if i % 4 == 0 else f"a fine calm day {i}" for i in range(80)]
    table = spark.createDataFrame(rows(*texts), SCHEMA)
    labels = spark.createDataFrame([(i + 1, int(i % 4 == 0)) for i in range(60)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    out = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(table, labels).collect()}
    assert out == {i + 1: int(i % 4 == 0) for i in range(80)}
    scored = toxicity.score_toxicity(docs, labels).collect()
    assert len(scored) == 9 and all(0 <= r["score"] <= 1 for r in scored)
    assert [r["score"] for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()] == [0.0] * 9
    assert toxicity.score_toxicity(none, labels).count() == 0


def test_block_max_is_exact():
    import numpy as np

    draw = np.random.default_rng(1)
    dense = np.zeros((1200, 90))
    for i, row in enumerate(dense):  # four kinds of vectors, so that blocks differ
        t = draw.choice(20, 6, replace=False) + 20 * (i % 4) + draw.integers(0, 10, 6)
        row[t] = draw.random(6)
    dense[7], dense[1000] = dense[3], dense[3]
    dense = (dense / np.linalg.norm(dense, axis=1, keepdims=True)).astype(np.float32)
    at = [np.flatnonzero(v) for v in dense]
    names = np.sort(draw.integers(0, 1 << 63, 90).astype(np.uint64))
    index = toxicity.BlockMaxIndex(names[np.concatenate(at)], np.concatenate([v[t] for v, t in zip(dense, at)]), np.array([len(t) for t in at]), dense=0.066)
    assert index.blocks > 4 and len(index.matrix) < 90
    opened = []
    add = index._add
    index._add = lambda sums, a, w, blocks: (opened.append(len(blocks)), add(sums, a, w, blocks))
    found = index.nearest_all([(names[t], v[t].astype(float)) for v, t in zip(dense[:50], at)], 7)
    for q, near in enumerate(found):
        scores = dense.astype(float) @ dense[q].astype(float)
        expected = sorted(range(1200), key=lambda e: (-round(scores[e], 7), e))[:7]
        assert np.allclose([c for c, _ in near], scores[expected], atol=1e-6)
        assert q != 3 or [e for _, e in near[:3]] == [3, 7, 1000]
    assert sum(opened) < 50 * index.blocks  # blocks that can't hold a nearest example stay closed


def test_toxicity_weighs_whole_texts(spark):
    import numpy as np

    draw = random.Random(6)
    words = [f"plain{i}" for i in range(60)]
    texts = [("moron " if i % 4 == 0 else "") + " ".join(draw.choice(words) for _ in range(12)) for i in range(80)]
    texts += ["moron " + " ".join(f"other{i}" for i in range(300)), texts[0].removeprefix("moron "), "nothing known"]
    table = spark.createDataFrame(rows(*texts), SCHEMA)
    labels = spark.createDataFrame([(i + 1, int(i % 4 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(table, labels).collect()}
    # brute force over all words, with the one that speaks for the label lifted
    bags = [{w: t.split().count(w) for w in t.split()} for t in texts]
    weigh = lambda b: {t: (1 + np.log(n)) * (np.log((len(texts) + 1) / (sum(t in x for x in bags) + 1)) + 1) * (8 if t == "moron" else 1) for t, n in b.items()}
    vectors = [weigh(b) for b in bags]
    norms = [np.sqrt(sum(w * w for w in v.values())) for v in vectors]
    for i, v in enumerate(vectors):
        cosines = sorted(((sum(w * vectors[e].get(t, 0) for t, w in v.items()) / norms[i] / norms[e], e % 4 == 0) for e in range(60)), reverse=True)[:10]
        found = [e["cosine"] for e in out[i + 1]["evidence"]]
        assert np.allclose(found, [c for c, _ in cosines if c > 1e-9], atol=1e-6)
        score = (sum(c for c, y in cosines if y) + 1.5 * 0.25) / (sum(c for c, _ in cosines) + 1.5)
        assert abs(out[i + 1]["score"] - score) < 1e-6
    assert max(e["cosine"] for e in out[81]["evidence"]) < 0.9  # one listed term does not make a long text equal to a toxic one
    # clean examples are in the index: beside the toxic example of which text 82 is a part, those that brute force finds
    nearest = sorted(((sum(w * vectors[e].get(t, 0) for t, w in vectors[81].items()) / norms[81] / norms[e], e + 1) for e in range(60)), reverse=True)[:10]
    assert sorted(e["id"] for e in out[82]["evidence"]) == sorted(e for _, e in nearest) and [e["label"] for e in out[82]["evidence"]].count(0) >= 5 and out[83]["evidence"] == []


def test_licenses(docs, none):
    out = license_scan.scan_licenses(docs).collect()
    assert len(out) == 9
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) for r in out if r["doc_id"] == 4] == [(4, 1, 0, 0, "mit", "mit", 1.0)] * 2
    assert all(r["labels"] == "" and r["score"] == 0 for r in out if r["doc_id"] != 4)
    assert license_scan.scan_licenses(none).count() == 0


def test_license_notice_with_an_inserted_word(spark):
    text = "x y This work is hereby licensed under the GNU General Public License, version 3. z"
    r = license_scan.scan_licenses(spark.createDataFrame(rows(text), SCHEMA)).first()
    assert r["labels"] == "gpl-3" and r["n_base"] == 0 and r["score"] >= 0.8


def test_licenses_against_brute_force(spark):
    import re

    draw = random.Random(9)
    pool = [*("under the mit license apache version 2 cc by nc".split()), "x"]
    texts = [" ".join(draw.choice(pool) for _ in range(draw.randint(0, 400))) for _ in range(60)]
    texts += ["Under THE mit-license. " * n for n in (1, 2, 3000)] + ["cc by nc by nc cc by cc by nc", "émit under the mit license", "under the\nMIT\tlicense, licensed under CC BY-NC 4.0", None, "cc by"]
    for r in license_scan.scan_licenses(spark.createDataFrame(rows(*texts), SCHEMA)).collect():
        t = (texts[r["doc_id"] - 1] or "").translate(str.maketrans(license_scan.UPPER, license_scan.LOWER))
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        at = [(i, label) for phrase, label in license_scan.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in at] or [None]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(places), max(places), ",".join(sorted({x for _, x in at})))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and (r["score"] == 1 if at else r["score"] <= 1)


def notice_labels(w, k=3, max_shift=3, min_cover=0.8):
    """Brute force: the labels of the notices that the words w hold, each diagonal and each part of a run tried one by one."""
    import math

    spans = []
    for family, label, p in license_scan.NOTICES:
        t, hits = p.split(), {}
        for i in range(len(w) - k + 1):
            for j in range(len(t) - k + 1):
                if w[i : i + k] == t[j : j + k]:
                    hits.setdefault(i - j, set()).add(j)
        shift, runs = max(max_shift, math.floor(len(t) / min_cover - len(t) * min_cover)), []
        for d in sorted(hits):
            runs = [*runs[:-1], [*runs[-1], d]] if runs and d - runs[-1][-1] <= shift else [*runs, [d]]
        for run in runs:
            good = []
            for parts in [run] + [run[a:b] for a in range(len(run)) for b in range(a + 1, len(run) + 1) if run[b - 1] - run[a] <= shift or b == a + 1]:
                covered = len({q for d in parts for j in hits[d] for q in range(j, j + k)}) / len(t)
                long = max(d + max(hits[d]) for d in parts) + k - min(d + min(hits[d]) for d in parts)
                if covered >= min_cover and long * min_cover <= len(t):
                    good.append((0 if parts is run else len(parts), covered))
            spans += [(family, label, c) for size, c in good if size == min(good)[0]]
    best = {}
    for family, _, c in spans:
        best[family] = max(best.get(family, 0), c)
    return sorted({label for family, label, c in spans if c == best[family]})


def test_license_notices_against_brute_force(spark):
    draw, texts = random.Random(21), []
    for _, label, p in license_scan.NOTICES:
        words = p.split()
        half = len(words) // 2
        texts += [" ".join([*words[:half], *["x"] * n, *words[half:]]) for n in (0, 1, 3, 4, 9, 30)] + [" ".join(words[half:] + words[:half])]
        for _ in range(8):
            w = list(words)
            for _ in range(draw.randint(1, 4)):
                at = draw.randrange(len(w))
                w[at : at + draw.randint(0, 2)] = ["y"] * draw.randint(0, 5)
                w = w or ["z"]
            texts.append(" ".join(["a", *w, "b", *(w if draw.random() < 0.3 else [])]))
    out = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(spark.createDataFrame(rows(*texts), SCHEMA), base=[]).collect()}
    assert len(out) > 200 and out == {i: ",".join(notice_labels(t.split())) for i, t in enumerate(texts, 1)}
    long = next(p for _, label, p in license_scan.NOTICES if p.startswith("permission is hereby")).split()
    assert "mit" == out[texts.index(" ".join([*long[:14], *["x"] * 4, *long[14:]])) + 1]


def test_a_notice_beside_its_own_beginning(spark):
    texts = ["Licensed under CC. Licensed under CC BY 4.0", "licensed under cc by licensed under cc by sa 4 0", "licensed under cc by"]
    out = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(spark.createDataFrame(rows(*texts), SCHEMA)).collect()}
    assert out[1] == "cc-by" and out[2] == "cc-by-sa" and out[3] == ""


def test_line_dedup(spark, docs, none):
    texts = [f"own {i}\n shared line \n\nshared line" for i in range(12)] + [None, "", "shared line"]
    table = spark.createDataFrame(rows(*texts, sources=[f"s{i}" for i in range(14)] + [None]), SCHEMA)
    out = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(table, min_sites=10).collect()}
    assert out[1] == (texts[0], 4, 0) and out[2] == ("own 1\n", 4, 2) and out[13] == (None, 0, 0) and out[14] == ("", 1, 0) and out[15] == ("", 1, 1)
    assert {r["text"] for r in line_dedup.dedup_lines(table, min_sites=13).collect()} == set(texts)
    assert line_dedup.dedup_lines(docs).count() == 9 and line_dedup.dedup_lines(none).count() == 0
    assert line_dedup.dedup_lines(docs).columns == [*docs.columns, "n_lines", "n_removed"]
    odd = table.selectExpr("doc_id", "text", "source", "doc_id as key", "source as site", "text as gone", "5 as __key", "6 as `row`", "7 as `a.b`", "9 as n_lines", "null as id")
    out = line_dedup.dedup_lines(odd, min_sites=10)
    assert out.columns == [*[c for c in odd.columns if c != "n_lines"], "n_lines", "n_removed"]
    for r in out.collect():
        assert (r["key"], r["__key"], r["row"], r["a.b"], r["id"]) == (r["doc_id"], 5, 6, 7, None) and r["gone"] == ([*texts] + [None])[r["doc_id"] - 1]
    same = spark.createDataFrame(rows(*["x\nboiler"] * 3, *["y\nboiler"] * 12, ids=[None] * 3 + [7] * 12, sources=[f"s{i}" for i in range(15)]), SCHEMA)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup_lines(same, min_sites=10).collect()) == [(0, "x")] * 3 + [(7, "y\nboiler")] * 12


def test_mixing(spark, docs, none):
    draw = random.Random(5)
    texts = [" ".join(["w"] * draw.randint(0, 900)) for _ in range(400)]
    names = [draw.choice(["a", "b", "c", "d", None]) if i % 3 else "a" for i in range(400)]
    table = spark.createDataFrame(rows(*texts, sources=names), SCHEMA)
    out = [r.asDict() for r in mixing.mix_sources(table, keep=("lang",)).collect()]
    assert len(out) == 400 and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert all((r["first_slot"] is None) == (r["taken"] == 0) for r in out)
    source = dict(zip(range(1, 401), names))
    for name in set(names):
        own = [r for r in out if source[r["doc_id"]] == name]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5
        assert own[0]["source_size"] == sum(r["size"] for r in own) and own[0]["target"] <= 2 * own[0]["source_size"] + 1e-6
    assert abs(sum({source[r["doc_id"]]: r["target"] for r in out}.values()) - 1.5 * sum(r["size"] for r in out)) < 1e-3
    again = [r.asDict() for r in mixing.mix_sources(table.repartition(7), keep=("lang",)).collect()]
    key = lambda r: r["doc_id"]
    assert sorted(out, key=key) == sorted(again, key=key)
    assert mixing.mix_sources(docs).count() == 9 and mixing.mix_sources(none).count() == 0


def test_mixing_is_exact_for_small_sources(spark):
    sizes = {"big": [5000, 700, 4301], "a": [30], "b": [3, 8], "c": [1], "d": [70, 41], "e": [0, 0]}
    table = spark.createDataFrame(rows(*(" ".join(["w"] * n) for s in sizes.values() for n in s), sources=[k for k, s in sizes.items() for _ in s]), SCHEMA)
    names = [k for k, s in sizes.items() for _ in s]
    for block in (1, 16, 256):
        out = [r.asDict() for r in mixing.mix_sources(table, share=1.9, block_tokens=block).collect()]
        for name in sizes:
            own = [r for r in out if names[r["doc_id"] - 1] == name]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5 and all(0 <= r["taken"] <= 2 * r["size"] for r in own)
        assert sum(r["taken"] for r in out if names[r["doc_id"] - 1] == "a") == 60


def test_schedule_against_brute_force(spark):
    target = {0: 700.0, 1: 30.0, 2: 0.0, 3: 270.0, 4: 0.4}
    need = {0: 700, 1: 30, 2: 0, 3: 270, 4: 1}
    by = spark.createDataFrame([(i, target[i], need[i]) for i in target], "no int, target double, slots bigint")
    found = sorted((r["slot"], r["no"], r["rank"]) for r in mixing.schedule(by, 1001, 5).collect())
    edges, ranks, expected = [], dict.fromkeys(target, 0), []
    for i in (0, 1, 3, 4):
        edges.append((sum(target[x] for x in target if x <= i) / sum(target.values()), i))
    for j in range(1001):
        u = j * 11400714819323198485 % (1 << 64) / (1 << 64)
        i = next((i for e, i in edges if u < e), 4)
        if ranks[i] < need[i]:
            expected.append((j, i, ranks[i]))
        ranks[i] += 1
    lacking = sorted((r, i) for i in target for r in range(ranks[i], need[i]))
    assert found == expected + [(1001 + k, i, r) for k, (r, i) in enumerate(lacking)]
    assert len(lacking) < 10
    # any run of slots holds each source near its share
    for low in range(0, 900, 100):
        assert abs(sum(1 for s, i, _ in found if low <= s < low + 100 and i == 0) - 70) <= 4


def test_quality(spark, docs, none):
    import re

    good, bad = "the cat sat on the mat with a calm old dog near it".split(), "zz qq xx yy kk jj vv ww pp nn mm bb".split()
    draw = random.Random(2)
    texts = [" ".join(draw.choice(good if i % 5 else bad) for _ in range(40)) for i in range(100)]
    table = spark.createDataFrame(rows(*texts), SCHEMA)
    trusted = spark.createDataFrame([(i + 1,) for i in range(100) if i % 5] + [(None,), (2,)], "doc_id bigint")
    out = {r["doc_id"]: r for r in quality.score_quality(table, trusted, smoothing=0.01).collect()}
    assert all(out[i + 1]["kept"] == (bool(i % 5) and not out[i + 1]["base_failed"]) for i in range(100))
    tricky = [None, "", " \n ", "a b c d e a b c d e", "# a *$ %\n\nx\nx\n x\n", LONG, "a b c d e f g h i j a b c d e"]
    for r in quality.base_rules(spark.createDataFrame(rows(*tricky), SCHEMA)).collect():
        t = tricky[r["doc_id"] - 1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 5)} if len(w) < 1000 else set()
        lines = [x for x in t.split("\n") if x.strip()]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
    keyless = table.unionByName(docs.select(*table.columns)).unionByName(spark.createDataFrame([(None, "no key", *[None] * (len(table.columns) - 2))], table.select("doc_id", "text", *[c for c in table.columns if c not in ("doc_id", "text")]).schema))
    near, far = (sorted(map(tuple, quality.flagged(keyless, trusted, "text", "doc_id", most).collect()), key=repr) for most in (quality.MOST_IDS, 0))
    assert near == far and len(near) == keyless.count() and sum(t for _, t in near) >= 80
    odd = quality.score_quality(table.withColumn("__words", F.lit(5)).withColumn("kept", F.lit("x")), trusted)
    assert odd.columns == [*table.columns, "__words", "kept", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr"]
    assert {(r["__words"], type(r["kept"])) for r in odd.collect()} == {(5, bool)} and "__words" not in quality.base_rules(table).columns
    assert all(r["llr"] is None for r in quality.score_quality(docs, trusted.limit(0)).collect())
    assert quality.score_quality(none, trusted).count() == 0


def test_log_ratios_against_brute_force(spark):
    import math
    from collections import Counter

    draw = random.Random(12)
    texts = [" ".join(draw.choice("the cat sat on a mat éa B b".split()) for _ in range(draw.randint(0, 60))) for _ in range(60)] + [None, "", "the cat"]
    table = spark.createDataFrame(rows(*texts), SCHEMA)
    trusted = spark.createDataFrame([(i,) for i in range(1, 20)] + [(3,), (None,)], "doc_id bigint")
    out = {r["doc_id"]: r for r in quality.score_quality(table, trusted, order=3, buckets=64, smoothing=0.5, threshold=0.0).collect()}
    grams = {i + 1: [tuple(w[a : a + n]) for n in (1, 2, 3) for a in range(len(w) - n + 1)] for i, w in enumerate((t or "").split() for t in texts)}
    # the engine's hash places the n-grams; all else is counted here
    every = sorted({g for x in grams.values() for g in x})
    hashed = spark.createDataFrame([(k, list(g)) for k, g in enumerate(every)], "k int, g array<string>").withColumn("h", F.transform("g", lambda w: F.xxhash64(w)))
    one = F.when(F.size("h") == 1, F.get("h", F.lit(0)))
    for n in (2, 3):
        one = one.when(F.size("h") == n, F.xxhash64(*(F.get("h", F.lit(i)) for i in range(n))))
    bucket = {every[r["k"]]: r["b"] for r in hashed.select("k", F.pmod(one, F.lit(64)).alias("b")).collect()}
    raw, good = Counter(bucket[g] for x in grams.values() for g in x), Counter(bucket[g] for i in range(1, 20) for g in grams[i])
    ratio = [math.log((good[b] + 0.5) / (sum(good.values()) + 32) / ((raw[b] + 0.5) / (sum(raw.values()) + 32))) for b in range(64)]
    for i, x in grams.items():
        mean = sum(ratio[bucket[g]] for g in x) / len(x) if x else None
        assert out[i]["llr"] is None if mean is None else abs(out[i]["llr"] - mean) < 1e-9
        assert out[i]["kept"] == (not out[i]["base_failed"] and mean is not None and mean >= 0)


@pytest.mark.parametrize("name", ["licenses_base_places", "mixing_targets", "quality_base_rules"])
def test_sql(spark, name):
    import os

    import duckdb

    from gristmill.llm import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    expected = db.sql(queries.SQL[name])
    found = queries.QUERIES[name](spark, sf).select(*expected.columns)
    assert sorted(map(tuple, found.collect())) == sorted(expected.fetchall())


def test_neighbours(spark):
    import numpy as np

    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 8)).astype(np.float32)
    x[100] = x[200] = x[50]
    data = [(i, [float(v) for v in x[i]], 0) for i in range(300)] + [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 0), (903, [None] + [1.0] * 7, 0), (904, [1.0, 2.0], 0), (None, [1.0] * 8, 0), (50, [float(v) for v in x[50]], 0)]
    table = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int")
    out = ann.nearest(table, table.filter("vec_id % 50 = 0"), tile_rows=64).collect()
    for q in range(0, 300, 50):
        a = x.astype(float)
        s = (a * a[q]).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((a[q] * a[q]).sum()))
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]
        found = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [i for _, i, _ in found] == best and [z for _, _, z in found] == [s[i] for i in best]
    assert not [r for r in out if r["query_id"] >= 900]
    assert ann.nearest(table.limit(0), table.limit(0)).count() == 0
    few = table.filter("vec_id in (0, 1, 2, 904)")
    out = ann.nearest(few, few.filter("vec_id in (0, 904)"), tile_rows=1).collect()
    assert sorted((r["query_id"], r["rank"]) for r in out) == [(0, 1), (0, 2)]


def test_neighbours_in_many_dimensions(spark):
    import numpy as np

    q = np.full((2, 3001), 127, dtype=np.int8)
    q[1, ::2] = -126
    assert (ann.product(q, q) == q.astype(np.int64) @ q.astype(np.int64).T).all()
    x = np.random.default_rng(8).normal(size=(60, 3001))
    x[30:] = x[:30] + 1e-4 * x[::-1][:30]  # closer to each other than rounding to int8 can tell
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(7, (2 * x[9]).tolist())] * 2, "vec_id bigint, embedding array<double>")
    found = [(r["rank"], r["vec_id"]) for r in ann.nearest(table, table.filter("vec_id = 39"), tile_rows=16).collect()]
    s = [x[39] @ v / np.linalg.norm(x[39]) / np.linalg.norm(v) for v in x]
    s[7] = max(s[7], s[9])
    best = sorted((i for i in range(60) if i != 39), key=lambda i: -round(s[i], 12))[:5]
    assert [i for _, i in sorted(found)][2:] == best[2:] and {i for _, i in found[:2]} == {7, 9}


def test_pipeline_judges_repeated_ids_by_row(spark):
    import corpus_pipeline

    first, own, third = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    near, again = first + " more", third + " more"
    table = spark.createDataFrame(rows(first, near, own, third, third, again, "", "", None, first, first, ids=[1, 2, 2, 3, 3, 3, 4, 4, 5, None, None]), SCHEMA)
    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, table, "").collect()]
    assert sorted(x for x in out if x[0] in (1, 2, 4)) == [(1, first), (2, own), (4, "")]
    assert len([x for x in out if x[0] == 3]) == 1 and (5, None) in out and out.count((None, first)) == 2 and len(out) == 7


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    texts = [f"you moron number {i}" if i % 4 == 0 else f"a fine calm day {i}" for i in range(80)] + [None, ""]
    sf = scratch_path(spark, "sf")
    spark.createDataFrame([(i + 1, int(i % 4 == 0)) for i in range(60)], "doc_id bigint, toxic int").write.parquet(f"{sf}/labels.parquet")
    left = corpus_pipeline.drop_toxic(spark, spark.createDataFrame(rows(*texts), SCHEMA), sf)
    assert left.columns == columns and sorted(r["doc_id"] for r in left.collect()) == [i + 1 for i in range(82) if i % 4 or i >= 80]

    texts = [f"own {i}\n shared line " for i in range(12)] + ["shared line", "\n", None, "alone"]
    left = corpus_pipeline.drop_boilerplate(spark, spark.createDataFrame(rows(*texts, sources=[f"s{i}" for i in range(16)]), SCHEMA), sf)
    assert left.columns == columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in left.collect()} == {1: (texts[0], None), **{i + 1: (f"own {i}", len(f"own {i}")) for i in range(1, 12)}, 14: ("\n", None), 15: (None, None), 16: ("alone", None)}

    draw = random.Random(8)
    texts = [" ".join(["w"] * draw.randint(1, 300)) for _ in range(90)] + ["", None]
    table = spark.createDataFrame(rows(*texts, sources=[draw.choice("abc") for _ in texts]), SCHEMA)
    size = {i + 1: len((t or "").split()) for i, t in enumerate(texts)}
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(table).collect()}
    times = {i: 0 for i in size}
    out = corpus_pipeline.mix(spark, table, sf)
    for r in out.collect():
        times[r["doc_id"]] += 1
        assert r["text"] == texts[r["doc_id"] - 1]
    assert out.columns == columns and times == {i: int(taken[i] / n + 0.5) if n else 1 for i, n in size.items()}
    assert abs(sum(times[i] * n for i, n in size.items()) - 1.5 * sum(size.values())) < 3 * max(size.values())

    t = Tokenizer.from_file(bpe.default_tokenizer_path())
    for r in corpus_pipeline.encode(spark, spark.createDataFrame(rows("It's  3.5", "", None), SCHEMA), sf).collect():
        ids = t.encode(["It's  3.5", "", ""][r["doc_id"] - 1], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_pipeline_and_sql(spark):
    import os

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100
    assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}

"""Decontamination, vector codes, ranked search and extreme neighbours against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re

import pytest

pytest.importorskip("gristmill.llm.ranked")
import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402

from gristmill.llm import ann, decontaminate, ranked, terms, vq  # noqa: E402

DOCS = "doc_id bigint, text string, h string, `key` string, runs int, n_words string, score int, item string"
ITEMS = "item_id bigint, text string, words string, window int, terms string, n int"
LONG = " ".join(f"w{i % 977}x" for i in range(120_000))


def terms_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, "h", "k", 1, "n", 2, "i") for i, t in pairs], DOCS).repartition(3)


def items_of(spark, pairs):
    return spark.createDataFrame([(i, t, "w", 1, "t", 2) for i, t in pairs], ITEMS)


def corpus():
    draw = random.Random(5)
    words = [f"t{i}" for i in range(60)] + ["É", "日本", "MiX", "a1"]
    say = lambda n: draw.choice([" ", ", ", "\n"]).join(draw.choice(words) for _ in range(n))
    items = [(i, say(draw.choice([1, 2, 3, 9, 10, 11, 30]))) for i in range(40)] + [(7, say(15)), (None, say(12)), (90, None), (91, " .,"), (3, None), (92, "ab ab ab ab ab ab ab ab ab ab ab ab")]
    items += [(93, items[5][1]), (5, items[5][1])]
    docs = [(i, say(draw.randint(0, 80))) for i in range(60)]
    for i in range(60, 100):
        text = say(20).split(" ") + items[draw.randrange(len(items) - 6)][1].split(" ") + say(5).split(" ")
        docs.append((i, " ".join(text)))
    docs += [(200, None), (201, ""), (202, "?!"), (203, "x " + "ab " * 30), (204, LONG + " " + items[3][1]), (None, items[4][1]), (None, None), (61, docs[61][1]), (61, "another text of t1")]
    return docs, items


def test_cut():
    texts = ["Aé-B", None, "", "..", "c", "日本 D9", "x" * 3, "É"]
    words, row = terms.cut(pa.array(texts))
    assert (words.to_pylist(), row.tolist()) == (["aé", "b", "c", "日本", "d9", "xxx", "É"], [0, 0, 4, 5, 5, 6, 7])
    words, row = terms.cut(pa.array(texts).slice(4, 2))
    assert (words.to_pylist(), row.tolist()) == (["c", "日本", "d9"], [0, 1, 1])
    assert [len(x) for x in terms.cut(pa.array([], pa.string()))] == [0, 0]


def test_decontaminate(spark):
    docs, items = corpus()
    for text in ("t1", "t1 t2 t3"):
        items.append((300, text))
    want = []
    for d, text in docs:
        ws, hit, held = terms_of(text), set(), set()
        for i, t in items:
            q = terms_of(t)
            m = min(len(q), 10)
            wanted = {tuple(q[a : a + m]) for a in range(len(q) - m + 1)} if q else set()
            at = [a for a in range(len(ws) - m + 1) if tuple(ws[a : a + m]) in wanted]
            hit |= {a + j for a in at for j in range(m)}
            held |= {str(i)} if at and i is not None else set()
        want.append((d if d is not None else -1, len(ws), len(hit), sorted(held), bool(hit)))
    shown = lambda out: sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in out.collect())
    d, i = docs_of(spark, docs), items_of(spark, items)
    assert shown(decontaminate.decontaminate(d, i)) == sorted(want)
    # many blocks give the same
    assert shown(decontaminate.decontaminate(d, i, block_windows=120, salts=3)) == sorted(want)
    assert [(r["n_hit"], r["items"]) for r in decontaminate.decontaminate(d, i.limit(0)).collect()] == [(0, [])] * len(docs)
    assert decontaminate.decontaminate(d.limit(0), i).count() == 0


def brute_codes(vectors, parts=8, entries=16, rounds=6):
    whole = [(i, label, [math.floor(4096 * c) for c in v]) for i, v, label in vectors]
    d = len(whole[0][2]) // parts
    cut = lambda x, p: x[p * d : (p + 1) * d]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0], r[2]))[:entries]
    books = [[cut(x, p) for _, _, x in first] for p in range(parts)]
    near = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(cut(x, p), c)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            mine = [near(x, p)[1] for _, _, x in whole]
            for e in set(mine):
                rows = [cut(x, p) for (_, _, x), m in zip(whole, mine) if m == e]
                new[p][e] = [sum(c) // len(rows) for c in zip(*rows)]
        books = new
    text = ",".join(str(c) for b in books for e in b for c in e)
    out = [(i, label, "".join(f"{near(x, p)[1]:02x}" for p in range(parts)), sum(near(x, p)[0] for p in range(parts))) for i, label, x in whole]
    return [(i, c, e, sum(r[3] for r in out if r[1] == label), hashlib.sha256(text.encode()).hexdigest()) for i, label, c, e in out]


def test_vector_codes(spark):
    draw = random.Random(7)
    schema = "vec_id bigint, embedding array<double>, label int, dim string, code string, error int, x string"
    good = [(i, [round(draw.uniform(-2, 2), draw.choice([0, 1, 5])) for _ in range(16)], draw.choice([1, 2, None])) for i in range(300)]
    good += [(5, good[6][1], 2), (5, good[6][1], 2), (None, good[9][1], None), (400, [0.0] * 16, 1)]
    bad = [(500, None, 1), (501, [None] * 16, 1), (502, [float("nan")] * 16, 1), (503, [math.inf] + [0.0] * 15, 1), (504, [], 1), (505, [1.0] * 15, 1), (506, [1e300] + [0.0] * 15, 1)]
    make = lambda rows: spark.createDataFrame([(i, v, label, "d", "c", 1, "x") for i, v, label in rows], schema).repartition(3)
    shown = lambda out: sorted(((r["vec_id"] if r["vec_id"] is not None else -1), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in out.collect())
    fixed = lambda rows: sorted(((r[0] if r[0] is not None else -1), *r[1:]) for r in rows)
    assert shown(vq.compress(make(good + bad))) == fixed(brute_codes(good))
    assert shown(vq.compress(make(good[:5]))) == fixed(brute_codes(good[:5]))  # fewer vectors than entries
    # beyond 32 bits all is still exact; an error that a long can't hold is null
    huge = [(i, [c * 2**21 for c in v], 1) for i, v, _ in good[:30]] + [(900, [2.0**47] * 16, 3), (901, [-(2.0**47)] * 16, 3)]
    want = [(i, c, e if e < 2**63 else None, t if t < 2**63 else None, h) for i, c, e, t, h in brute_codes(huge)]
    assert shown(vq.compress(make(huge))) == fixed(want)
    wide = [(i, v + v, 1) for i, v, _ in good[:20]]
    both = vq.compress(make(good[:40] + wide)).collect()
    assert len(both) == 60 and len({r["codebooks_sha256"] for r in both}) == 2
    assert vq.compress(make(good).limit(0)).count() == 0


def test_equal_average_search_is_exact():
    draw = np.random.default_rng(1)
    for size in (1, 2, 16):
        x, book = draw.integers(-9, 9, (500, 4)), draw.integers(-9, 9, (size, 4))
        far = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        index, best = vq.equal_average(x, book)
        assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_ranked_search(spark):
    docs, items = corpus()
    docs += [(d, docs[70][1]) for d in (70, 300, 299)]
    counted = [(d, terms_of(t)) for d, t in docs]
    n_docs, total = sum(bool(w) for _, w in counted), sum(len(w) for _, w in counted)
    df = {}
    for _, ws in counted:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    want = []
    for i, t in {(i, t) for i, t in items}:
        scored = []
        for d, ws in counted:
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * ws.count(w) // (1000 * ws.count(w) + 8 * (10 + 90 * len(ws) * n_docs // total))) for w in set(terms_of(t)) & set(ws))
            scored += [(-s, d is None, d)] if s > 0 else []
        want += [(i if i is not None else -1, k + 1, d if d is not None else -1, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:10])]
    shown = lambda out: sorted((r["item_id"] if r["item_id"] is not None else -1, r["rank"], r["doc_id"] if r["doc_id"] is not None else -1, r["score"]) for r in out.collect())
    d, i = docs_of(spark, docs), items_of(spark, items)
    assert shown(ranked.search(d, i)) == sorted(want)
    assert shown(ranked.search(d, i, block_items=15)) == sorted(want)
    assert ranked.search(d.limit(0), i).count() == ranked.search(d, i.limit(0)).count() == 0


def test_neighbours_of_extreme_vectors(spark):
    schema = "vec_id bigint, embedding array<double>"
    for rows in (
        [(0, [1e200, 1e200]), (1, [1e200, -1e200]), (2, [1.0, 1.0]), (3, [1e-200, 2e-200]), (4, [1e308, 1e-308])],
        [(0, [5e-324, 0.0]), (1, [1e-320, 1e-320]), (2, [1.7e308, 1.7e308])],
    ):
        unit = {i: np.ldexp(np.array(v), -np.frexp(max(map(abs, v)))[1]) for i, v in rows}
        cos = lambda a, b: float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
        want = sorted((-cos(unit[0], unit[i]), i) for i, _ in rows[1:])
        vectors = spark.createDataFrame(rows, schema)
        found = ann.nearest(vectors, vectors.filter("vec_id = 0")).orderBy("rank").collect()
        assert [(-r["score"], r["vec_id"]) for r in found] == want

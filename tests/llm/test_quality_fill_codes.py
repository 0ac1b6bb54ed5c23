"""Quality scores, fill-in-the-middle and vector codes against brute force, with their edge cases."""

import hashlib
import random
import re
import time
from collections import Counter
from math import floor, isfinite

import numpy as np
import pytest

from stratalog.llm import codes, fillmiddle, htmltext, quality, simhash, topk, urlfilter

from .test_operators import DOCS, EDGE, table, words_of

# --- 11 quality


def junk(rnd, n):
    w = words_of(rnd, n).split()
    return rnd.choice((" | ".join(w), " ".join(x + rnd.choice(("&&&", "***")) for x in w), " ".join(x.upper() + "!!" for x in w), " ".join(w[0] for _ in w)))


def graded(spark, n=600, seed=5):
    rnd = random.Random(seed)
    good = [rnd.random() < 0.7 for _ in range(n)]
    texts = [". ".join(words_of(rnd, 9).capitalize() for _ in range(4)) if g else junk(rnd, 36) for g in good]
    return table(spark, texts), spark.createDataFrame([(i, int(g)) for i, g in enumerate(good) if i % 3], "doc_id long, quality int"), good


def test_held_out_quality(spark):
    docs, labels, good = graded(spark)
    stats = quality.described(docs).cache()
    got = {r.id: r.score for r in quality.score(stats, quality.fit(stats, labels)).collect()}
    held = {r.doc_id for r in docs.filter(quality.held_out(docs.doc_id)).select("doc_id").collect()}
    import zlib

    assert held == {i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1}
    unseen = [i for i in range(600) if i in held or not i % 3]
    assert sum((got[i] >= 0.5) == good[i] for i in unseen) >= 0.97 * len(unseen)
    again = quality.score(stats, quality.fit(stats, labels.union(labels).union(spark.createDataFrame([(None, 0), (3, None), (10**9, 1)], labels.schema))))
    assert all(abs(got[r.id] - r.score) < 1e-6 for r in again.collect())


def test_normal_equations_are_those_of_all_rows(spark):
    rnd = np.random.default_rng(3)
    n = len(quality.NAMES)
    rows = [(i, [float(x) for x in rnd.normal(size=n)], float(i % 2), i % quality.CALIBRATION) for i in range(300)]
    known = spark.createDataFrame(rows, "id long, stats array<double>, label double, fold int").repartition(7)
    sums = quality._equations(known, np.zeros(n), np.ones(n))
    x, y = quality.features(np.array([r[1] for r in rows]), np.zeros(n), np.ones(n)), np.array([r[2] for r in rows])
    assert np.allclose(sums.sum(axis=0), x.T @ np.column_stack([x, y]))
    fold = np.arange(300) % quality.CALIBRATION == 2
    assert np.allclose(sums[2], x[fold].T @ np.column_stack([x[fold], y[fold]]))


def test_features_approximate_the_kernel():
    rnd = np.random.default_rng(4)
    a = rnd.normal(size=(40, len(quality.NAMES)))
    x = quality.features(a, 0.0, 1.0, n=20_000)[:, 1:]
    gap = ((a[:, None] - a[None]) ** 2).sum(axis=2)
    assert np.abs(x @ x.T - np.exp(-gap / (2 * quality.WIDTH**2))).max() < 0.05


def test_pooling_is_isotonic_regression():
    rnd = np.random.default_rng(6)
    for n in (1, 2, 30, 200):
        s, c = np.arange(n) / n, rnd.integers(1, 5, n).astype(float)
        y = np.minimum(rnd.integers(0, 5, n), c)
        at, share = quality.pooled(s, y, c)
        means = np.interp(s, at, share)
        best = [max(min(y[i : j + 1].sum() / c[i : j + 1].sum() for j in range(k, n)) for i in range(k + 1)) for k in range(n)]  # min-max formula
        assert np.allclose(means, best) and (np.diff(share) >= 0).all()


def test_statistics():
    by = dict(zip(quality.NAMES, quality.statistics("Ab ab ab É9\n||| x&\nAb ab ab É9\n")))
    assert by["capitals of letters"] == 2 / 15 and by["words"] == np.log1p(10) and by["words without a letter"] == 0.1 and by["words that end in a mark"] == 0.2
    assert by["words like the one before"] == 0.2 and by["most frequent word"] == 0.4 and by["lines that repeat"] == 0.25 and by["digits"] == 2 / 31
    assert not quality.statistics(None).any() and not quality.statistics("").any() and np.isfinite(quality.statistics("x" * 10**6)).all()


def test_quality_edges(spark):
    docs = table(spark, EDGE + ["same", "same"], ids=[0, 1, 2, 3, None, 5, 6, 7, 9, 9])
    stats = quality.described(docs).cache()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(stats, quality.fit(stats, none)).collect()} == {0.5}
    for kind in (0, 1):
        ones = spark.createDataFrame([(i, kind) for i in range(10)], none.schema)
        assert all(abs(r.score - kind) < 1e-9 for r in quality.score(stats, quality.fit(stats, ones)).collect())
    mixed = spark.createDataFrame([(i, i % 2) for i in range(10)], none.schema)
    got = quality.score(stats, quality.fit(stats, mixed)).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.id == 9}) == 1 and len({r.score for r in got if r.id in (0, 1)}) == 1
    empty = quality.described(docs.limit(0))
    assert quality.score(empty, quality.fit(empty, mixed)).count() == 0


def test_op11_columns(spark, tmp_path):
    docs, labels, _ = graded(spark, 60)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.withColumnRenamed("quality", "quality").write.parquet(str(tmp_path / "labels.parquet"))
    out = quality.op11_quality_classifier(spark, str(tmp_path))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert all(r.predicted == (r.score >= 0.5) for r in out.collect())


# --- 12 fill in the middle


def told_apart(doc_id, text, seed=7, rate=100, spm=50):
    """The contract, plainly."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(lines)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [*EDGE, "\n", "\n\n\n", "one\ntwo\nthree", "one\r\ntwo\r\n", "ends with <", "<P", "a<\nM>b\n<S", "has <M> inside\n", "é\nß\n漢字\n😀😀\n" * 30, "tab\tx\n" * 500, "<" * 50 + "\n", "same\nrow\n", "same\nrow\n"]
IDS = [*range(len(TEXTS) - 3), None, 77, 77]


def test_fill_in_the_middle(spark, monkeypatch):
    want = Counter()
    for i, t in zip(IDS, TEXTS):
        n, form, p, m, out = told_apart(i, t)
        want[i, n, form, p, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    docs = table(spark, TEXTS, ids=IDS)
    for parts, piece in ((1, 1 << 16), (3, 5)):
        got = Counter(tuple(r) for r in fillmiddle.digests(fillmiddle.pieces(docs.repartition(2, "n_chars", "text"), parts=parts, piece=piece)).collect())
        assert got == want


def test_transformed_texts_restore(spark):
    docs = table(spark, TEXTS, ids=IDS)
    for rules in ({}, {"rate": 40, "spm": 0, "seed": 3}):
        outputs = fillmiddle.transformed(docs, **rules)
        want = Counter((i, told_apart(i, t, **rules)[1], told_apart(i, t, **rules)[4]) for i, t in zip(IDS, TEXTS))
        assert Counter(tuple(r) for r in outputs.collect()) == want
        assert Counter(tuple(r) for r in fillmiddle.restored(outputs).collect()) == Counter((i, t or "") for i, t in zip(IDS, TEXTS))


def test_marks_are_found_across_pieces():
    rnd = random.Random(2)
    for i in range(300):
        text = "".join(rnd.choice("<>PSM\nab") for _ in range(rnd.randrange(40)))
        _, form, p, m, out = told_apart(i, text)
        data = out.encode()
        size = rnd.randrange(1, 7)
        got = ["", "", ""]
        for place, x in fillmiddle.stretches_of((data[k : k + size] for k in range(0, len(data), size)), form):
            got[place] += x.decode()
        assert "".join(got) == text and (form == "plain" or [len(got[0]), len(got[1])] == [p, m])


def test_sorting_again_moves_nothing(spark):
    docs = table(spark, TEXTS, ids=IDS)
    plan = fillmiddle.digests(fillmiddle.pieces(docs, parts=3)).rdd.toDebugString().decode()
    assert plan.count("ShuffledRDD") == 1


def test_rows_that_repeat_are_counted(spark):
    docs = table(spark, ["a\nb\nc\n"] * 500 + [None] * 50, ids=[4] * 500 + [5] * 50)
    pieces = fillmiddle.pieces(docs.repartition(5), parts=4)
    assert pieces.count() <= 550 + 2 * 5 * 6
    got = Counter(r.doc_id for r in fillmiddle.digests(pieces).collect())
    assert got == {4: 500, 5: 50}
    assert fillmiddle.digests(fillmiddle.pieces(docs.limit(0))).count() == 0


# --- 13 vector codes


def coded(rows, parts=8, entries=16, rounds=6):
    """The contract by plain loops over Python's integers: {position of the row: (code, error)}, the codebooks."""
    kept = [(i, k, [floor(4096 * x) for x in v]) for k, (i, v, _) in enumerate(rows) if v is not None and all(x is not None and isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for _, _, v in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(p, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
        return min(range(len(d)), key=lambda k: (d[k], k)), min(d)

    for _ in range(rounds):
        at = [[near(p, c[p])[0] for p in range(parts)] for c in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at) if a[p] == k]
                if own:
                    books[p][k] = [sum(col) // len(own) for col in zip(*own)]
    out = {}
    for (_, pos, _), c in zip(kept, cut):
        found = [near(p, c[p]) for p in range(parts)]
        out[pos] = ("".join(f"{k:02x}" for k, _ in found), min(sum(d for _, d in found), (1 << 63) - 1))
    return out, books


VECTORS = "vec_id long, embedding array<double>, label int, id long, v string, code string, error int, kind int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, -1, "x", "x", 0, 0) for i, v, lab in rows], VECTORS)


def all_codes(spark, rows, **kw):
    blocks, book = codes.learn(codes.quantise(vectors(spark, rows).repartition(3)), **kw)
    return codes.with_label_errors(codes.encode(blocks, book)).collect(), book


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e9])
def test_vector_codes(spark, scale):
    rnd = random.Random(int(scale) + 1)
    rows = [(rnd.randrange(-5, 90), [rnd.gauss(0, scale) for _ in range(16)], rnd.choice((None, 1, 2))) for _ in range(120)]
    rows += [rows[3], rows[4], (None, rows[5][1], 1), (7, None, 1), (8, [0.0] * 15 + [float("nan")], 1), (9, [float("-inf")] + [0.0] * 15, None), (6, [0.0] * 15 + [None], 2)]
    want, books = coded(rows)
    got, book = all_codes(spark, rows)
    by = Counter((rows[k][0], rows[k][2], code, error) for k, (code, error) in want.items())
    assert Counter((r.id, r.label, r.code, r.error) for r in got) == by
    assert book.digest() == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    sums = Counter()
    for k, (_, error) in want.items():
        sums[rows[k][2]] += error
    assert all(r.label_error == min(sums[r.label], (1 << 63) - 1) for r in got)


def test_nearest_by_equal_average():
    rnd = np.random.default_rng(8)
    for top, dim, n in ((4, 1, 16), (3, 8, 16), (3000, 8, 16), (1 << 40, 4, 9), (5, 2, 1)):
        e, x = rnd.integers(-top, top, (n, dim)), rnd.integers(-top, top, (700, dim))
        e[-1] = e[0]
        at, best, computed = codes.nearest(x, e)
        d = ((x[:, None].astype(object) - e[None].astype(object)) ** 2).sum(axis=2)
        assert at.tolist() == [min(range(n), key=lambda k: (row[k], k)) for row in d] and best.tolist() == d.min(axis=1).tolist()
        if dim == 1 or n > 1 and top == 3000:
            assert computed < 0.9 * n * len(x)


def test_few_and_odd_vectors(spark):
    got, book = all_codes(spark, [(5, [0.5, 0.25, 1.0], None), (2, [1.0], 3), (2, [], 3)])  # padded to eight components
    assert {(r.id, r.error) for r in got} == {(5, 0), (2, 0)} and len(book.entries[0]) == 3
    same = [(i, [0.5] * 8, 0) for i in range(40)]
    got, _ = all_codes(spark, same)
    assert {(r.code, r.error, r.label_error) for r in got} == {("00" * 8, 0, 0)}
    huge, _ = all_codes(spark, [(i, [(-1.0) ** i * 1e300] * 8, 1) for i in range(20)], entries=1)
    assert {r.error for r in huge} == {(1 << 63) - 1} == {r.label_error for r in huge}
    none, book = all_codes(spark, [(1, None, 1)])
    assert none == [] and book.digest() == hashlib.sha256(b"").hexdigest()
    assert all_codes(spark, [(1, [], 1)])[0][0].error == 0


def test_codes_decode(spark):
    rows = [(i, [float(i % 7), float(i % 3)] * 4, 0) for i in range(50)]
    blocks, book = codes.learn(codes.quantise(vectors(spark, rows)))
    back = {r.id: r.v for r in codes.decode(codes.encode(blocks, book), book).collect()}
    errors = {r.id: r.error for r in codes.encode(blocks, book).collect()}
    for i, v, _ in rows:
        assert sum((a - floor(4096 * b)) ** 2 for a, b in zip(back[i], v)) == errors[i]


# --- rows without an id between others, queries that repeat an id


def test_null_ids_link_others(spark, monkeypatch):
    c = 0x0123456789ABCDEF
    rows = [(5, c), (None, c ^ 3), (9, c ^ 15), (None, c ^ (0xFFFF << 40)), (7, c ^ (0xFF << 20)), (7, c ^ (0xFF << 20))]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.select("id", "fp"))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "id long, fp long")).collect()
    assert Counter((r.id, r.component) for r in got) == Counter([(5, 5), (None, 5), (9, 5), (None, None), (7, 7), (7, 7)])


def test_queries_that_repeat_an_id(spark):
    rnd = np.random.default_rng(17)
    v = rnd.normal(0, 0.3, (60, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(50, rnd.normal(0, 0.3, 8).tolist()), (50, v[50].tolist()), (0, v[0].tolist())]
    vec = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).cache()
    ints = [(i, [floor(256 * a) for a in x]) for i, x in rows]
    want = Counter()
    for k, (q, x) in enumerate(ints):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), c) for j, (c, y) in enumerate(ints) if j != k)[:5]
            want.update((q, n + 1, c, -s) for n, (s, c) in enumerate(best))
    assert Counter(tuple(r) for r in topk.top_k(vec.filter("id % 50 = 0"), vec).collect()) == want and sum(want.values()) == 25


# --- pages


def test_pages_of_many_open_and_stray_tags():
    began = time.time()
    for page in ("<div>" * 60_000 + "</span>" * 60_000 + "text", "<td><div>" * 30_000 + "<p>x</i>" * 60_000, "</p>" * 200_000):
        htmltext.main_text(page)
    assert time.time() - began < 10


def test_what_stands_in_an_article_and_what_does_not():
    said = "It is the one and it was so, as they have had it. "
    page = f"<article><p>{said * 4}Let <math><mi>x</mi></math> be in <object>the plot</object>.</p><div class='reader-feedback'><p>{said * 5}</p></div><form><p>{said * 5}</p></form></article>"
    assert htmltext.main_text(page) == f"{said * 4}Let x be in the plot."
    assert htmltext.main_text(f"<form><article><p>{said * 9}</p></article></form>") == (said * 9).strip()  # a page may be one form


def test_deep_paths(spark):
    rows = [(1, "http://a.org/" + "/".join("abcdefghij"[k % 10] for k in range(3000))), (2, "http://b.net/x"), (3, "http://a.org/a/b")]
    found = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"))
    assert {r.id: (r.verdict, r.template.count("/")) for r in found.collect()} == {1: ("block", 3000), 2: ("block", 1), 3: ("block", 2)}

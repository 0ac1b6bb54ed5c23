"""Corpus operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from stratalog.llm import automaton, common, decontaminate, htmltext, mixing, pii, secrets, simhash, tokens, topk, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, row string, size string, words string, label string, spans string"


def table(spark, texts, ids=None, source=None):
    """Documents with extra columns whose names the operators use inside."""
    rows = [(i if ids is None else ids[i], t, None, (source or (lambda k: f"s{k % 3}"))(i), None, -i, "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words_of(rnd, n, vocabulary=200):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


EDGE = [None, "", " ", "a", "A a", "é" * 50, "word " * 30_000, "x" * 100_000]


# --- 1 token counts


def test_scan_of_flat_files(spark, tmp_path):
    rnd = np.random.default_rng(1)
    want = {}
    for name, end_last in (("a.bin", True), ("b.bin", False), ("empty.bin", True)):
        sizes = [] if name == "empty.bin" else [0, 3, 5000, 0, 1, 17, 2500, 9]
        flat = []
        for k, n in enumerate(sizes):
            flat += [rnd.integers(0, 50256, n), [50256] if end_last or k < len(sizes) - 1 else []]
        data = np.concatenate([np.zeros(0), *map(np.asarray, flat)]).astype("<u2")
        (tmp_path / name).write_bytes(data.tobytes())
        want[name] = sizes
    for block in (7, 1000, 1 << 18):
        got = {}
        for r in tokens.scan(tokens.read_token_files(spark, str(tmp_path), block=block)).orderBy("file", "number").collect():
            got.setdefault(r.file.rsplit("/", 1)[-1], []).append((r.number, r.start, r.n_tokens, r.ended))
        for name in ("a.bin", "b.bin"):
            starts = np.concatenate(([0], np.cumsum(np.array(want[name]) + 1)))[:-1]
            assert got[name] == [(k, int(s), n, name == "a.bin" or k < 7) for k, (s, n) in enumerate(zip(starts, want[name]))]
        assert "empty.bin" not in got


def test_many_blocks_meet_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(tokens, "GROUP", 4)
    stream = np.array(([5] * 10 + [50256]) * 40, "<u2")
    blocks = [("f", k, stream[a : a + 13].tobytes(), None) for k, a in enumerate(range(0, len(stream), 13))]
    out = tokens.scan(spark.createDataFrame(blocks, "file string, block long, data binary, ids array<long>")).collect()
    assert sorted((r.number, r.start, r.n_tokens) for r in out) == [(k, 11 * k, 10) for k in range(40)]


def test_token_counts_equal_the_tokenizer(spark):
    texts = [*EDGE, "Hello world, ça va?", "a\nb"]
    docs = table(spark, texts).union(table(spark, texts[:3]))
    got = Counter((r.id, r.n_tokens) for r in tokens.scan(tokens.encode(docs, block=1000)).collect())
    bpe = tokens.encoder(*tokens.vocabulary())
    want = [(i, len(bpe.encode_ordinary(t or ""))) for i, t in enumerate(texts)]
    assert got == Counter(want + want[:3])
    assert tokens.scan(tokens.encode(table(spark, []))).count() == 0


def test_files_written_once_and_read_in_blocks(spark, tmp_path):
    rnd = random.Random(63)
    texts = [*EDGE[:6], *(words_of(rnd, rnd.randrange(3000)) for _ in range(30))]
    docs = table(spark, texts).repartition(3)
    folder = f"file://{tmp_path}/flat"
    bpe = tokens.encoder(*tokens.vocabulary())
    sizes = sorted(len(bpe.encode_ordinary(t or "")) for t in texts)
    assert tokens.save_token_files(tokens.encode(docs, block=500), folder) == sum(sizes) + len(sizes)
    for block in (100, 1 << 18):
        assert sorted(r.n_tokens for r in tokens.scan(tokens.read_token_files(spark, f"{tmp_path}/flat", block=block)).collect()) == sizes
    (tmp_path / "odd.bin").write_bytes(np.array([1, 2, 50256, 3], "<u4").tobytes() + b"x")
    assert sorted((r.start, r.n_tokens, r.ended) for r in tokens.scan(tokens.read_token_files(spark, f"{tmp_path}/odd.bin", width=4, block=3)).collect()) == [(0, 2, True), (3, 1, False)]


def test_end_and_ids(spark):
    with pytest.raises(ValueError):
        tokens.encode(table(spark, ["a"]), end=50255)
    wide = tokens.scan(tokens.encode(table(spark, ["a b", "c"], ids=[None, 3]), end=100_000), end=100_000).collect()
    assert sorted((r.id or -1, r.n_tokens) for r in wide) == [(-1, 2), (3, 1)]


# --- 2 pages


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<html></html>", ""), ("<p>a &amp; b&nbsp; c\n d", "a & b c d"), ("<article><p>No.<p>Yes.</article>", "No.\nYes."),
    ("<nav>m</nav><main><h1>T</h1><p>x</p></main><footer>f</footer>", "T\nx"), ("<article><p>x<script>a<b</script>y<!-- z --></p><style>q</style></article>", "x y"),
    ("<article><div class='ad'>buy</div><p>x</p><div id=comments><article><p>nice</p></article></div></article>", "x"),
    ("<div class='page has-sidebar'><header>h</header><div class='sidebar-layout'><article><p>x</p></article></div></div>", "x"),
    ("<article><p title='a>b'>x</p><p hidden>no</p><p style='display:none'>no</p><form>f</form></article>", "x"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"), ("<article><p>cut <b", "cut"), ("<article><p>a &lt;b&gt; &am", "a <b> &am"),
    ("<article>one<br>two<br><br>three</article>", "one two\nthree"), ("<article><p>x</p><aside>s</aside><p>y</article>", "x\ny"), ("<article><p>1 < 2 and <3</p></article>", "1 < 2 and <3"),
])
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


def test_blocks_without_an_article():
    good = "the cat of the house and the dog in the garden is on a wall that was built by her. " * 4
    page = f"<div>Home | Login</div><h2>Title</h2><p>{good}</p><p>Short.</p><p>{good}</p><div class=footer>c</div><p>zq xv kp {'zxq ' * 80}</p><p>tail</p>"
    assert htmltext.main_text(page) == "\n".join(["Title", good.strip(), "Short.", good.strip()])


GOOD_TEXT = ("the cat of the house and the dog in the garden is on a wall that was built by her. " * 4).strip()


@pytest.mark.parametrize("name", ["post comments-open", "article ad-free", "content has-social-share", "story related-topic", "entry search-result", "main-content login-required", "single-post has-sidebar nav-above", "page-template widget-ready"])
@pytest.mark.parametrize("tag", ["div", "article", "section", "main"])
def test_names_of_what_holds_an_article(tag, name):
    for attribute in ("class", "id"):
        inner = f"<h1>T</h1><p>{GOOD_TEXT}</p><p>x</p><p>{GOOD_TEXT}</p>"
        assert htmltext.main_text(f"<body><nav>m</nav><{tag} {attribute}='{name}'>{inner}</{tag}></body>") == f"T\n{GOOD_TEXT}\nx\n{GOOD_TEXT}"
        assert htmltext.main_text(f"<div {attribute}='{name}'><article>{inner}</article></div>") == f"T\n{GOOD_TEXT}\nx\n{GOOD_TEXT}"


@pytest.mark.parametrize("out", [
    "<div class='sidebar'><p>{t}</p></div>", "<div class='left-sidebar widget'>{t}</div>", "<aside>{t}</aside>", "<div class=cookie-notice>{t}</div>", "<div class='site-footer'>{t}</div>", "<section class='comments'><p>{t}</p></section>",
    "<ol class='commentList'><li>{t}</ol>", "<div id=disqus_thread>{t}</div>", "<form><p>{t}</p></form>", "<div role=alert>{t}</div>", "<div class='ad-slot google'>{t}</div>", "<div class='newsletter-signup'>{t}</div>", "<div class=related-posts><article><p>{t}</p></article></div>",
    "<nav>{t}</nav>", "<div class=share-buttons>{t}</div>", "<div id='comments' class='post-comments'><article class=comment>{t}</article></div>", "<!-- {t} -->", "<script>var a = '<p>{t}</p>'</script>", "<div style='display: none'>{t}</div>",
])
def test_what_goes_inside_and_outside_of_an_article(out):
    out = out.replace("{t}", GOOD_TEXT.replace("cat", "rat"))
    assert htmltext.main_text(f"<body><article><h1>T</h1><p>{GOOD_TEXT}</p>{out}<p>x</p></article></body>") == f"T\n{GOOD_TEXT}\nx"
    assert htmltext.main_text(f"<body><article><h1>T</h1><p>{GOOD_TEXT}</p></article>{out}</body>") == f"T\n{GOOD_TEXT}"
    if "form" not in out:
        assert htmltext.main_text(f"<body><h1>T</h1><p>{GOOD_TEXT}</p>{out}<p>{GOOD_TEXT}</p></body>") == f"T\n{GOOD_TEXT}\n{GOOD_TEXT}"


def test_links_and_other_scripts_stay():
    cjk = "\u4eca\u65e5\u306f\u5929\u6c17\u304c\u3088\u3044\u3002" * 42
    assert htmltext.main_text(f"<body><nav>m</nav><p>{cjk}</p><p>{cjk}</p></body>") == f"{cjk}\n{cjk}"
    page = f"<article><h1><a href=x>Title</a></h1><p>{GOOD_TEXT}</p><p><a href=y>{GOOD_TEXT}</a></p><ul><li><a>one</a><li><a>two</a></ul><h2 id=search>Search</h2><section id='related-work'><p>w</p></section></article>"
    assert htmltext.main_text(page) == f"Title\n{GOOD_TEXT}\n{GOOD_TEXT}\none\ntwo\nSearch\nw"
    assert htmltext.main_text(f"<form id=aspnetForm><div><p>{GOOD_TEXT}</p></div></form>") == GOOD_TEXT
    assert htmltext.main_text(f"<form><div><article><p>{GOOD_TEXT}</p></article></div></form>") == GOOD_TEXT
    assert htmltext.main_text("<nav>m</nav><form><label>Name</label><p>Send</p></form>") == ""
    menu = "".join(f"<li><a>entry {k}</a>" for k in range(9))
    assert htmltext.main_text(f"<div><ul>{menu}</ul></div><h2><a>Title</a></h2><p>{GOOD_TEXT}</p><div><ul>{menu}</ul></div>") == f"Title\n{GOOD_TEXT}"


def plain_second_pass(labels, headings, marked):
    """The rules of the second pass, block by block over all others."""
    n, kept = len(labels), []
    decided = {k: x for k, x in enumerate(labels) if x}
    if not marked:
        decided |= {-1: -1, n: -1}
    for k, label in enumerate(labels):
        below = [j for j in decided if k < j < n]
        if headings[k] and below and labels[min(below)] == 1 and min(below) - k <= 2:
            kept.append(True)
        elif label:
            kept.append(label == 1)
        elif 1 not in labels:
            kept.append(True)
        else:
            # beyond the ends of an unmarked page lies outside, as far as the last decided block or the end
            left, right = [j for j in decided if -1 < j < k], below
            a, b = (max(left) if left else -1), (min(right) if right else n)
            la, lb = decided.get(a, 0), decided.get(b, 0)
            near = {x for x, d in ((la, k - a), (lb, b - k)) if x and d == min(d2 for x2, d2 in ((la, k - a), (lb, b - k)) if x2)} if la or lb else set()
            kept.append(not near or (1 in near if marked else near == {1}))
    return kept


def test_second_pass_equals_a_plain_one():
    rnd = random.Random(15)
    for _ in range(4000):
        n = rnd.randrange(9)
        labels, headings, marked = [rnd.choice([1, 0, 0, -1]) for _ in range(n)], [rnd.random() < 0.2 for _ in range(n)], rnd.random() < 0.5
        if marked:
            labels = [max(x, 0) for x in labels]
        assert htmltext.second_pass(labels, headings, marked) == plain_second_pass(labels, headings, marked), (labels, headings, marked)


def test_long_and_broken_pages():
    assert len(htmltext.main_text("<article>" + f"<p>{GOOD_TEXT}</p>" * 5000)) == 5000 * (len(GOOD_TEXT) + 1) - 1
    assert htmltext.main_text("<div>" * 20_000 + "x") == "x" and htmltext.main_text("<article " + "a='" * 5000) == ""
    assert htmltext.main_text("<p>" + "x" * 300_000) == "x" * 300_000


def test_extract_keeps_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "old"), (2, None, None, None), (2, None, None, None)], "page_id long, url string, html string, text string")
    out = htmltext.extract(pages)
    assert Counter(map(tuple, out.collect())) == Counter([(1, "u", "x"), (2, None, ""), (2, None, "")])
    assert htmltext.extract(pages.limit(0)).count() == 0


# --- 3 decontamination


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(3)
    items = {k: words_of(rnd, n, 40) for k, n in enumerate([12, 10, 9, 1, 3, 25, 0, 11])} | {100: None, 101: "The, CAT! é"}
    texts = [words_of(rnd, 300, 40) for _ in range(30)] + [*EDGE, f"x {items[0]} y", f"{items[5]} {items[5]}", f"AB {items[2].upper()}", "the cat é the cat é", "THE CAT É"]
    docs, bench = table(spark, texts + texts[-3:]), spark.createDataFrame([*items.items(), (None, "w1 w2")], "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {k: {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if (w := split(t)) else set() for k, t in items.items()}

    def want(t):
        w, hit, found = split(t), set(), set()
        for k, ws in windows.items():
            for x in ws:
                for i in range(len(w) - len(x) + 1):
                    if tuple(w[i : i + len(x)]) == x:
                        hit.update(range(i, i + len(x)))
                        found.add(str(k))
        return len(w), len(hit), tuple(sorted(found))

    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.decontaminate(docs, bench).collect())
    assert got == Counter((i, *want(t)) for i, t in enumerate(texts + texts[-3:]))
    assert decontaminate.decontaminate(docs, bench.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "broadcast_if_small", lambda df: common.broadcast_if_small(df, 5))
    rnd = random.Random(4)
    item = words_of(rnd, 30)
    out = decontaminate.decontaminate(table(spark, [f"a b {item} c", "none", f"{item} {item}"]), spark.createDataFrame([(7, item), (8, item)], "item_id long, text string"))
    assert sorted((r.doc_id, r.n_hit, r["items"]) for r in out.collect()) == [(0, 30, ["7", "8"]), (1, 0, []), (2, 60, ["7", "8"])]


def test_proximity(spark):
    docs = table(spark, ["a x x b", "b a", "a x x x x b", "c"])
    index = decontaminate.build_index(decontaminate.numbered(docs), spark.createDataFrame([("a",), ("b",)], "term string"))
    out = decontaminate.proximity_matches(index, spark.createDataFrame([("a", "b")], "a string, b string"), within=3)
    assert sorted((r.doc_id, r.pos, r.gap) for r in out.collect()) == [(0, 0, 3), (1, 1, -1)]


def test_proximity_equals_brute_force(spark):
    rnd = random.Random(14)
    texts = [words_of(rnd, 60, 12) for _ in range(20)]
    terms = [f"w{k}" for k in range(5)]
    index = decontaminate.build_index(decontaminate.numbered(table(spark, texts)), spark.createDataFrame([(t,) for t in terms], "term string"))
    pairs = [(a, b) for a in terms for b in terms[:3]]
    out = decontaminate.proximity_matches(index, spark.createDataFrame(pairs, "a string, b string"), within=4)
    want = set()
    for i, t in enumerate(texts):
        w = t.split()
        for p, x in enumerate(w):
            for a, b in pairs:
                gaps = [g for g in sorted(range(-4, 5), key=lambda g: (abs(g), g)) if g and 0 <= p + g < len(w) and w[p + g] == b]
                if x == a and gaps:
                    want.add((i, a, b, p, gaps[0]))
    assert {(r.doc_id, r.a, r.b, r.pos, r.gap) for r in out.collect()} == want


# --- 4 SimHash


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(codes):
    up = list(range(len(codes)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(codes)):
        for b in range(a):
            if bin(codes[a] ^ codes[b]).count("1") <= 2:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(len(codes))]


def test_simhash_equals_brute_force(spark):
    rnd = random.Random(5)
    base = [words_of(rnd, 400) for _ in range(8)]
    texts = [*EDGE, "one two", "ONE two"]
    for b in base:
        for _ in range(6):
            w = b.split()
            w[rnd.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    docs = table(spark, texts).union(table(spark, texts[:2])).union(table(spark, ["null id"], ids=[None]))
    got = simhash.near_duplicates(docs).collect()
    codes = [plain_fingerprint(t) for t in texts]
    parts = plain_components(codes)
    want = Counter((i, codes[i], parts[i]) for i in [*range(len(texts)), 0, 1])
    assert Counter((r.id, r.fp & (1 << 64) - 1, r.component) for r in got if r.id is not None) == want
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert Counter(kept) == Counter([*set(parts), None])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_and_components_of_planted_codes(spark):
    rnd = random.Random(6)
    codes = []
    for _ in range(20):  # chains of close codes, and pairs at distance three
        c = rnd.getrandbits(64)
        codes.append(c)
        for _ in range(5):
            for _ in range(rnd.choice([1, 2, 2, 3])):
                c ^= 1 << rnd.randrange(64)
            codes.append(c)
    codes = list(dict.fromkeys(codes))
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    edges = simhash.links(spark.createDataFrame(list(enumerate(signed)), "node long, fp long"))
    assert all(bin(codes[r.a] ^ codes[r.b]).count("1") <= 2 for r in edges.collect())
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    assert [got.get(i, i) for i in range(len(codes))] == plain_components(codes)


@pytest.mark.parametrize(("segments", "bucket"), [(2, 64), (2, 3), (3, 64), (4, 2)])
def test_segments_and_buckets_change_no_connection(spark, segments, bucket):
    rnd = random.Random(60)
    codes = [rnd.getrandbits(64) for _ in range(30)]
    for c in codes[:6]:  # large groups: one segment alike, both near, chains
        codes += [c ^ (1 << rnd.randrange(32)) ^ (1 << rnd.randrange(32)) for _ in range(12)] + [c ^ (1 << rnd.randrange(64)) for _ in range(12)]
        codes += [c ^ rnd.getrandbits(32) << 32 for _ in range(8)]
    codes = list(dict.fromkeys(codes))
    rows = [(i, simhash._signed(c)) for i, c in enumerate(codes)]
    edges = simhash.links(spark.createDataFrame(rows, "node long, fp long"), segments=segments, bucket=bucket)
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    assert [got.get(i, i) for i in range(len(codes))] == plain_components(codes)


def test_radii_cover_every_split_of_the_bits():
    assert [simhash.radii(2, s) for s in (2, 3, 4)] == [[1, 0], [0, 0, 0], [0, 0, 0, -1]] and simhash.radii(6, 4) == [1, 1, 1, 0]


def test_hot_keys_are_dealt_over_parts(spark):
    rows = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(300)], "id long, fp long")
    counted = rows.groupBy("fp").count().withColumnRenamed("count", "rows_of_key").withColumn("said", common.F.col("fp") * 2)
    out = common.join_counted(rows, counted, ["fp"], most=10).collect()
    assert sorted((r.id, r.fp, r.said) for r in out) == [(i, 7 if i % 3 else i, 14 if i % 3 else 2 * i) for i in range(300)]


# --- 5 toxicity


def labelled(spark, n=600):
    rnd = random.Random(7)
    texts, labels = [], []
    for i in range(n):
        w = words_of(rnd, rnd.randrange(20, 200), 800).split()
        kind = i % 4
        if kind == 0:
            w.insert(rnd.randrange(len(w)), rnd.choice(["Dolt", "oaf", "pestling", "pestoid", "pestern"]))
        elif kind == 1:  # either word alone is harmless, both are not
            w += ["grubs", "northerners"]
        elif kind == 2:
            w.append(rnd.choice(["grubs", "northerners"]))
        texts.append(" ".join(w))
        labels.append((i, 0, int(kind in (0, 1))))
    return table(spark, texts), spark.createDataFrame(labels + [(0, None, None), (None, 0, 1), (10**6, 0, 1)], "doc_id long, quality int, toxic int"), dict((i, t) for i, _, t in labels)


def test_toxicity_held_out_and_pairs(spark):
    docs, labels, truth = labelled(spark)
    machine = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, machine).withColumn("held", toxicity.held_out(toxicity.F.col("id"))).collect()
    held = [r for r in rows if r.held]
    assert {r.id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum((r.score >= 0.5) == bool(truth[r.id]) for r in held)
    assert right / len(held) > 0.97
    f = machine.scorer()
    assert f("a northerners") < 0.5 and f("a grubs") < 0.5 < f("grubs and northerners") and f("OAF") > 0.5 and 0 <= f(None) < 0.5 and f("") == f(None)
    assert f("z " * 50_000 + "dolt") > 0.5 and f(" ".join(f"q{i}" for i in range(30_000))) < 0.5
    kept = toxicity.drop_toxic(docs.union(docs.limit(1)), labels)
    assert kept.columns == docs.columns and {truth[r.doc_id] for r in kept.select("doc_id").collect()} >= {0}


def test_scores_equal_a_plain_machine(spark):
    docs, labels, _ = labelled(spark)
    m = toxicity.fit(docs, labels)
    texts = [*EDGE, "Dolt!", "grubs northerners", *(r.text for r in docs.limit(60).collect())]
    got = {r.id: r.score for r in toxicity.score(table(spark, texts), m).collect()}
    for i, t in enumerate(texts):
        own = set()
        for x in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+", (t or "").lower()):
            for name in [x, *(x[:n] + "*" for n in (4, 5, 6) if len(x) > n)]:
                if (slot := xxhash.xxh64_intdigest(name.encode(), 7) % (1 << 60)) in m.at:
                    own.add(m.at[slot])
        own = sorted(own)
        z = m.bias + sum(m.w[f] for f in own) + sum(float(m.v[a] @ m.v[b]) for k, a in enumerate(own) for b in own[:k])
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9, t


def test_rows_to_fit_on_are_bounded(spark):
    docs, labels, _ = labelled(spark, 40)
    texts = [r.text for r in docs.collect()]
    many = table(spark, texts * 3 + [f"other {k}" for k in range(200)], ids=[*range(40)] * 3 + [7] * 200)
    rows = toxicity.labelled(many, labels, sample=50).collect()
    assert len(rows) == 50 and len({(r.id, r.text) for r in rows}) == 50
    assert len(toxicity.labelled(many, labels, sample=10_000).filter("id <> 7").collect()) == len({i for i in range(40) if i != 7 and zlib.crc32(str(i).encode()) % 5})


def test_toxicity_without_labels(spark):
    docs, labels, _ = labelled(spark, 8)
    m = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(table(spark, EDGE), m).filter("score >= 0 and score <= 1").count() == len(EDGE)
    assert toxicity.score(docs.limit(0), m).count() == 0


# --- 6 secrets

_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(t):
    t = t or ""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 32]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def secret_texts(n=3000):
    rnd = random.Random(8)
    bits = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", ":", "=", " ", '"', "'", "abc", "deadbeef", "0123456789", "AKIA", "AKI", "XYZ0", "é", "\n", "a" * 36, "+", "."]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) for _ in range(n)] + [*EDGE, "token=" * 5000, "token=password:secret=abcdefgh"]


def test_secrets_equal_brute_force():
    texts = secret_texts()
    found = secrets.scan_texts(pa.array(texts, pa.string()), secrets.automaton())
    for i, t in enumerate(texts):
        assert [s for s in found.get(i, []) if s[2] in secrets.KINDS[:3]] == plain_secrets(t), t[:200]


def plain_more(t):
    """Tokens by Python's regular expressions, and keys with an END line or without any body."""
    out = [(m.start(), m.end(), "github") for m in re.finditer("gh[pousr]_[A-Za-z0-9]{36,}", t)] + [(m.start(), m.end(), "slack") for m in re.finditer("xox[abprs]-[A-Za-z0-9-]{10,}", t)]
    heads = list(re.finditer("-----BEGIN ([A-Z ]*PRIVATE KEY-----)", t))
    for m, most in zip(heads, [*(h.start() for h in heads[1:]), len(t)]):
        at = t.find("-----END " + m[1], m.end(), most)
        out.append((m.start(), m.end() if at < 0 else at + 9 + len(m[1]), "pem"))
    return sorted(out)


def test_more_kinds_equal_brute_force():
    rnd = random.Random(64)
    bits = ["ghp_", "gho_", "gh", "_", "xoxb-", "xox", "a1B2" * 9, "Z9" * 5, "k", " ", "\n", ".", "-----BEGIN ", "-----END ", "RSA ", "PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "é", "-"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(30))) for _ in range(4000)]
    found = secrets.scan_texts(pa.array(texts), secrets.automaton())
    for i, t in enumerate(texts):
        if not re.search(r"KEY-----(?:\s|\\[rn])+>?\x20?[A-Za-z0-9+/=]{16}", t):
            assert sorted(s for s in found.get(i, []) if s[2] not in secrets.KINDS[:3]) == plain_more(t), t


def test_pieces_are_cut_anywhere():
    import time

    rnd = random.Random(65)
    words = [rnd.choice(["token", "akia", "deadbeef", "word", "7", "zz"]) for _ in range(300_000)]
    spent = {}
    for gap in (" ", ", ", ""):
        text = gap.join(words) + gap + "".join(f"password={'x' * 9}{gap or ' '}AKIA{'Q' * 20}{gap or ' '}{'0f' * 20}{gap or ' '}" for _ in range(50))
        began = time.process_time()
        found = secrets.scan_texts(pa.array([text, "x", text]), secrets.automaton())
        spent[gap] = (time.process_time() - began) / len(text)
        assert [s for s in found[0] if s[2] in secrets.KINDS[:3]] == plain_secrets(text) and found[0] == found[2] and 1 not in found
    assert spent[" "] < 2 * spent[", "] + 1e-8 and spent[""] < 3 * spent[", "] + 1e-8
    for run in ("token=" + "A" * 3_000_000, "AKIA" + "7" * 3_000_000, "f" * 3_000_000, "token" + " " * 3_000_000 + "=abcdefgh", "xoxb-" + "-" * 3_000_000):
        began = time.process_time()
        assert len(secrets.scan_texts(pa.array([run]), secrets.automaton())[0]) >= 1 and time.process_time() - began < 3


@pytest.mark.parametrize("pattern", ["ab{2,3}c", "[^a-c]x?d", "(a|bc)d", "[0-9a-f]{4}"])
@pytest.mark.parametrize("piece", [1, 3, 50])
def test_cuts_change_nothing(pattern, piece):
    rnd = random.Random(66)
    scanner = automaton.compile_rules([(pattern, False)])
    texts = ["".join(rnd.choice("abcdxf0\n") for _ in range(rnd.randrange(60))).encode() for _ in range(100)]
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1])).astype(np.int64)
    places, _ = scanner.events(data, starts, piece=piece)
    want = [int(s) + e for t, s in zip(texts, starts) for e in range(len(t)) if any(re.compile(pattern.encode()).fullmatch(t, b, e + 1) for b in range(e + 1))]
    assert places.tolist() == want


def test_more_kinds_and_redaction(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----"
    texts = [f"é {key} x", "ghp_" + "a1" * 18 + " end", "xoxb-" + "1" * 12, "ghp_short", None, "token=abcdefgh12 and password='secret_value_1'", ""]
    out = secrets.redact(table(spark, texts))
    assert out.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {0: "é [SECRET] x", 1: "[SECRET] end", 2: "[SECRET]", 3: "ghp_short", 4: None, 5: "[SECRET] and [SECRET]'", 6: ""}
    assert secrets.find_secrets(table(spark, [])).count() == 0


@pytest.mark.parametrize("pattern", ["ab*c", "(a|bc)+d", "[^a-c]x?", "a{2,3}b", "x(y|z)?w", "[0-9a-f]{4}", "a.c"])
def test_automaton_against_re(pattern):
    rnd = random.Random(9)
    scanner = automaton.compile_rules([(pattern, False)])
    for _ in range(200):
        t = "".join(rnd.choice("abcdxyzw0f\n") for _ in range(30)).encode()
        places, _ = scanner.events(np.frombuffer(t, np.uint8), np.array([0]), piece=5)
        whole = re.compile(pattern.encode())
        want = [e for e in range(len(t)) if any(whole.fullmatch(t, s, e + 1) for s in range(e + 1))]
        assert places.tolist() == want


# --- 7 mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}
    rest, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = rest / sum(weight[n] for n in free)
        over = [n for n in free if level * weight[n] > 2 * sizes[n]]
        if not over:
            return out | {n: level * weight[n] for n in free}
        for n in over:
            out[n] = 2 * sizes[n]
            rest -= out[n]
            free.discard(n)
    return out


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    rnd = random.Random(10)
    texts = [words_of(rnd, rnd.choice([0, 1, 5, 30, 400])) for _ in range(900)] + [None, ""]
    source = lambda i: "hot" if i % 3 == 0 else [None, "b", "c", "é"][i % 4]
    docs = table(spark, texts, source=source).repartition(5)
    rows = mixing.mix(docs).collect()
    count = {i: len((t or "").split()) for i, t in enumerate(texts)}
    sizes = Counter()
    for i, n in count.items():
        sizes[source(i)] += n
    goal, taken = plain_targets(sizes), Counter()
    for r in rows:
        assert r["size"] == count[r.id] and r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 * r.target and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert len(rows) == len(texts) and all(abs(taken[s] - goal[s]) < 0.01 * goal[s] for s in goal)
    again = mixing.mix(table(spark, texts, source=source).repartition(2).orderBy("n_chars")).collect()
    assert {(r.id, r.taken) for r in rows} == {(r.id, r.taken) for r in again}


def test_mix_edges(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(table(spark, [None, "", " "])).collect()] == [0, 0, 0]
    twice = table(spark, ["a b c", "d e"]).union(table(spark, ["a b c", "d e"]))
    assert mixing.mix(twice).count() == 4


def test_running_sums(spark):
    rows = [(k, (k * 7) % 40 if k % 9 else None) for k in range(200)]
    out = common.running(spark.createDataFrame(rows, "k long, v long"), ["v", "k"], {"n": common.F.lit(1), "s": common.F.coalesce("v", common.F.lit(0))}).collect()
    before = 0
    for place, r in enumerate(sorted(out, key=lambda r: (r.v is not None, r.v or 0, r.k))):
        assert (r.n, r.s) == (place, before)
        before += r.v or 0


def test_rows_that_repeat_each_other_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 32)
    docs = table(spark, ["a b c"] * 400 + ["d e"] * 50, ids=[None] * 200 + [5] * 200 + list(range(50)), source=lambda i: "hot" if i < 400 else "z")
    sizes = mixing._told_apart(docs.selectExpr("monotonically_increasing_id() row", "doc_id id", "source", "3L size", "0.5D pi")).groupBy("id", "source").agg({"nth": "max"}).collect()
    assert {(r.id, r.source): r[2] for r in sizes}.items() >= {(None, "hot"): 199, (5, "hot"): 199, (7, "z"): 0}.items()
    taken = Counter()
    for r in mixing.mix(docs, keep=("lang",)).collect():
        taken[r.source] += r.taken
    goal = plain_targets({"hot": 1200, "z": 100})
    assert all(abs(taken[k] - goal[k]) <= 3 for k in goal)


def test_flight_keeps_totals():
    rnd = np.random.default_rng(11)
    x = rnd.integers(0, 1000, 500)
    pi = rnd.random(500)
    out = mixing.flight(pi, x, rnd.random(500))
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2 and abs(out.sum() - pi.sum()) < 1e-6 and abs(out @ x - pi @ x) < 1e-3


# --- 8 personal data


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_personal(t):
    t = t or ""
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.BASE.index(s[2])))


def test_personal_data_equals_brute_force(spark):
    rnd = random.Random(12)
    bits = ["a.b", "@", "mail", ".com", "_", "1", "25", "256", ".", "4539578763621486", " ", "-", "+1 (988) 555-2485", "é", "\n", "192.168.0.1", "007", "x@y.z", "+", "(", ")", "9" * 13]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(25))) for _ in range(1500)] + [*EDGE, "1" * 50_000, "a@b.c " * 3000, "1.2.3.4.5.6.7.8"]
    docs = table(spark, texts).union(table(spark, ["x@y.z", None], ids=[None, None]))
    for r in pii.find_personal_data(docs).collect():
        if r.id is not None:
            assert [(s.start, s.end, s.kind) for s in r.spans if s.base] == plain_personal(texts[r.id]), texts[r.id][:200]
            assert [(s.start, s.kind_no) for s in r.spans] == sorted((s.start, s.kind_no) for s in r.spans)
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def luhn_number(rnd, n=16, first="4"):
    body = first + "".join(str(rnd.randrange(10)) for _ in range(n - 2))
    return body + next(c for c in "0123456789" if luhn(body + c))


def personal_texts(n=500, seed=61):
    """Texts with planted base and loose spans and with decoys, and the places of the loose ones."""
    rnd = random.Random(seed)
    d = lambda k: "".join(str(rnd.randrange(10)) for _ in range(k))
    w = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 8)))
    four = lambda t, gap: gap.join(t[k : k + 4] for k in range(0, len(t), 4))
    base = [lambda: f"{w()}.{d(2)}@{w()}.example.com", lambda: f"+1 ({d(3)}) 555-{d(4)}", lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)), lambda: luhn_number(rnd)]
    loose = {
        "mail_like": lambda: rnd.choice(["{} [at] {} [dot] org", "{}(at){}.example.com", "{} @ {}.net", "{}é@{}ü.example.de"]).format(w(), w()), "card_like": lambda: four(luhn_number(rnd, first=rnd.choice("3456")), rnd.choice([".", "_", "  ", " / "[1]])),
        "number_like": lambda: rnd.choice([f"(98{d(1)}) 555-{d(4)}", f"030 {d(4)} {d(4)}", f"0{d(3)}/{d(3)}-{d(3)}"]), "ip6": lambda: ":".join(f"{rnd.randrange(1, 65536):x}" for _ in range(8)),
    }
    decoys = [lambda: f"20{d(2)}-0{rnd.randrange(1, 10)}-1{d(1)}", lambda: f"({d(2)}) {d(2)}-{d(2)}", lambda: f"{w()}@{w()}", lambda: f"see (at {w()}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"{d(4)}-{d(3)}", lambda: f"x{d(16)}y", lambda: f"{d(3)}.{d(3)}", lambda: f"1{d(1)}:2{d(1)}:3{d(1)}:4{d(1)}"]
    texts, planted = [], set()
    for i in range(n):
        parts, at = [], 0
        for _ in range(rnd.randrange(1, 7)):
            kind = rnd.choice([None, None, "base", "loose", "decoy"])
            name = rnd.choice(list(loose)) if kind == "loose" else None
            piece = w() if kind is None else rnd.choice(base)() if kind == "base" else loose[name]() if name else rnd.choice(decoys)()
            lead = w() + " "
            if name:
                planted.add((i, at + len(lead), at + len(lead) + len(piece), name))
            parts.append(lead + piece + " . ")
            at += len(parts[-1])
        texts.append("".join(parts))
    return texts, planted


def test_loose_kinds_are_added(spark):
    texts, planted = personal_texts()
    found = pii.find_personal_data(table(spark, texts)).collect()
    base = {(r.id, s.start, s.end) for r in found for s in r.spans if s.base}
    assert base == {(i, a, b) for i, t in enumerate(texts) for a, b, _ in plain_personal(t)}
    apart = {x for x in planted if not any(i == x[0] and a < x[2] and x[1] < b for i, a, b in base)}
    added = {(r.id, s.start, s.end, s.kind) for r in found for s in r.spans if not s.base}
    right = {(i, a, b) for i, a, b, _ in added} & {(i, a, b) for i, a, b, _ in apart}
    precision, recall = len(right) / len({(i, a, b) for i, a, b, _ in added}), len(right) / len(apart)
    assert precision >= 0.9 and recall >= 0.9, (precision, recall)
    assert {k for *_, k in added} == set(pii.LOOSE)


def plain_cell(kind, m, before, after):
    n = len(re.sub("[^0-9]", "", m))
    bucket = next((b for least, b in ((20, 7), (16, 6), (13, 5), (10, 4), (8, 3), (5, 2), (1, 1)) if n >= least), 0)
    gaps = next((g for p, g in ((r"[\[{(]\x20?[^\W\d_]", 4), (r"[\x20_./-]{2}", 3), (r"[/_:]|\x20@|@\x20", 2), (r"[\x20-]", 1)) if re.search(p, m)), 0)
    to_python = lambda p: p.replace("\\p{L}", "[^\\W\\d_]").replace("$", "\\Z")
    said = [kind in kinds for p, kinds in pii._CONTEXT.items() if re.search(to_python(p), before)]
    glued = lambda p, t: int(bool(re.search(p, t)))
    values = [pii.KINDS.index(kind), bucket, min(4, len(re.findall("[^0-9]+", m))), gaps, 2 if True in said else 1 if said else 0, glued(r"(?:[^\W\d_]|[0-9=\"'_:/.-])\Z", before), glued(r"\A(?:[^\W\d_]|[0-9=\"'_:/-])", after)]
    values.append(0 if kind not in ("card", "card_like") or not 13 <= n <= 19 else 2 if luhn(re.sub("[^0-9]", "", m)) else 1)
    out = 0
    for v, k in zip(values, pii.FEATURES.values()):
        out = out * k + v
    return out


def test_added_spans_equal_a_plain_scoring(spark):
    """Every loose proposal, found by Python and scored tree by tree, is added if and only if it reaches its threshold."""
    import regex

    texts, _ = personal_texts(150, 62)
    docs = table(spark, texts)
    found = pii.judged(docs)
    model = pii.fit(found)
    want, cells, names = set(), {}, list(pii.FEATURES)
    for i, t in enumerate(texts):
        base = [(a, b) for a, b, _ in plain_personal(t)]
        for kind in pii.LOOSE:
            for m in regex.finditer(pii._PATTERNS[kind], t):
                if any(a < m.end() and m.start() < b for a, b in base):
                    continue
                cell = plain_cell(kind, m[0], t[max(0, m.start() - 24) : m.start()], t[m.end() : m.end() + 1])
                cells[i, m.start(), kind] = cell
                x, rest = {}, cell
                for name in reversed(names):
                    x[name], rest = rest % pii.FEATURES[name], rest // pii.FEATURES[name]
                f = model.bias
                for name, cut, sides in model.trees:
                    g, c, low, high = sides[0 if x[name] <= cut else 1]
                    f += low if x[g] <= c else high
                if kind in model.least and f >= model.least[kind]:
                    want.add((i, m.start(), m.end(), kind))
    got_cells = {(r.id, s.start, s.kind): s.cell for r in found.collect() for s in r.rest if s.kind in pii.LOOSE}
    assert got_cells == cells
    assert want and {(r.id, s.start, s.end, s.kind) for r in pii.find_personal_data(docs).collect() for s in r.spans if not s.base} == want


def test_cards_inside_a_longer_run(spark):
    """Two cards side by side fail as one base match; the trees tell them from other numbers that stand so."""
    rnd = random.Random(64)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    other = lambda: next(n for n in iter(lambda: "".join(rnd.choice("0123456789") for _ in range(16)), None) if not luhn(n))
    texts, want = [], set()
    for i in range(300):
        kind = rnd.random()
        number = luhn_number(rnd) if kind < 0.4 else other() if kind < 0.7 else None
        if number is None:
            pair = [luhn_number(rnd)] * 2 if kind < 0.75 else [other(), other()]
            number = " ".join(pair)
            want |= {(i, 6 + 17 * k, 22 + 17 * k) for k in range(2)} if kind < 0.75 else set()
        texts.append(f"{word()} {number} {word()}")
    found = pii.find_personal_data(table(spark, texts)).collect()
    added = {(r.id, s.start, s.end) for r in found for s in r.spans if not s.base}
    assert {(r.id, s.start, s.end) for r in found for s in r.spans if s.base} == {(i, a, b) for i, t in enumerate(texts) for a, b, _ in plain_personal(t)}
    assert want <= added and len(added - want) <= 0.1 * len(added) and len(want) > 15


def test_boosted_trees_and_thresholds():
    size = int(np.prod(list(pii.FEATURES.values())))
    cells, n = np.arange(size), np.full(size, 10.0)
    x0 = cells // (size // 8)
    good = np.where(x0 >= 4, 9.5, 0.0)
    trees = pii.boost(cells, n, good, n, good)
    assert len(trees.trees) > 0 and all(f in pii.FEATURES for f, _, _ in trees.trees) and set(trees.least) == set(pii.LOOSE)
    assert pii.boost(np.zeros(0, np.int64), *[np.zeros(0)] * 4).least == {} and pii.boost(cells, n, good * 0, n, good * 0).least == {}


# --- 9 urls


def test_hosts_paths_and_rules(spark):
    urls = ["https://Example.NET/en/1?x", "http://a.example.com/de/2#y", "http://example.com", "http://net/", "x.org/fr/", None, "", "http://b.org/fr/?", "http://sub.net?q=/", "a://b://c/d", "http://xnet/", "HTTP://É.com/EN/"]
    rows = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string, path string")
    got = {}
    for r in urlfilter.judge(rows).collect():
        got.setdefault(r.id, []).append((r.host, r.path, r.rule, r.verdict if r.rule else None))
    one = {0: ("example.net", "/en/1", "example.net/en/", "allow"), 1: ("a.example.com", "/de/2", "example.com/de/", "block"), 2: ("example.com", "", None, None), 3: ("net", "/", "net/", "block"), 4: ("", "", None, None), 5: ("", "", None, None),
           6: ("", "", None, None), 7: ("b.org", "/fr/", "org/fr/", "allow"), 8: ("sub.net", "", None, None), 9: ("b:", "//c/d", None, None), 10: ("xnet", "/", None, None), 11: ("É.com", "/EN/", None, None)}
    assert got == {k: [v, v] for k, v in one.items()}
    assert urlfilter.judge(rows.limit(0)).count() == 0


def test_templates_take_purity(spark):
    urls = [f"http://h.example.com/de/{i}" for i in range(30)] + [f"http://h{i}.example.net/en/{i}" for i in range(30)] + ["http://h.example.com/de/9/x", "http://h.example.com/en/3"]
    urls += [f"http://wide.org/item-{chr(97 + i % 26)}{chr(97 + i // 26)}/x" for i in range(40)]
    out = {r.id: r for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert out[0].template == "/de/*" and out[len(urls) - 1].template == "/*/x" and out[61].verdict == "allow"


def plain_shares(urls):
    """Template and share of each url, by loops over dictionaries."""
    cut = lambda u: (m[1].lower(), m[2]) if (m := re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")) else ("", "")
    rules = sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))
    rows = []
    for u in urls:
        host, path = cut(u)
        said = next((v for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), None)
        rows.append((host, tuple(re.sub("[0-9]+", "*", path).split("/")[1:]) if path else (), said))
    seen = Counter((h, j, x) for h, s, _ in rows for j, x in enumerate(s))
    rows = [(h, tuple(x if seen[h, j, x] >= urlfilter.LEAST_ROWS else "*" for j, x in enumerate(s)), said) for h, s, said in rows]
    count = {}

    def add(key, said):
        n = count.setdefault(key, [0, 0])
        n[0] += said is not None
        n[1] += said == "block"

    for h, s, said in rows:
        for key in [("all",), ("host", h), ("shape", s), *(("node", h, s[: j + 1]) for j in range(len(s)))]:
            add(key, said)
    groups, nodes = {}, [k for k in count if k[0] == "node"]
    for _, h, s in nodes:
        l, b = count["node", h, s]
        pl, pb = np.sum([count[k] for k in nodes if k[1] == h and k[2][:-1] == s[:-1] and len(k[2]) == len(s)], axis=0).tolist()
        r, rb = pl - l, pb - b
        same = l >= 5 and r >= 5 and abs(b / l - rb / r) <= 1.96 * np.sqrt(pb / pl * (1 - pb / pl) * (1 / l + 1 / r)) + 1e-9
        groups.setdefault((h, s[:-1], len(s)) if same else ("own", h, s), []).append((h, s))
    of = {k: np.sum([count["node", *x] for x in members], axis=0).tolist() for members in groups.values() for k in members}
    smooth = lambda n, prior: (n[1] + 2 * prior) / (n[0] + 2)
    out = []
    for h, s, said in rows:
        p = smooth(count["shape", s], smooth(count["host", h], (count["all",][1] + 1) / (count["all",][0] + 2)))
        for j in range(len(s)):
            p = smooth(of[h, s[: j + 1]], p)
        out.append(("".join("/" + x for x in s), p, said or ("block" if p >= 0.5 else "allow")))
    return out


def test_tree_equals_a_plain_one(spark):
    rnd = random.Random(67)
    hosts = ["a.example.com", "b.example.com", "example.net", "c.org", "d.net", "x.io"]
    step = lambda: rnd.choice(["de", "en", "fr", "news", "p", f"u{rnd.choice('abcdefghijk') * 2}", str(rnd.randrange(99)), ""])
    urls = [f"http://{rnd.choice(hosts)}" + "".join(f"/{step()}" for _ in range(rnd.randrange(7))) + rnd.choice(["", "?q=1", "#x"]) for _ in range(1500)] + [None, "", "no host"]
    urls += ["http://a.example.com/de/" + "/".join("abcdefghij"[k % 10] for k in range(n)) for n in (6, 6, 7, 400)] + ["http://x.io/" + "y" * 100_000]
    rows = {r.id: r for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    want = plain_shares(urls)
    assert len({t for t, *_ in want}) > 60
    for i, (template, p, verdict) in enumerate(want):
        assert (rows[i].template, rows[i].verdict) == (template, verdict) and abs(rows[i].p - p) < 1e-9, (urls[i], rows[i], template, p)


# --- 10 search


def test_top_k_equals_brute_force(spark):
    rnd = np.random.default_rng(13)
    v = rnd.normal(0, 0.2, (300, 16)).astype(np.float32)
    v[50:60] = v[40]  # ties
    v[::7, 3:9] = 0
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    v[7] *= 9  # the repeated one is among the best
    rows[7] = (7, v[7].tolist(), 0)
    rows += [(1000, None, 0), (1050, [None] * 16, 0), (1100, [float("nan")] * 16, 0), (1150, [float("inf")] * 16, 0), (None, v[0].tolist(), 0), (7, v[7].tolist(), 0), (1200, [1.0, 2.0], 0), (1250, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {}
    vec = topk.quantise(df)
    for r in topk.top_k(vec.filter("id % 50 = 0"), vec).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ints = {i: [int(np.floor(256 * float(x))) for x in e] for i, e, _ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    assert set(got) == {q for q in ints if q % 50 == 0}
    for q, found in got.items():
        every = [i for i, e, _ in rows if i in ints and e is not None]  # id 7 twice
        scores = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in every if c != q)[:5]
        assert found == [(k + 1, c, -s) for k, (s, c) in enumerate(scores)]
    assert topk.top_k(vec.limit(0), vec).count() == 0 and topk.top_k(vec.filter("id = 0"), vec.filter("id = 0")).count() == 0


def test_huge_components_and_clashing_names(spark):
    rows = [(i, [3e13 * (i + 1)] * 4, 1, "x", 2, 3) for i in range(3)] + [(9, [-1e300, 0.0, 0.0, 1e300], 1, "x", 2, 3)]
    vec = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>, block int, v string, row int, id int"))
    most = (1 << 63) - 1
    assert sorted(vec.filter("id = 9").first().v) == [-(1 << 63), 0, 0, most]
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(vec, vec).collect()}
    assert got[0, 1] == got[2, 1] == most and len(got) == 12 and got[0, 9] == sum(256 * 30_000_000_000_000 * x for x in (-(1 << 63), most))  # exact on the way


@pytest.mark.parametrize(("queries", "candidates"), [(1, 1), (1, 5000), (40, 2000), (2000, 2000), (7, 3)])
def test_grid_follows_the_blocks(queries, candidates):
    rows, columns = topk.grid(queries, candidates, 8)
    assert 1 <= rows <= candidates and 1 <= columns <= queries
    assert -(-candidates // rows) * -(-queries // columns) <= 4 * topk.PAIRS and rows * columns >= min(24, queries * candidates) / 2

"""Near copies of the pipeline: edited copies by brute force, repeated and missing ids."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from stratalog.llm import shingles, simhash

from .test_operators import EDGE, words_of

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], KINDS)


def plain_set(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(texts):
    sets, up = [plain_set(t) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(len(texts))]


def edited(rnd, text, n):
    w = text.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
    return " ".join(w)


def edited_texts():
    rnd = random.Random(31)
    line = words_of(rnd, 30, 5000)
    texts = [*EDGE[:6], "a b c d e f g h", "a b c d e f g h i"]
    for _ in range(12):
        b = words_of(rnd, rnd.randrange(60, 300), 5000)
        texts += [b, *(edited(rnd, b, rnd.randrange(1, 12)) + (" " + line) * rnd.randrange(2) for _ in range(5))]
    b = words_of(rnd, 200, 5000)
    for _ in range(15):  # a chain: ends differ
        texts.append(b)
        b = edited(rnd, b, 3)
    return texts + [words_of(rnd, 40, 5000) + " " + line for _ in range(20)]


def test_stage_drops_edited_copies(spark):
    texts = edited_texts()
    kept = corpus_pipeline.near_copies_out(spark, rows_of(spark, enumerate(texts)), "")
    assert Counter(r.doc_id for r in kept.collect()) == Counter(set(plain_groups(texts)))


def test_no_choice_of_common_shingles_or_rounds_loses_a_link(spark, monkeypatch):
    monkeypatch.setattr(shingles, "SAMPLE", 1)
    monkeypatch.setattr(shingles, "STARS", 1)
    texts = edited_texts()
    kept = corpus_pipeline.near_copies_out(spark, rows_of(spark, enumerate(texts)), "")
    assert {r.doc_id for r in kept.collect()} == set(plain_groups(texts))
    assert corpus_pipeline.near_copies_out(spark, rows_of(spark, []), "").count() == 0


@pytest.mark.parametrize("groups", [simhash.code_groups, shingles.near_groups])
def test_texts_under_one_id_and_without_id(spark, groups):
    rnd = random.Random(32)
    x, y, z, u, v = (words_of(rnd, 60, 5000) for _ in range(5))
    rows = [(1, x), (7, x), (7, y), (7, z), (7, z), (None, u), (None, u), (None, v), (None, y), (9, v)]
    kept = simhash.keep_one(rows_of(spark, rows), groups=groups).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, x), (7, y), (7, z), (None, u), (9, v)])


def test_fingerprints_link_first_and_shingles_check(spark, monkeypatch):
    linked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda classes, bits, segments: linked.append((classes.count(), bits, segments)) or links(classes, bits, segments))
    rnd = random.Random(33)
    long = words_of(rnd, 2000, 5000)
    texts = [long, edited(rnd, long, 1), edited(rnd, long, 2), long + " " + long, *edited_texts()]
    kept = corpus_pipeline.near_copies_out(spark, rows_of(spark, enumerate(texts)), "")
    assert Counter(r.doc_id for r in kept.collect()) == Counter(set(plain_groups(texts)))
    codes = {n: simhash.code_of(shingles.shingle_set(t).view("u8")) for n, t in enumerate(texts)}
    assert linked == [(len(set(codes.values())), simhash.MOST_BITS, simhash.SEGMENTS)]
    nodes = spark.createDataFrame([(n, c - (1 << 64) if c >> 63 else c) for n, c in codes.items()], "node long, fp long")
    found = {(r.a, r.b) for r in shingles.fingerprint_pairs(nodes).collect()}
    near = {(a, b) for b in codes for a in range(b) if (codes[a] ^ codes[b]).bit_count() <= 2}
    assert found <= near and plain_joined(found) == plain_joined(near) and any(codes[a] != codes[b] for a, b in found)


def plain_joined(pairs):
    up = {}
    for x, y in sorted(pairs):
        a, b = up.get(x, {x}), up.get(y, {y})
        up.update(dict.fromkeys(a | b, a | b))
    return {frozenset(g) for g in up.values()}


def test_few_links_take_few_tasks_however_many_partitions_a_shuffle_has(spark):
    """Each task that feeds a shuffle leaves files: 200 links in 60 partitions are no work for 60 tasks a step."""
    rnd = random.Random(34)
    pairs = [(x, rnd.randrange(max(0, x - 3), x)) for x in range(1, 201) if x % 40]
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    sc = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few links", "few links")
        found = {(r.node, r.component) for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {frozenset([top, *(n for n, c in found if c == top)]) for top in {c for _, c in found}} == plain_joined(pairs)
    tracker = sc.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("few links")]
    tasks = [tracker.getStageInfo(s).numTasks for s in {s for j in jobs for s in j.stageIds}]
    assert sum(n >= 60 for n in tasks) < len(tasks) / 2

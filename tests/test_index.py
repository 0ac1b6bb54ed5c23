"""Rules and searches that come as tables, against compiled packs and brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalog.functions import rules as R
from stratalog.operators import index
from stratalog.operators.scan import pattern_flags

LINES = "artifact_path string, line_number long, raw_line string, rule_id string"
RULES = "rule_ord int, rule_id string, patterns array<string>"


def frame(spark, lines):
    return spark.createDataFrame([("f", k, x, "clash") for k, x in enumerate(lines)], LINES).drop("rule_id").repartition(3)


def rows(df):
    return sorted(map(tuple, df.select("line_number", "rule_ord", "rule_id", "matched_text").collect()))


PATTERNS = [
    ["error", "fail(ed|ure)"], ["a|b", "zz"], [r"\d+", "x"], ["(one|two) three"], ["left one|right two"], ["é+"], ["kelvin sign"], ["[ab|]c|long literal"], [r"a\|b"], ["miss"], [], None,
    [r"tls\s+down", "tls"], ["^$"], ["ab"], [r"[]|]x|[^]|]yy"],
]
TEXTS = [
    None, "", "an ERROR here", "it failed twice failed", "One three", "two  three", "RIGHT TWO", "é É", "Kelvin ſign", "bc |c", "a|b", "mıſſ", "tls \t down", "x" * 70_000 + " error",
    "12 34", "]x", "zyy", "tls", "an ERROR here", "long LITERAL", "aB",
]


def test_indexed_hits_are_dynamic_hits(spark):
    table = spark.createDataFrame([(k, f"R{k}", p) for k, p in enumerate(PATTERNS)], RULES)
    lines = frame(spark, TEXTS)
    want = R.dynamic_hits(lines, spark.createDataFrame([(k, f"R{k}", p or []) for k, p in enumerate(PATTERNS)], RULES))
    assert rows(index.indexed_hits(lines, table)) == rows(want) and len(rows(want)) > 20
    assert index.indexed_hits(lines.limit(0), table).count() == 0 == index.indexed_hits(lines, table.limit(0)).count()


def test_built_in_pack(spark):
    from stratalog.plans.views import SAMPLES

    lines = frame(spark, [s.upper() if k % 3 else s for k, s in enumerate(SAMPLES)])
    table = R.rules_table(spark, R.built_in())
    assert rows(index.indexed_hits(lines, table)) == rows(R.dynamic_hits(lines, table))


def test_fifty_thousand_rules(spark):
    rnd = random.Random(1)
    word = lambda k: f"{k * 7919 % 99991:05d}-{k}"
    table = spark.range(50_000).selectExpr("cast(id as int) rule_ord", "concat('R', id) rule_id", "array(concat('never ', id, ' seen'), concat('job ', lpad(id * 7919 % 99991, 5, '0'), '-', id, ' end')) patterns")
    told = [rnd.randrange(60_000) for _ in range(300)]
    lines = frame(spark, [f"the job {word(k)} end of it" for k in told])
    want = sorted((n, k, f"R{k}", f"job {word(k)} end") for n, k in enumerate(told) if k < 50_000)
    assert rows(index.indexed_hits(lines, table)) == want and len(want) > 200


def test_two_hundred_specs(spark):
    rnd = random.Random(2)
    words = ["alpha", "Beta", "gamma", "délta", "x", "eta.", "(z"]
    lines = [(f"fam{rnd.randrange(4)}", " ".join(rnd.sample(words, rnd.randrange(1, 5))).upper() if k % 2 else " ".join(rnd.sample(words, 3))) for k in range(60)] + [("fam0", None)]
    specs = [(k, f"m{k}", rnd.sample(["fam0", "fam1", "fam2", "fam3", "none"], rnd.randrange(1, 3)), rnd.sample([*words, "nowhere"], rnd.randrange(0, 4)), rnd.choice(["fam1", "no", None])) for k in range(200)]
    df = spark.createDataFrame(lines, "artifact_family string, raw_line string")
    table = spark.createDataFrame(specs, "spec_ord int, message string, families array<string>, needles array<string>, target string")
    held = lambda needles, text: bool(needles) and text is not None and all(n.lower() in text.lower() for n in needles)
    got = sorted((r.artifact_family, r.raw_line, r.spec_ord) for r in index.lines_of_specs(df, table).collect())
    assert got == sorted((f, t, k) for f, t in lines for k, _, _, needles, _ in specs if held(needles, t)) and got
    seen = {f for f, _ in lines if f != "fam3"}
    want = [(k, m) for k, m, fams, needles, target in specs if set(fams) & seen and target not in seen and not any(f in fams and held(needles, t) for f, t in lines)]
    families = spark.createDataFrame([(f,) for f in sorted(seen)], "artifact_family string")
    assert sorted(map(tuple, index.negative_specs(families, df, table).collect())) == want and 0 < len(want) < 200


def test_what_meets_grows_with_what_matches(spark):
    """Rules whose texts share all short grams meet only the lines that hold their long ones."""
    said = lambda k: " ".join("abcdefgh"[k >> 3 * i & 7] * 2 for i in range(5))
    lines = frame(spark, [said(k * 37) for k in range(400)]).withColumn("__row", F.monotonically_increasing_id())
    needed = spark.createDataFrame([((k,), 0, said(k * 37 + k % 2)) for k in range(400)], "entry struct<k:int>, need int, literal string")
    assert index._met(lines, needed, F.col("raw_line")).count() <= 4 * 400


def test_grams_over_slices(spark, monkeypatch):
    """Texts that are looked at in several slices, null and empty ones among them, give the same as whole ones."""
    batch = pa.record_batch({"t": pa.array(["", "abcdé", "x" * 50, "cde"])}).slice(1)
    whole = [(r.num_rows, bytes(raw)) for r, raw, _ in index._sliced(batch, 0)]
    monkeypatch.setattr(index, "SLICE", 10)
    parts = [(r.num_rows, bytes(raw)) for r, raw, _ in index._sliced(batch, 0)]
    assert len(whole) == 1 and len(parts) == 3 and b"".join(x for _, x in parts) == whole[0][1]
    h = index.gram_hashes(np.frombuffer(b"abcdeabcde", np.uint8), [3, 5])
    assert h[3][0] == h[3][5] and h[5][0] == h[5][5] and index.keys_of("cde")[1] == [int(h[3][2].view(np.int64))]


def test_flags_say_what_they_hold():
    with pytest.raises(ValueError, match="negative_specs"):
        pattern_flags(None, [("m", (), ("a", "b", "c"), "t")])


def test_alternatives():
    assert R.alternatives(r"a|(b|c)|[|]|\||d") == ["a", "(b|c)", "[|]", r"\|", "d"] and R.alternatives("") == [""]
    assert R.literal_of("café closed") == " closed"


def test_memory_follows_neither_rows_nor_lines(monkeypatch):
    """What a search for grams has made is given back at once, and one long line is looked at some places at a time, with the same result."""
    import gc
    import tracemalloc

    told = np.full(1 << 12, 0, np.uint8)
    want = np.array(index.keys_of("needle in hay")[1]).view(np.uint64)
    for probe in range(index.PROBES):
        bit = index._bit(want, probe, len(told) * 8).astype(np.int64)
        np.bitwise_or.at(told, bit >> 3, 1 << (bit & 7).astype(np.uint8))
    text = (b"x" * (index.PLACES - 6) + b"needle in hay") * 24
    gc.collect()
    gc.disable()
    try:
        tracemalloc.start()
        row, key = index._pairs(index._held(np.frombuffer(text, np.uint8), np.array([0, 5, len(text)]), list(index.LENGTHS), told))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        gc.enable()
    assert peak < 40 << 20 and set(row) == {1} and set(want.view(np.int64)) <= set(key)


def test_letters_have_one_lower_case(spark):
    """Whatever a letter of a literal matches without case is that letter in the lines' lower case."""
    x = spark.range(0x2200).filter("id not between 55296 and 57343").selectExpr("id", "decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE') d")
    c = x.filter("id between 223 and 255 and id <> 247").selectExpr("d c")
    assert x.crossJoin(c).filter("d rlike concat('(?iUd)', c)").filter(index._low(F.col("d")) != F.col("c")).count() == 0
    table = spark.createDataFrame([(k, f"R{k}", [p]) for k, p in enumerate(["École où", "größe", "ÿ", "ñandú"])], RULES)
    lines = frame(spark, ["ÉCOLE OÙ", "die GRÖẞE", "Ÿ", "ÑANDÚ und größe", "ecole"])
    assert rows(index.indexed_hits(lines, table)) == rows(R.dynamic_hits(lines, table)) and len(rows(index.indexed_hits(lines, table))) == 5


def test_rules_that_share_patterns(spark, monkeypatch):
    """A pattern of many rules is tried once, its rules follow in lists, and each takes its first pattern that is found."""
    monkeypatch.setattr(index, "LIST", 7)
    table = spark.createDataFrame([(k, f"R{k}", [f"begin {k}", "shared end", f"begin {k % 3}", "shared end"]) for k in range(60)] + [(60, "A", ["shared end"]), (61, "B", ["end", "shared end"])], RULES)
    lines = frame(spark, ["begin 1 shared end", "shared END", "Begin 2", "begin 59 or end"])
    want = rows(R.dynamic_hits(lines, table))
    assert rows(index.indexed_hits(lines, table)) == want and len(want) > 120
    monkeypatch.setattr(index, "TOLD", 0)  # postings and lines are dealt
    assert rows(index.indexed_hits(lines, table)) == want
    tried = index._met(lines.withColumn("__row", F.monotonically_increasing_id()), spark.createDataFrame([(("shared end",), 0, "shared end")] * 50, "entry struct<java:string>, need int, literal string"), F.col("raw_line"))
    assert tried.count() == 2


def test_searches_keep_no_lines(spark):
    """Which searches found a line is told by family: the texts of the lines are not shuffled for it."""
    lines = spark.createDataFrame([("fam0", f"alpha {k} beta") for k in range(50)] + [("fam1", "gamma")], "artifact_family string, raw_line string")
    specs = spark.createDataFrame([(0, "a", ["fam0"], ["beta"], None), (1, "b", ["fam0"], ["gamma"], None), (2, "c", ["fam1"], ["gamma"], "fam0")], "spec_ord int, message string, families array<string>, needles array<string>, target string")
    out = index.negative_specs(lines.select("artifact_family"), lines, specs)
    assert [tuple(r) for r in out.collect()] == [(1, "b")]
    dealt = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    assert dealt and not any("raw_line" in x for x in dealt)

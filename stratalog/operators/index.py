"""Lines against tables of patterns or word lists of any size, by an inverted index of what each of them needs.

Whatever a pattern matches holds a literal text. Of the literal's grams of the greatest length in ``LENGTHS`` that it has, the
one that is rarest in the lines becomes the key under which the pattern is indexed: up to eight characters that is the
whole literal, so what meets grows with what matches and not with patterns times lines. Lines meet patterns by an
equi-join on hashes of grams, and what meets is tested in full. Neither table is collected. Tasks are told a Bloom filter
of the keys in use, of at most ``MOST_BITS`` bits however many patterns there are, and pass on only the grams in it. Few postings are
told to all tasks, and lines stay where they are; else postings are copied to a few salts and lines dealt over them, so a
frequent gram is no hot key. A pattern without any literal text is indexed under the empty gram, which every line has: it has to be
tried on all of them. A pattern that many rules share is indexed and tried once; its rules follow in lists of ``LIST``.

Grams are hashed for ``PLACES`` places of the text at a time, so what a task holds follows neither its rows nor the length of a line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import alternatives, literal_of, to_java
from ..lineage import cut_lineage

SALTS = 16
#: Lengths of grams, in bytes of UTF-8.
LENGTHS = (1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 24, 32)
#: Grams of one literal among which the rarest is chosen; bits of a filter and of one piece of it, and how many of them a key sets.
CHOICE, LEAST_BITS, MOST_BITS, PIECE, PROBES = 8, 1 << 15, 1 << 29, 1 << 15, 6
#: Bytes of texts that are looked at together, and places of them of which the grams are hashed at once.
SLICE, PLACES = 1 << 20, 1 << 16
#: Rules of a pattern that go as one list; postings that are told to all tasks, and their bytes.
LIST, TOLD, TOLD_BYTES = 256, 100_000, 8 << 20
EMPTY = 0
#: ASCII and the small letters of Latin-1: those that match them without case all have them as lower case.
LETTERS = r"\x00-\x7f\u00df-\u00f6\u00f8-\u00ff"
#: Letters that match s or i without case although their lower case is another letter.
_ODD = ("ſıİ", "sii")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def _low(text: Column) -> Column:
    return F.lower(F.translate(text, *_ODD))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _B + b
    return x ^ (x >> np.uint64(29))


def gram_hashes(raw: np.ndarray, lengths) -> dict[int, np.ndarray]:
    """For each length a hash of the gram at every place of the bytes, put together from those of half the length."""
    powers, p = {1: (raw.astype(np.uint64) + np.uint64(1)) * _A}, 1
    while 2 * p <= min(max(lengths, default=0), len(raw)):
        h = powers[p]
        powers[2 * p] = _joined(h[: len(h) - p], h[p:])
        p *= 2
    out = {}
    for k in lengths:
        n, at, h = len(raw) - k + 1, 0, None
        if n <= 0:
            continue
        for p in (1 << b for b in reversed(range(k.bit_length())) if k >> b & 1):
            part = powers[p][at : at + n]
            h, at = part if h is None else _joined(h, part), at + p
        out[k] = h + np.uint64(k)
    return out


def _length(n: int) -> int:
    return max((k for k in LENGTHS if k <= n), default=0)


def keys_of(literal: str) -> tuple[int, list[int]]:
    """(length, hashes) of the grams by one of which a literal may be indexed."""
    raw = np.frombuffer(literal.encode(), np.uint8)
    k = _length(len(raw))
    if not k:
        return 0, [EMPTY]
    found = gram_hashes(raw, [k])[k]
    places = np.unique(np.linspace(0, len(found) - 1, min(CHOICE, len(found))).astype(int))
    return k, np.unique(found[places]).view(np.int64).tolist()


def _keyed(needed: DataFrame) -> DataFrame:
    """(literal, length, key) of the different literals."""

    def run(batches):
        for b in batches:
            rows = [(x, k, h) for x in b.column(0).to_pylist() for k, hs in [keys_of(x)] for h in hs]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, (pa.string(), pa.int32(), pa.int64()))], names=["literal", "length", "key"])

    return cut_lineage(needed.select("literal").distinct().mapInArrow(run, "literal string, length int, key long"))


def _bit(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The place of a key's bit in a filter, for one of its probes."""
    return (h + ((h * _C) >> np.uint64(31)) * np.uint64(probe) if probe else h) & np.uint64(bits - 1)


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A Bloom filter over (key), at least thirty bits a key up to ``MOST_BITS``; its pieces are made by tasks."""
    n = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (30 * n).bit_length()))

    def slots(batches):
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            x = np.concatenate([_bit(h, k, bits) for k in range(PROBES)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x // PIECE), pa.array(x)], names=["p", "x"])

    def made(rows: pa.Table) -> pa.Table:
        x = rows.column("x").to_numpy()
        part = np.zeros(PIECE, np.uint8)
        part[x % PIECE] = 1
        return pa.table({"piece": pa.array([int(x[0]) // PIECE], pa.int64()), "part": pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for r in keys.select("key").mapInArrow(slots, "p long, x long").groupBy("p").applyInArrow(made, "piece long, part binary").toLocalIterator():
        out[r.piece * PIECE // 8 : (r.piece + 1) * PIECE // 8] = np.frombuffer(r.part, np.uint8)
    return out


def _sliced(batch: pa.RecordBatch, at: int):
    """(rows, bytes, where each text begins and ends) of a batch, some megabytes of the texts in column ``at`` at a time."""
    text = batch.column(at).cast(pa.large_string())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    raw = np.frombuffer(text.buffers()[2], np.uint8) if len(text) and text.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE, side="right")) - 1)
        yield batch.slice(a, b - a), raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
        a = b


def _held(raw: np.ndarray, ends: np.ndarray, lengths: list[int], told: np.ndarray):
    """(row, key) of every place of the texts with a gram that the filter holds, for some places after the other."""
    bits, most = len(told) * 8, max(lengths, default=0)
    if EMPTY in lengths:
        yield np.arange(len(ends) - 1), np.full(len(ends) - 1, EMPTY, np.int64)
    for a in range(0, len(raw), PLACES):
        rows, keys = [], []
        for k, h in gram_hashes(raw[a : a + PLACES + most - 1], [k for k in lengths if k]).items():
            h = h[:PLACES]
            at = None
            for probe in range(PROBES):
                bit = _bit(h if at is None else h[at], probe, bits)
                held = (told.take((bit >> np.uint64(3)).view(np.int64)) >> (bit & np.uint64(7)).astype(np.uint8) & np.uint8(1)).view(bool)
                at = np.flatnonzero(held) if at is None else at[held]
            place = at + a
            row = np.searchsorted(ends, place, side="right") - 1
            inside = place + k <= ends[row + 1]
            rows.append(row[inside])
            keys.append(h[at[inside]].view(np.int64))
        if rows:
            yield np.concatenate(rows), np.concatenate(keys)


def _pairs(found) -> tuple[np.ndarray, np.ndarray]:
    """The different (row, key) of what ``_held`` gives, by rows."""
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row, key in found:
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))[: len(row)]
        rows.append(row[new])
        keys.append(key[new])
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))[: len(row)]  # a row goes over several windows
    return row[new], key[new]


def _met(lines: DataFrame, needed: DataFrame, text: Column) -> DataFrame:
    """(lines' columns, entry) that share the entry's key; ``needed`` is (entry struct, need int, literal string): every need of an
    entry has to be met by one of its literals, and the entry is indexed by the need that is rarest. ``lines`` have __row."""
    sc, names = lines.sparkSession.sparkContext, lines.columns
    keyed = _keyed(needed)
    lengths = [r.length for r in keyed.select("length").distinct().collect()]  # as many as LENGTHS
    every = sc.broadcast(_filter_of(keyed.select("key").distinct()))

    def counted(batches):
        for b in batches:
            for _, raw, ends in _sliced(b, 0):
                for _, keys in _held(raw, ends, lengths, every.value):
                    found, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    said = lines.select(_low(text).alias("__low")).mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    asked = needed.join(keyed.join(said, "key", "left").groupBy("literal").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("best")), "literal")
    by_need = asked.groupBy("entry", "need").agg(F.sum("best.n").alias("n"), F.collect_set("best.key").alias("keys"))  # as many as a pattern has alternatives
    posted = cut_lineage(by_need.groupBy("entry").agg(F.min(F.struct("n", "need", "keys")).alias("x")).select("entry", F.explode("x.keys").alias("key")))
    chosen = sc.broadcast(_filter_of(posted.select("key").distinct()))

    def dealt(batches):
        for b in batches:
            for own, raw, ends in _sliced(b, len(names)):
                row, key = _pairs(_held(raw, ends, lengths, chosen.value))
                here, first = np.unique(row, return_index=True)
                out = own.take(pa.array(here, pa.int64()))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(key, pa.int64()))
                yield pa.RecordBatch.from_arrays([*out.columns[: len(names)], lists], names=[*names, "keys"])

    schema = T.StructType([*lines.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))])
    there = lines.withColumn("__low", _low(text)).mapInArrow(dealt, schema).select(*names, F.explode("keys").alias("key"))
    size = posted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("entry")))), F.lit(0)).alias("bytes")).first()
    if size.n <= TOLD and size.bytes <= TOLD_BYTES:
        return there.join(F.broadcast(posted), "key").drop("key")
    salted = there.withColumn("salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int"))
    return salted.join(posted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"]).drop("key", "salt")


def _literals(rules: DataFrame) -> DataFrame:
    """(rule_ord, rule_id, place, java, literals) of every pattern of rules (rule_ord, rule_id, patterns)."""

    def run(batches):
        for b in batches:
            rows = [(o, i, k, to_java(p), [literal_of(a, LETTERS) for a in alternatives(p)]) for o, i, ps in zip(*(c.to_pylist() for c in b.columns)) for k, p in enumerate(ps or [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string())))], names=["rule_ord", "rule_id", "place", "java", "literals"])

    return rules.select("rule_ord", "rule_id", "patterns").mapInArrow(run, "rule_ord int, rule_id string, place int, java string, literals array<string>")


def indexed_hits(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Lines with the rules (rule_ord, rule_id, patterns) that match: the lines' columns, rule_ord, rule_id and matched_text, which is what
    the first pattern that is found matches. The same rows as ``rules.dynamic_hits``, for any number of rules.

    Null lines and null or empty lists of patterns match nothing; repeated lines are matched each. No rules or lines give no rows.
    """
    names = lines.columns
    own = lines.filter("raw_line is not null").withColumn("__row", F.monotonically_increasing_id())
    patterns = cut_lineage(_literals(rules))
    ordered = F.array_sort(F.collect_set(F.struct("place", "rule_id", "java")))
    each = patterns.groupBy("rule_ord").agg(ordered.alias("all")).select("rule_ord", "all", F.posexplode("all").alias("i", "x"))
    before = F.transform(F.slice("all", F.lit(1), F.col("i")), lambda x: x["java"])  # the patterns that come before in the rule
    each = each.select(F.col("x.java").alias("java"), "rule_ord", "i", F.struct("rule_ord", "x.rule_id", before.alias("before")).alias("rule"))
    each = each.filter(~F.array_contains("rule.before", F.col("java")))  # said twice
    place = F.row_number().over(Window.partitionBy("java").orderBy("rule_ord", "i"))
    each = each.withColumn("list", F.floor((place - 1) / LIST).cast("int"))
    lists = cut_lineage(each.groupBy("java", "list").agg(F.collect_list("rule").alias("rules")))
    entries = patterns.groupBy("java").agg(F.min("literals").alias("literals")).join(lists.groupBy("java").agg(F.max("list").alias("last")), "java")
    needed = entries.select(F.struct("java", "last").alias("entry"), F.lit(0).alias("need"), F.explode("literals").alias("literal")).distinct()
    met = _met(own, needed, F.col("raw_line")).filter("raw_line rlike entry.java").withColumn("matched_text", F.expr("regexp_extract(raw_line, entry.java, 0)"))
    found = F.collect_set(F.struct("entry", "matched_text")).alias("__found")  # the patterns of one line
    found = met.groupBy("__row", F.xxhash64(*names).alias("__own")).agg(*[F.first(c).alias(c) for c in names], found)
    others = F.when(F.size("__found") > 1, F.transform("__found", lambda x: x["entry"]["java"])).alias("__others")
    one = found.select(*names, others, F.explode("__found").alias("__x"))
    one = one.select(*names, "__others", "__x.matched_text", F.col("__x.entry.java").alias("__java"), F.explode(F.sequence(F.lit(0), F.col("__x.entry.last"))).alias("__list"))
    hits = one.join(lists.select(F.col("java").alias("__java"), F.col("list").alias("__list"), "rules"), ["__java", "__list"]).select(*names, "__others", "matched_text", F.explode("rules").alias("__rule"))
    hits = hits.filter(F.col("__others").isNull() | ~F.arrays_overlap("__others", "__rule.before"))
    return hits.select(*names, "__rule.rule_ord", "__rule.rule_id", "matched_text")


def _with_specs(lines: DataFrame, specs: DataFrame) -> DataFrame:
    """(lines' columns, __row, spec_ord) for every line that holds all needles of a spec; a spec that is there twice may be met twice."""
    own = lines.filter("raw_line is not null").withColumn("__row", F.monotonically_increasing_id())
    known = specs.filter((F.size("needles") > 0) & ~F.exists("needles", lambda n: n.isNull())).select("spec_ord", F.array_sort(F.array_distinct(F.transform("needles", lambda n: F.lower(n)))).alias("needles"))
    needed = known.select(F.struct("spec_ord", "needles").alias("entry"), F.posexplode("needles").alias("need", "literal"))
    runs = F.regexp_extract_all("literal", F.lit(f"[{LETTERS}]+"), F.lit(0))  # other letters may have several lower cases
    longest = F.coalesce(F.array_max(F.transform(runs, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"], F.lit(""))
    met = _met(own, needed.withColumn("literal", longest), F.col("raw_line"))
    low = F.lower("raw_line")
    return met.filter(F.forall("entry.needles", lambda n: F.contains(low, n))).select("__row", *lines.columns, "entry.spec_ord")


def lines_of_specs(lines: DataFrame, specs: DataFrame) -> DataFrame:
    """(lines' columns, spec_ord) for every line that holds all needles of a spec (spec_ord, needles array<string>); case does not matter.

    Needles are plain texts, any number of them. Specs without needles, null needles and null lines meet nothing.
    """
    names = lines.columns
    met = _with_specs(lines, specs)
    return met.groupBy("__row", F.xxhash64(*names).alias("__own"), "spec_ord").agg(*[F.first(c).alias(c) for c in names]).select(*names, "spec_ord")


def negative_specs(families: DataFrame, lines: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_ord, message): specs (spec_ord, message, families array<string>, needles array<string>, target) of which a wanted family is among
    the scanned ``families`` (artifact_family), but neither the target is, nor a line (artifact_family, raw_line) of a wanted family with all needles.

    The same as ``findings.negative_searches`` for any number of specs; null targets and families are none.
    """
    seen = families.select("artifact_family").distinct()
    wanted = specs.select("spec_ord", F.explode("families").alias("artifact_family"))
    relevant = wanted.join(seen, "artifact_family", "left_semi").select("spec_ord").distinct()
    there = specs.join(seen, F.col("target") == F.col("artifact_family"), "left_semi").select("spec_ord")
    found = _with_specs(lines.select("artifact_family", "raw_line"), specs).select("spec_ord", "artifact_family").distinct().join(wanted, ["spec_ord", "artifact_family"], "left_semi").select("spec_ord")
    return specs.join(relevant, "spec_ord", "left_semi").join(found.unionByName(there).distinct(), "spec_ord", "left_anti").select("spec_ord", "message")

"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into segments, and each segment has a table from its value to the fingerprints that hold it.
Two fingerprints that differ in at most ``bits`` bits are near in at least one segment: with radius s and remainder a of
bits / segments, in one of the first a + 1 segments by s bits or in one of the others by s - 1. A search enumerates the
Hamming ball of that radius within each segment, fetches what the tables hold there, and verifies the complete distance.
Of two values of a segment only the one with a zero in their lowest different bit looks up the other.

A table entry of more than ``BUCKET`` fingerprints, as a large group of near copies makes it, is not fetched as a whole:
those that hold or look up such an entry are split by the rest of the code. They meet at the codes halfway between them,
where at most 65 fingerprints can be, and link to the smallest there; any two of them are two such links apart, so no
connection is lost and no pairs of a large group are made.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .common import join_counted, map_batches, read_by_rows, spread_rows, table

SEED, SHINGLE, MOST_BITS, SEGMENTS, BUCKET = 42, 3, 2, 2, 64
_MAX_CHUNK = 1 << 18


def shingle_hashes(text: str | None, words: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of the word shingles of ``text``, repeats included; no words: none; fewer words than a shingle: all of them as one."""
    parts = ("" if text is None else text).encode().lower().split()  # bytes: A-Z only, and \x20\x09-\x0D only
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64)


def code_of(hashes: np.ndarray) -> int:
    """The SimHash of 64-bit hashes: a bit is 1 if it is set in over half of them; none: 0."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, _MAX_CHUNK):
        chunk = hashes[at : at + _MAX_CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(chunk, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of ``text``, repeats included; no words: 0; fewer words than a shingle: all of them as one."""
    return code_of(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_type: str = "long") -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of every row; null text counts as empty."""

    def run(batch):
        out = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["id", "fp"])

    return map_batches(docs.select(F.col(id_col).cast(key_type).alias("id"), F.col(text_col).alias("text")), run, f"id {key_type}, fp long")


def radii(bits: int, segments: int) -> list[int]:
    """The radius to search in each segment; -1: a segment that needs no table."""
    near, more = divmod(bits, segments)
    return [near if s <= more else near - 1 for s in range(segments)]


def _cuts(segments: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each segment."""
    ends = [64 * s // segments for s in range(segments + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in on) for n in range(radius + 1) for on in combinations(range(width), n)]


def _signed(code: int) -> int:
    return code - (1 << 64) if code >> 63 else code


def _entry(code: Column, s: int, first: int, width: int) -> Column:
    """The table entry of segment ``s``: its value, with the segment's number above it."""
    value = F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    return value.bitwiseOR(F.lit(s << 33).cast("long"))


def _balls(code: Column, bits: int, segments: int) -> Column:
    """The entries to look up: in each segment its own value and those within the radius above it, null for those below."""
    out = []
    for s, ((first, width), radius) in enumerate(zip(_cuts(segments), radii(bits, segments))):
        own = _entry(code, s, first, width)
        for mask in _masks(width, radius) if radius >= 0 else []:
            flipped = own.bitwiseXOR(F.lit(mask).cast("long"))
            out.append(F.when(own.bitwiseAND(F.lit(mask & -mask).cast("long")) == 0, flipped) if mask else own)
    return F.array(*out)


def _code_links(codes: DataFrame, bits: int, segments: int, bucket: int) -> DataFrame:
    """Links (a, b), a < b, between the different codes (fp)."""
    if segments < 2 or bits % 2:
        raise ValueError("at least two segments, and an even number of bits")
    cuts, needed = _cuts(segments), radii(bits, segments)
    own = [_entry(F.col("fp"), s, *cuts[s]) for s in range(segments) if needed[s] >= 0]
    entries = codes.select(F.explode_outer(F.array(*own)).alias("entry"), "fp")
    # outer generators here and below: for others Spark computes the arrays once more to filter empty ones
    probes = codes.select(F.explode_outer(_balls(F.col("fp"), bits, segments)).alias("entry"), "fp").filter("entry is not null")
    large = cut_lineage(entries.groupBy("entry").count().filter(F.col("count") > bucket).select("entry"))
    distance = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    fetched = probes.join(large, "entry", "left_anti").join(entries.withColumnRenamed("fp", "other"), "entry")
    found = fetched.filter((F.col("fp") != F.col("other")) & (distance("fp", "other") <= bits)).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    split = probes.join(large, "entry", "left_semi").select("fp").distinct()
    around = F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(m)).cast("long")) for m in _masks(64, bits // 2)])
    halfway = split.select("fp", F.explode_outer(around).alias("code"))
    met = halfway.groupBy("code").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("members")).filter(F.size("members") > 1)
    star = met.select("a", F.explode("members").alias("b")).filter((F.col("a") != F.col("b")) & (distance("a", "b") <= bits))
    return found.unionByName(star).distinct()


def links(classes: DataFrame, bits: int = MOST_BITS, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b), a < b, between class representatives of (node, fp), one per fingerprint, that differ in at most ``bits`` bits.

    They hold at least one path between any two representatives within that distance, and no link beyond it. Neither
    ``segments`` nor ``bucket`` changes what is connected.
    """
    found = _code_links(classes.select("fp"), bits, segments, bucket)
    for end in ("a", "b"):
        found = found.join(classes.select(F.col("fp").alias(end), F.col("node").alias(f"node_{end}")), end)
    return found.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node that can be reached.

    Alternating large-star and small-star rounds; each is sums by key and joins, written to the shared checkpoint
    folder, until the set of links no longer changes. Stored links are read by as many tasks as their number asks for.
    """
    edges = read_by_rows(cut_lineage(edges.filter("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct()))
    mark = None
    for _ in range(most_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b")  # no more than there were; the next step drops repeated ones
        large = read_by_rows(cut_lineage(large), None if mark is None else mark[0])
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct()
        stored = cut_lineage(small)
        now = stored.coalesce(stored.sparkSession.sparkContext.defaultParallelism).agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        edges = read_by_rows(stored, now.n)
        if (now.n, now.s) == mark:
            return edges.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
        mark = (now.n, now.s)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) for every row of ``docs``; a component is the smallest id that can be reached.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows come out as often as they came in.
    Rows with a null id link like any other, also two others that are near to them alone; they do not name a component, which
    is null only where no row of it has an id. An empty table gives an empty result.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col))
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows_of_key")))
    nodes = cut_lineage(spread_rows(classes.select(F.col("fp").alias("node"), "fp")))
    labels = components(links(nodes))
    named = cut_lineage(classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component"))
    roots = named.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("rows_of_key"))
    told = join_counted(named.select("root", "fp", F.col("rows_of_key").alias("n")), roots, ["root"]).select("fp", "component", F.col("n").alias("rows_of_key"))
    return join_counted(prints, told, ["fp"]).select("id", "fp", "component")


def code_groups(rows: DataFrame) -> DataFrame:
    """(id, h, component) of every row of (id, h, text), by fingerprints; a component is its least fingerprint."""
    prints = cut_lineage(fingerprints(rows.select(F.struct("id", "h").alias("key"), "text"), "key", key_type="struct<id:long,h:long>"))
    labels = components(links(prints.select(F.col("fp").alias("node"), "fp").distinct()))
    found = prints.join(labels, prints.fp == labels.node, "left")
    return found.select("id.id", "id.h", F.coalesce("component", "fp").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups=code_groups) -> DataFrame:
    """Of each component of near copies the row with the smallest id; of rows that repeat it, one stays.

    A row is known by its id and a hash of its text, so other texts under the same id stand for themselves. Rows without
    an id are near copies like any other; one of them stays only where no row of its component has an id. ``groups``
    gives (id, h, component) of every row of (id, h, text).
    """
    own = F.xxhash64(text_col)
    found = groups(docs.select(F.col(id_col).cast("long").alias("id"), own.alias("h"), F.col(text_col).alias("text")))
    keys = cut_lineage(found.groupBy("component", "id", "h").count())
    best = keys.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h")).alias("best"))
    keys = cut_lineage(keys.join(best, "component").withColumn("stays", F.col("id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h"))))
    named = lambda which: keys.filter(which).select(F.col("id").alias("__id"), F.col("h").alias("__h"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (own == F.col("__h"))
    kept = docs.join(named("not stays"), same, "left_anti")
    repeated = named("stays and count > 1")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, same, "left_semi").withColumn("__own", own).dropDuplicates([id_col, "__own"]).drop("__own")
    return kept.join(repeated, same, "left_anti").unionByName(again)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: doc_id, fingerprint, component_id.

    Null and empty texts have fingerprint zero and link like any other; equal fingerprints are linked; null ids link but do not
    name a component; null and repeated ids come out as they came in; an empty table gives an empty result.
    """
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))

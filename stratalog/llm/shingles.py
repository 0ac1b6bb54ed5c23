"""Near copies by SimHash and multi-index hashing, with the Jaccard similarity of word shingles as the exact check.

The fingerprints of the texts' sets of shingles are linked by the segment tables of ``simhash``; a link stays if the sets are near
enough. No bit radius bounds the similarity, so what fingerprints have not linked is looked for by the shingles themselves.

Two sets of similarity ``least`` or more share a shingle among the first ``n - ceil(least * n) + 1`` of each, whatever
order all sets are sorted in. Shingles that are common in a sample of the texts come last in that order, so a line that
many texts hold rarely brings them together. Sets that meet are compared in full. First all sets that share
a shingle are compared with one or two of them, one of which has the fewest shingles of its own and so stands in the
middle of a group of edited copies; then every two that no link has joined yet and that can share enough, so no
connection is lost. What two near sets share begins, in the order, with a shingle that stands among the first of both,
and is no more than what follows it in either. So two sets meet at a shingle only if that is enough: copies with many
edits have their own shingles first and do not meet at those of their group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut_lineage, release
from . import simhash
from .common import broadcast_if_small, map_batches, read_by_rows, spread_rows
from .simhash import components, shingle_hashes

WORDS, LEAST, SEED = 5, 0.8, 42
#: Every ``SAMPLE``-th text tells which shingles are common; any choice of them gives the same result.
SAMPLE, COMMON, MOST_COMMON, STARS = 16, 3, 50_000, 2


def shingle_set(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of ``text``; no words: none; fewer words than a shingle: all of them as one."""
    return np.unique(shingle_hashes(text, words, seed).view(np.int64))


def _needed(n: int, least: float) -> int:
    return int(np.ceil(least * n - 1e-9))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]), pa.int64()))


def common_shingles(rows: DataFrame, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the shingles that several texts of a sample of (h, text) hold, the most common ``MOST_COMMON`` at most."""

    def run(batch):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(shingle_set(t.as_py(), words) for t in batch.column(0))]))], names=["t"])

    texts = rows.filter(F.pmod("h", F.lit(SAMPLE)) == 0).dropDuplicates(["h"]).select("text")
    found = map_batches(texts, run, "t long").groupBy("t").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "t").limit(MOST_COMMON)
    return np.sort(np.array([r.t for r in found.select("t").collect()], np.int64))


def prefixes(rows: DataFrame, common: np.ndarray, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(id, h, node, fp, n, own, prefix) of every row of (id, h, text): a hash of its set, its set's fingerprint and size, how many shingles are not common, and the first ones."""
    sent = rows.sparkSession.sparkContext.broadcast(common)

    def run(batch):
        last, nodes, codes, sizes, owns, found = sent.value, [], [], [], [], []
        for t in batch.column(2):
            s = shingle_set(t.as_py(), words)
            at = np.searchsorted(last, s)
            late = last[np.minimum(at, len(last) - 1)] == s if len(last) else np.zeros(len(s), bool)
            n = len(s)  # a smaller set has no other near enough
            found.append(np.concatenate((s[~late], s[late]))[: n - _needed(n, least) + 1] if n >= least * (n + 1) - 1e-9 else s[:0])
            nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
            codes.append(simhash.code_of(s.view(np.uint64)))
            sizes.append(n)
            owns.append(int(np.count_nonzero(~late)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(np.array(c, np.uint64).view(np.int64)) for c in (nodes, codes)), pa.array(sizes, pa.int64()), pa.array(owns, pa.int64()), _lists(found)],
            names=["id", "h", "node", "fp", "n", "own", "prefix"],
        )

    return map_batches(rows.select("id", "h", "text"), run, "id long, h long, node long, fp long, n long, own long, prefix array<long>")


def _buckets(prints: DataFrame) -> DataFrame:
    """The different groups of nodes that share a first shingle: each as a list (members), the places of the shingle in them
    (at; of several shingles the first), how many shingles the group shares (w), and the member with the fewest of its own (leader).

    All sets are in one order, so of several shingles of a group one comes first in every member.
    """
    posted = prints.select("node", F.col("own"), F.posexplode("prefix").alias("at", "t")).select("t", F.struct("node", (F.shiftleft("own", 31) + F.col("at")).alias("o")).alias("m"))
    met = posted.groupBy("t").agg(F.sort_array(F.collect_set("m")).alias("m")).filter(F.size("m") > 1)
    central = F.array_min(F.transform("m", lambda x: F.struct(F.shiftright(x["o"], 31).alias("own"), x["node"].alias("node"))))["node"]
    at = F.transform("m", lambda x: x["o"].bitwiseAND(F.lit((1 << 31) - 1).cast("long")).cast("int"))
    told = met.select(F.transform("m", lambda x: x["node"]).alias("members"), at.alias("at"), central.alias("leader"))
    return told.groupBy("members").agg(F.min("at").alias("at"), F.min("leader").alias("leader"), F.count("*").alias("w"))


def sets_of(rows: DataFrame, keys: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, shingles) for every row of ``keys`` (id, h, node), from (id, h, text)."""
    told = keys.select(F.col("id").alias("k_id"), F.col("h").alias("k_h"), "node")
    texts = rows.join(told, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h"))).select("node", "text")

    def run(batch):
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_set(t.as_py(), words) for t in batch.column(1)])], names=["node", "shingles"])

    return map_batches(texts, run, "node long, shingles array<long>").dropDuplicates(["node"])


def _able(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b, w) that can be near, if they share ``w`` of their first shingles.

    A shingle that both sets hold stands in both prefixes or beyond the prefix that ends first.
    """
    left, right = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("p").alias(f"p_{x}")) for x in "ab")
    near = F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9
    enough = F.col("w") + F.greatest(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) >= (F.col("n_a") + F.col("n_b")) * (least / (1 + least)) - 1e-6
    return pairs.join(left, "a").join(right, "b").filter(near & enough).select("a", "b")


def _able_by_prefixes(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) that can be near by all that their first shingles share; a fifth of the sets is read for it."""
    pairs = read_by_rows(pairs)
    keys = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    first = cut_lineage(prints.select("node", "n", "prefix").join(keys, "node", "left_semi").dropDuplicates(["node"]))
    left, right = (first.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("prefix").alias(f"f_{x}")) for x in "ab")
    shared = F.size(F.array_intersect("f_a", "f_b")) + F.greatest(F.col("n_a") - F.size("f_a"), F.col("n_b") - F.size("f_b"))
    return cut_lineage(pairs.join(left, "a").join(right, "b").filter(shared >= (F.col("n_a") + F.col("n_b")) * (least / (1 + least)) - 1e-6).select("a", "b"))


def _alike(able: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets have similarity ``least`` or more."""
    able = read_by_rows(able)
    keys = able.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "k.id", "k.h"), "node")
    sets = cut_lineage(sets_of(rows, broadcast_if_small(cut_lineage(keys)), words))
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab")
    both = able.join(left, "a").join(right, "b").select("a", "b", (F.size("s_a") + F.size("s_b")).alias("n"), F.size(F.array_intersect("s_a", "s_b")).alias("shared"))
    return cut_lineage(both.filter(F.col("shared") >= least * (F.col("n") - F.col("shared")) - 1e-9).select("a", "b"))


def fingerprint_pairs(nodes: DataFrame, bits: int = simhash.MOST_BITS, segments: int = simhash.SEGMENTS) -> DataFrame:
    """Pairs (a, b), a < b, of the nodes (node, fp, n) that the segment tables link at ``bits`` or fewer different bits; equal fingerprints link to one of them."""
    heads = cut_lineage(spread_rows(cut_lineage(nodes.groupBy("fp").agg(F.min("node").alias("node")))))
    same = nodes.select("fp", F.col("node").alias("b")).join(heads.withColumnRenamed("node", "a"), "fp").filter("a <> b").select("a", "b")
    return cut_lineage(simhash.links(heads, bits, segments).unionByName(same))


def near_groups(rows: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(id, h, component) of every row of (id, h, text): one component for rows that a chain of near copies joins.

    Texts without words are copies of each other. Repeated rows come out as often as they came in.
    """
    prints = cut_lineage(prefixes(rows, common_shingles(rows, words), words, least))
    nodes = cut_lineage(prints.groupBy("node").agg(F.min(F.struct("id", "h")).alias("k"), F.max("fp").alias("fp"), F.max("n").alias("n"), F.max(F.size("prefix")).alias("p")))
    by_code = fingerprint_pairs(nodes)
    buckets = cut_lineage(_buckets(prints))
    release(rows.sparkSession)
    met = buckets.select(F.explode("members").alias("node")).distinct()
    nodes = cut_lineage(nodes.join(met, "node", "left_semi"))
    pair = (F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    # stars count only the shingles of buckets that one of the two leads; what they leave out by that is left to the last round
    star = lambda k: F.array_max(F.transform("members", lambda x: F.struct(F.xxhash64(x, F.lit(k)).alias("x"), x.alias("other"))))["other"]
    stars = buckets.select("members", "w", F.explode(F.array_distinct(F.array(F.col("leader"), *[star(k) for k in range(1, STARS)]))).alias("other"))
    stars = stars.select("w", "other", F.explode("members").alias("node")).filter("node <> other").select(*pair, "w").groupBy("a", "b").agg(F.sum("w").alias("w"))
    # links by fingerprints and stars are compared together, so sets are read once for both; a node that has met none is near to none
    tried = cut_lineage(by_code.unionByName(_able(stars, nodes, least)).distinct())
    labels = components(_alike(tried, nodes, rows, words, least))
    release(rows.sparkSession)
    told = nodes.select("node", "n").join(labels, "node", "left").select("node", "n", F.coalesce("component", "node").alias("c"))
    held = buckets.select(F.xxhash64("members").alias("t"), F.explode(F.arrays_zip("members", "at")).alias("m")).select("t", F.col("m.members").alias("node"), F.col("m.at").alias("at"))
    held = cut_lineage(held.join(told, "node").select("t", "node", "c", "n", (F.col("n") - F.col("at")).alias("most")))
    part = least / (1 + least)
    apart = held.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("smallest")).filter("lo < hi").select("t", "smallest")
    held = held.join(apart, "t").filter(F.col("most") >= (F.col("n") + F.col("smallest")) * part - 1e-6).drop("smallest")
    others = held.select("t", F.col("node").alias("other"), F.col("c").alias("d"), F.col("n").alias("m"), F.col("most").alias("most_m"))
    near = (F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9) & (F.least("most", "most_m") >= (F.col("n") + F.col("m")) * part - 1e-6)
    last = cut_lineage(held.join(others, "t").filter((F.col("c") < F.col("d")) & near).select(*pair).distinct().join(tried, ["a", "b"], "left_anti"))
    if not last.isEmpty():
        last = _able_by_prefixes(last, prints, least)
        release(rows.sparkSession)
        joined = labels.select(F.col("component").alias("a"), F.col("node").alias("b"))
        labels = components(joined.unionByName(_alike(last, nodes, rows, words, least)))
    release(rows.sparkSession)
    out = prints.select("id", "h", "node").join(labels, "node", "left")
    return out.select("id", "h", F.coalesce("component", "node").alias("component"))

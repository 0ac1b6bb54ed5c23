"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words and the first 4, 5 and 6 letters of longer ones, after lower-casing, each hashed into
2^60 slots; a term is present or absent, however long the text. Every slot whose presence says something about the label
by a likelihood-ratio test becomes a feature. The machine has a bias, a weight per feature and a vector of factors per
feature, whose inner products weigh pairs of features that occur together, such as an insult with a group mention.

The machine is fitted on a bounded sample: at most ``sample`` labelled rows, the first by a hash of their id and text.
The slots of its texts are all there can be of features, and what is sent to the driver is bounded by it. ``least_texts``
and ``least_ratio`` are the parameters of the test; the README has the recall for other values. Scoring reads every
whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .common import map_batches, table

SAMPLE, FACTORS, LEAST_TEXTS, LEAST_RATIO, FOLDS = 16_000, 4, 3, 24.0, 5
LEAST_SHARE = 1e-3
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+")
_SLOTS = (1 << 60) - 1


def slots(word: str) -> list[int]:
    """The hashed terms of a lower-case word."""
    names = [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n)]
    return [xxhash.xxh64_intdigest(x.encode(), 7) & _SLOTS for x in names]


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


class _Slots(dict):
    """word -> what ``make`` gives for its slots; emptied when it has grown large."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) > 400_000:
            self.clear()
        self[word] = out = self.make(slots(word))
        return out


@dataclass(frozen=True)
class Machine:
    """``at`` gives a slot's feature; score = 1 / (1 + exp(-(bias + sum w + sum of pairs <v_i, v_j>)))."""

    at: dict[int, int]
    bias: float
    w: np.ndarray
    v: np.ndarray

    def scorer(self):
        seen = _Slots(lambda own: tuple(f for s in own if (f := self.at.get(s)) is not None))

        def score(text: str | None) -> float:
            found: set[int] = set()
            for x in words(text):
                found.update(seen[x])
            if not found:
                return float(1 / (1 + np.exp(-self.bias)))
            f = np.fromiter(found, np.int64, len(found))
            f.sort()
            v = self.v[f]
            z = self.bias + self.w[f].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def train(features: list[np.ndarray], labels: np.ndarray, n: int, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4, seed: int = 1) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, weights, factors) of the documents with these features, by Adam on the whole sample."""
    doc = np.repeat(np.arange(len(features)), [len(f) for f in features])
    feat = np.concatenate([*features, np.zeros(0, np.int64)]).astype(np.int64)
    rng = np.random.default_rng(seed)
    share = min(max(float(labels.mean()) if len(labels) else 0.0, LEAST_SHARE), 1 - LEAST_SHARE)
    p = [np.array([np.log(share / (1 - share))]), np.zeros(n), rng.normal(0, 0.01, (n, FACTORS))]
    m, s = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    d = len(features)
    for t in range(1, rounds + 1 if d else 1):
        v = p[2][feat]
        total = np.column_stack([np.bincount(doc, v[:, k], d) for k in range(FACTORS)]) if len(feat) else np.zeros((d, FACTORS))
        squares = np.bincount(doc, (v**2).sum(axis=1), d)
        z = p[0][0] + np.bincount(doc, p[1][feat], d) + 0.5 * ((total**2).sum(axis=1) - squares)
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / d
        by_pair = e[doc]
        g = [np.array([e.sum()]), np.bincount(feat, by_pair, n) + decay / d * p[1]]
        g.append(np.column_stack([np.bincount(feat, by_pair * (total[doc, k] - v[:, k]), n) for k in range(FACTORS)]) + decay / d * p[2])
        for i in range(3):
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            s[i] = 0.999 * s[i] + 0.001 * g[i] ** 2
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-10)
    return float(p[0][0]), p[1], p[2]


def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by FOLDS; a null id is not held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(id, text, label), stored: the different texts of the documents with a label, ``sample`` at most. Those held out are left out.

    Repeated labels count as the highest of them; null ids and labels do not count. Rows that repeat an id and its text
    count once; other texts under the same id count as rows of their own.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    first = cut_lineage(known.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample).drop("h"))
    told = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(first), "id").withColumn("h", F.xxhash64("text"))
    told = cut_lineage(told.groupBy("id", "h").agg(F.first("text").alias("text"), F.first("label").alias("label")))
    keys = cut_lineage(told.select("id", "h").orderBy(F.xxhash64("id", "h"), "id", "h").limit(sample))
    return cut_lineage(told.join(F.broadcast(keys), ["id", "h"]).select("id", "text", "label"))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, least_texts: int = LEAST_TEXTS, least_ratio: float = LEAST_RATIO
) -> Machine:
    """The machine for the labelled documents that are not held out.

    Without any labelled document there is nothing to tell by: every score is that of the least share, far under a half.
    With labels of one kind only, every score is their smoothed share.
    """
    texts = labelled(docs, labels, id_col, text_col, label_col, sample)

    def count(batches):
        for b in batches:
            cache, seen, toxic = _Slots(tuple), [], []
            for text, label in zip(b.column(0), b.column(1).to_pylist()):
                own = {s for x in words(text.as_py()) for s in cache[x]}
                seen.append(np.fromiter(own, np.int64, len(own)))
                toxic.append(np.full(len(own), label > 0))
            slot, at, n = np.unique(np.concatenate([*seen, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
            pos = np.bincount(at, np.concatenate([*toxic, np.zeros(0, bool)]), len(slot)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"slot": slot, "n": n.astype(np.int64), "pos": pos})

    sums = texts.agg(F.count("*").alias("n"), F.sum((F.col("label") > 0).cast("long")).alias("pos")).first()
    total, toxic = sums.n, sums.pos or 0
    if not total:
        return Machine({}, float(np.log(LEAST_SHARE / (1 - LEAST_SHARE))), np.zeros(0), np.zeros((0, FACTORS)))
    if not toxic or toxic == total:
        return Machine({}, float(np.log((toxic + 0.5) / (total - toxic + 0.5))), np.zeros(0), np.zeros((0, FACTORS)))
    counts = texts.select("text", "label").mapInArrow(count, "slot long, n long, pos long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).filter(F.col("n") >= least_texts)
    cell = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    n, pos = F.col("n").cast("double"), F.col("pos").cast("double")
    table_ = [(pos, n * toxic / total), (n - pos, n * (total - toxic) / total), (toxic - pos, (total - n) * toxic / total), ((total - n) - (toxic - pos), (total - n) * (total - toxic) / total)]
    ratio = 2 * sum((cell(k, e) for k, e in table_), F.lit(0.0))
    best = counts.withColumn("ratio", ratio).filter(F.col("ratio") >= least_ratio).select("slot").orderBy("slot").collect()
    at = {r.slot: k for k, r in enumerate(best)}

    def chosen(batch):
        cache = _Slots(lambda own: tuple(f for s in own if (f := at.get(s)) is not None))
        found = [sorted({f for x in words(t.as_py()) for f in cache[x]}) for t in batch.column(1)]
        yield pa.RecordBatch.from_pydict({"id": batch.column(0), "label": batch.column(2), "f": pa.array(found, pa.list_(pa.int64()))})

    rows = map_batches(texts, chosen, "id long, label int, f array<long>").orderBy("id", "f").collect()
    bias, w, v = train([np.array(r.f, np.int64) for r in rows], np.array([float(r.label > 0) for r in rows]), len(at))
    return Machine(at, bias, w, v)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row; empty and null texts get the bias alone. Repeated rows are scored each."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        f = model.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f(t.as_py()) for t in b.column(1)], pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores under ``threshold``; all rows if no document is labelled."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    def run(batches):
        f = model.value.scorer()
        for b in batches:
            column = b.column(b.schema.get_field_index(text_col))
            yield b.filter(pa.array([f(t.as_py()) < threshold for t in column], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document: doc_id, held_out, score, predicted.

    Null and empty texts score the bias alone. Null ids are not held out; null and repeated ids come out as they came in;
    an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Mixing sources to target weights by cube-method balanced sampling.

Each source's target, divided by its size, is the number of times that each of its words is to be taken: whole copies
and a fraction. The fractions are inclusion probabilities. The cube method moves them through the null space of the
balancing constraints (tokens and documents), so that both totals stay put while one probability after another lands
on 0 or 1. A source is cut into blocks of bounded size; each block ends with at most two probabilities between 0 and
1, which form the blocks of the next round, until one block is left; its last few are the landing problem.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .common import running, table

WEIGHTS, SHARE, MOST_COPIES, BLOCK, HELD, SEED = (3, 1, 2), 1.5, 2, 2048, 12, 42
#: Rows that one task moves through its blocks.
TASK = 8 * BLOCK
_EPS = 1e-9


def word_count(text: Column) -> Column:
    """Number of runs of [^\\x20\\x09-\\x0D]; null has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) of (source, size), one row per source.

    Sources by code point, null last, have the weights in turn, and share ``share`` of all sizes; a target stops at
    ``most`` times its source's size, and the excess is shared again by weight. That is one level for all: with the
    sources in the order in which they reach their stop, the level is the first at which no more of them do.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    s = running(s, ["last", "source"], {"number": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    s = s.withColumn("w", weight).withColumn("stop", F.lit(float(most)) * F.col("source_size")).withColumn("reach", F.col("stop") / F.col("w"))
    s = cut_lineage(running(s, ["reach", "last", "source"], {"at": F.lit(1), "stops": F.col("stop"), "ws": F.col("w")}))
    every = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
    level = (F.lit(float(share) * every["size"]) - F.col("stops")) / (F.lit(every["w"]) - F.col("ws"))
    first = s.withColumn("level", level).filter(F.col("level") * F.col("w") <= F.col("stop") * (1 + 1e-12)).agg(F.min(F.struct("at", "level")).alias("first")).first()["first"]
    goal = F.least("stop", F.lit(first["level"]) * F.col("w")) if first else F.col("stop")
    return s.select("source", "source_size", goal.alias("target"))


def _unit(ids: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on id and salt only (splitmix64)."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64((salt * 2 + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def flight(pi: np.ndarray, x: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """The flight phase: at most two of the probabilities ``pi`` stay between 0 and 1; sum(pi) and sum(pi * x) stay put."""
    pi, scale = pi.astype(float).copy(), max(1.0, float(np.abs(x).max(initial=0)))
    active: list[int] = []
    for i in np.flatnonzero((pi > _EPS) & (pi < 1 - _EPS)).tolist():
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = (x[j] / scale for j in active)
        u = np.array([b - c, c - a, a - b])  # null vector of the rows (1, 1, 1) and (a, b, c)
        if np.abs(u).max() < 1e-12:
            u = np.array([1.0, -1.0, 0.0])
        p = pi[active]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)).min()
            down = np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)).min()
        p = p + u * up if chance[i] < down / (up + down) else p - u * down
        p[p < _EPS], p[p > 1 - _EPS] = 0.0, 1.0
        pi[active] = p
        active = [j for j, v in zip(active, p) if 0 < v < 1]
    return pi


def landing(pi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rounds the few probabilities left: of all choices, the one whose token total and, at a twentieth of that weight, document total are nearest."""
    left = np.flatnonzero((pi > _EPS) & (pi < 1 - _EPS))
    if len(left) == 0:
        return pi
    choices = np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1
    tokens = np.abs(choices @ x[left] - float(pi[left] @ x[left])) / max(1.0, float(np.abs(x).mean()))
    docs = np.abs(choices.sum(axis=1) - float(pi[left].sum()))
    out = pi.copy()
    out[left] = choices[int(np.argmin(tokens + docs / 20))]
    return out


def last_block(pi: np.ndarray, x: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Flight of all but ``HELD`` small documents, then the landing of those and of what the flight left."""
    open_ = np.flatnonzero((pi > _EPS) & (pi < 1 - _EPS))
    by_size = open_[np.argsort(x[open_], kind="stable")]
    small = by_size[x[by_size] > 0][: max(HELD, len(by_size) // 2)]
    held = small[:: max(1, len(small) // HELD)][:HELD]
    rest = pi.copy()
    rest[held] = 0
    out = flight(rest, x, chance)
    out[held] = pi[held]
    return landing(out, x)


def _round(last: bool, salt: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("id", "ascending"), ("size", "ascending"), ("nth", "ascending")])
        row, size = rows.column("row").to_numpy(), rows.column("size").to_numpy()
        ids = rows.column("id").fill_null(-1).to_numpy()
        pi = (last_block if last else flight)(rows.column("pi").to_numpy(), size, _unit(ids ^ (np.arange(len(ids)) << 40), salt))
        return pa.table({"row": row, "id": rows.column("id"), "source": rows.column("source"), "size": size, "nth": rows.column("nth"), "pi": pi})

    return run


def _told_apart(rows: DataFrame) -> DataFrame:
    """The rows with ``nth``: 0, or the number of the row among those that repeat its source, id and size.

    So rows that repeat each other are dealt over blocks like any others, in the same way whatever their places.
    """
    key = ["source", "id", "size"]
    twice = cut_lineage(rows.groupBy(*key).count().filter("count > 1").select(*[F.col(c).alias(f"k_{c}") for c in key]))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in key])
    if twice.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    placed = running(rows.join(twice, same, "left_semi"), [*key, "row"], {"place": F.lit(1).cast("long")})
    first = placed.groupBy(*key).agg(F.min("place").alias("first")).select(*[F.col(c).alias(f"k_{c}") for c in key], "first")
    again = placed.join(first, same).withColumn("nth", F.col("place") - F.col("first")).select("row", "id", "source", "size", "pi", "nth")
    return cut_lineage(rows.join(twice, same, "left_anti").withColumn("nth", F.lit(0).cast("long")).unionByName(again))


def _blocks(open_: DataFrame) -> tuple[int, int]:
    """How many blocks the largest source needs, and how many tasks of ``TASK`` rows all rows need."""
    most, rows = open_.groupBy("source").count().agg(F.max("count"), F.sum("count")).first()
    return -(-(most or 0) // BLOCK), -(-(rows or 0) // TASK)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row, id, source, size, source_size, target, copies, taken) for every row of ``docs``, and its columns ``keep``.

    Null and empty texts have size 0 and may be taken any number of times at no cost. A null source is a source of its
    own. Rows that repeat an id are sampled one by one. With no words at all every target is 0 and nothing is taken.
    Results depend on ids, sizes and sources alone, so reruns agree.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *keep)
    sized = cut_lineage(sized.withColumn("row", F.monotonically_increasing_id()))
    goals = cut_lineage(targets(sized).withColumnRenamed("source", "goal_source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    with_rate = sized.join(F.broadcast(goals) if goals.limit(10_001).count() <= 10_000 else goals, F.col("source").eqNullSafe(F.col("goal_source"))).withColumn("rate", rate)
    parts = with_rate.withColumn("whole", F.floor(F.col("rate") + _EPS)).withColumn("pi", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole"))).drop("goal_source")
    parts = cut_lineage(parts)
    open_ = _told_apart(parts.filter(F.col("pi") > _EPS).select("row", "id", "source", "size", "pi"))
    blocks, tasks = _blocks(open_)
    decided, depth = None, 0
    while blocks:
        per_source = open_.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).alias("n")).withColumnRenamed("source", "n_source")
        dealt = open_.join(per_source, F.col("source").eqNullSafe(F.col("n_source"))).withColumn("block", F.pmod(F.xxhash64("id", "size", "nth", F.lit(seed + depth)), F.col("n")))
        dealt = dealt.repartition(tasks, "source", "block")  # a block is little data and much work
        done = cut_lineage(dealt.groupBy("source", "block").applyInArrow(_round(blocks == 1, seed + depth), "row long, id long, source string, size long, nth long, pi double"))
        settled = done.filter(f"pi <= {_EPS} or pi >= {1 - _EPS}").select("row", F.round("pi").cast("long").alias("extra"))
        decided = settled if decided is None else decided.unionByName(settled)
        if blocks == 1:
            break
        open_, depth = done.filter(f"pi > {_EPS} and pi < {1 - _EPS}"), depth + 1
        blocks, tasks = _blocks(open_)
    out = parts if decided is None else parts.join(decided, "row", "left")
    copies = F.col("whole").cast("long") + (F.coalesce(F.col("extra"), F.lit(0)) if decided is not None else F.lit(0))
    return out.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size")).select("row", "id", "source", "size", "source_size", "target", "copies", "taken", *keep)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document: doc_id, size, source_size, target, taken.

    Null and empty texts have size 0; a null source is a source of its own, last in order; null and repeated ids are
    sampled row by row; with no words every target is 0; an empty table gives an empty result.
    """
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")

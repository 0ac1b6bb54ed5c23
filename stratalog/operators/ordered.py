"""Folds over rows in a total order, by ranges: no task sees all rows, and what reaches the driver follows the number of parts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut_lineage

#: Pieces of one part's transfer at most; a part with more is read once what comes in is known.
PIECES = 50_000


def by_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """``df``, stored in parts that are ranges of the order, each sorted; ``__part`` numbers them in order."""
    return cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))


def running(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of its column over all rows before this one in the order."""
    parted = by_ranges(df, order)
    one = parted.groupBy("__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    one = one.select("__part", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parted.join(F.broadcast(one), "__part")
    return out.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"__{n}") for n, c in sums.items()}).drop("__part", *[f"__{n}" for n in sums])


def transfer(needs, nets, limit: int, most: int = PIECES) -> list[tuple[int, int]] | None:
    """What a run of requests makes of any total that comes in: (first total, what is added) of each piece of 0..limit.

    A request is granted if the total and what it needs stay within the limit; the total then grows by its net. None if
    there are more than ``most`` pieces.
    """
    first, add = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for need, net in zip(needs, nets):
        if not need:
            continue
        last = np.append(first[1:] - 1, limit)
        edge = limit - need - add  # the highest total that comes in and is granted
        split = (first <= edge) & (edge < last)
        granted = last <= edge
        added = np.where(granted | split, add + net, add)
        if split.any():
            at = np.flatnonzero(split) + 1
            first, added = np.insert(first, at, edge[split] + 1), np.insert(added, at, add[split])
        keep = np.append(True, added[1:] != added[:-1])
        first, add = first[keep], added[keep]
        if len(first) > most:
            return None
    return list(zip(first.tolist(), add.tolist()))


def granted(needs, nets, limit: int, total: int) -> tuple[list[bool], list[int], int]:
    """(whether each request is granted, the total before it, the total in the end)."""
    ok, before = [], []
    for need, net in zip(needs, nets):
        before.append(total)
        ok.append(total + need <= limit)
        total += net if ok[-1] else 0
    return ok, before, total


def budgeted(requests: DataFrame, order: list[str], limit: int, most: int = PIECES) -> DataFrame:
    """``requests`` (need long, net long, ...) in their order against one budget: with ``granted`` and the total ``before`` each.

    What is refused takes nothing, so a running sum would be wrong. Every part first tells what it makes of any total that
    comes in; these functions are put together, part after part, and then every part knows its own.
    """
    parted = by_ranges(requests, order)

    def told(batches):
        part, needs, nets = None, [], []
        for b in batches:
            part = b.column(2)[0].as_py() if b.num_rows else part
            needs += b.column(0).to_pylist()
            nets += b.column(1).to_pylist()
        if part is not None:
            pieces = transfer(needs, nets, limit, most)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "pieces": pa.array([pieces and [{"first": a, "add": c} for a, c in pieces]], pa.list_(pa.struct([("first", pa.int64()), ("add", pa.int64())])))})

    def end(batches, total):
        for b in batches:
            total = granted(b.column(0).to_pylist(), b.column(1).to_pylist(), limit, total)[2]
        yield pa.RecordBatch.from_pydict({"total": [total]})

    columns = parted.select("need", "net", "__part")
    incoming, total = {}, 0
    for r in columns.mapInArrow(told, "part int, pieces array<struct<first:long,add:long>>").orderBy("part").toLocalIterator():
        incoming[r.part] = total
        if r.pieces is None:
            start = total
            total = max(x.total for x in columns.filter(F.col("__part") == r.part).mapInArrow(lambda b, t=start: end(b, t), "total long").collect())
        else:
            total += r.pieces[int(np.searchsorted([p["first"] for p in r.pieces], total, side="right")) - 1]["add"]

    at, need, net = (parted.columns.index(c) for c in ("__part", "need", "net"))

    def decided(batches):
        total = None
        for b in batches:
            if b.num_rows:
                total = incoming[b.column(at)[0].as_py()] if total is None else total
                ok, before, total = granted(b.column(need).to_pylist(), b.column(net).to_pylist(), limit, total)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok), pa.array(before, pa.int64())], names=[*b.schema.names, "granted", "before"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parted.schema)
    return cut_lineage(parted.mapInArrow(decided, f"{schema}, granted boolean, before long").drop("__part"))

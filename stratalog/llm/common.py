"""What the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and no other letter. ``lower`` does the same on pure ASCII, and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def rows_by(batch: pa.RecordBatch, name: str, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most about ``most`` bytes of the string column ``name``; a longer text stands alone."""
    column = batch.column(batch.schema.get_field_index(name))
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += int(n)
    if first < len(sizes):
        yield first, len(sizes)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def run(batches):
        for b in batches:
            yield from f(b)

    return df.mapInArrow(run, schema)


def broadcast_if_small(df: DataFrame, most_rows: int = 200_000, most_bytes: int = 64 << 20) -> DataFrame:
    """``df``, which is stored, with a broadcast hint if its rows and their text are few enough; beyond that Spark shuffles both sides."""
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.concat_ws(",", *[F.to_json(F.struct(c)) for c in df.columns])).cast("long")), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if size.n <= most_rows and size.b <= most_bytes else df


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], most: int = 1_000_000) -> DataFrame:
    """Left join of ``rows`` with ``counted``, which has one row for each value of ``keys`` and the number ``rows_of_key`` of its rows.

    Values with more than ``most`` rows are dealt over several parts on both sides, so no task gets a hot key whole. Of
    them there are at most rows / ``most``, which bounds what is broadcast. Keys are not null.
    """
    hot = counted.filter(F.col("rows_of_key") > most).select(*keys, F.ceil(F.col("rows_of_key") / most).cast("long").alias("__parts"))
    part = F.pmod(F.xxhash64(*rows.columns), F.coalesce("__parts", F.lit(1)))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__part", part).drop("__parts")
    parts = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("rows_of_key") / most).cast("long") - 1)
    spread = counted.withColumn("__part", F.explode(F.when(F.col("rows_of_key") > most, parts).otherwise(F.array(F.lit(0).cast("long"))))).drop("rows_of_key")
    return dealt.join(spread, [*keys, "__part"], "left").drop("__part")


def spread_rows(df: DataFrame, rows_per_task: int = 50_000) -> DataFrame:
    """``df``, which is stored, dealt evenly over tasks: for steps that make many rows of each."""
    n = df.count()
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // rows_per_task)))


def read_by_rows(df: DataFrame, n: int | None = None, rows_per_task: int = 50_000) -> DataFrame:
    """``df``, which is stored and has ``n`` rows, read by as many tasks as these ask for.

    A shuffle leaves files for each task that feeds it, so a small table in many parts costs many times its bytes of disk. No task gets
    more than its share by that: what is stored is read in larger pieces, and what follows a shuffle stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = df.coalesce(cores).count() if n is None else n
    return df.coalesce(max(cores, -(-n // rows_per_task)))


def running(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of its column over all rows before this one in the order; nulls first.

    Rows are dealt by ranges of the order; the parts' own sums, one row a part, are added, so no task sees all rows.
    """
    parted = cut_lineage(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("__part", F.spark_partition_id()))
    one = parted.groupBy("__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    one = one.select("__part", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    within = Window.partitionBy("__part").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    out = parted.join(F.broadcast(one), "__part")
    return out.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"__{n}") for n, c in sums.items()}).drop("__part", *[f"__{n}" for n in sums])

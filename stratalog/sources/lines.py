"""Plain logs of any size as numbered lines, read in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    r"""(artifact_ord, artifact_path, line_number, raw_line) of the text files at ``path``; lines end in \n, \r\n or \r.

    Every split numbers its own lines; the counts of the splits before it in the file, one row a split, are added. The
    text is taken as UTF-8, and a byte order mark stays in the first line.
    """
    meta = F.col("_metadata")
    rows = spark.read.text(path, recursiveFileLookup=True).select(
        meta["file_path"].alias("artifact_path"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("raw_line")
    )
    splits = rows.groupBy("artifact_path", "split").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy("artifact_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("artifact_path", "split", "first", "before")
    numbered = rows.join(splits, ["artifact_path", "split"])
    return numbered.select(F.col("artifact_path").alias("artifact_ord"), "artifact_path", (F.col("row") - F.col("first") + F.col("before") + 1).alias("line_number"), "raw_line")

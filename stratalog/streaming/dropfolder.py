"""A drop folder as a stream: new files are scanned in micro-batches, each file once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..api import scan_frames
from ..functions.rules import Pack, built_in, line_hits, may_hit
from ..lineage import cut_lineage
from ..operators import findings as G
from ..sources.artifacts import Limits, expanded
from ..sources.bundles import expanded_and_opened, keyed
from ..sources.decoders import Tools


def stream_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, content) of new files of a folder that Spark reads."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder).select("path", "content")


def watch(
    spark: SparkSession, folder: str, output: str, checkpoint: str, pack: Pack | None = None, trigger: dict | None = None, limits: Limits | None = None, tools: Tools | None = None, remember: bool = False
) -> StreamingQuery:
    """Scans new files, archives expanded, and writes coverage, hits and partial findings as Parquet to ``output``, one folder per batch.

    A repeated batch replaces what it has written. Hits are numbered within their batch, whose number is the first part of
    their id; ``findings`` merges the partial findings of all batches. Every file has limits of its own. With ``remember`` a
    batch is one scan: its files share a budget, and archives that an earlier batch has opened are not opened again; the
    digests of opened archives are kept in ``output``, one folder per batch, and joined, so they may be any number.
    """
    pack = pack or built_in()

    def expand(df: DataFrame, number: int) -> DataFrame:
        if not remember:
            return expanded(df, folder, limits, tools)
        kept = f"{output}/archives"
        spark.createDataFrame([], "node string").write.mode("overwrite").parquet(f"{kept}/batch=-1")
        seen = spark.read.parquet(kept).filter(F.col("batch") < number).select("node")
        found, opened = expanded_and_opened(keyed(df), folder, limits, tools, f"{number:06d}-", seen)
        opened.write.mode("overwrite").parquet(f"{kept}/batch={number}")
        return found.withColumn("artifact_ord", F.concat(F.lit(f"{number:09d}-"), "artifact_ord"))

    def batch(df: DataFrame, number: int) -> None:
        frames = scan_frames(cut_lineage(expand(df, number)), pack)
        named = frames.hits.withColumn("hit_id", F.concat(F.lit(f"B{number:06d}-"), F.col("hit_id")))
        parts = {"coverage": frames.coverage, "hits": named, "rule_partials": G.rule_partials(frames.hits), "file_partials": G.file_partials(frames.hits)}
        for name, part in parts.items():
            part.write.mode("overwrite").parquet(f"{output}/{name}/batch={number}")

    return stream_files(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


@dataclass(frozen=True)
class Findings:
    by_rule: DataFrame
    by_file: DataFrame
    warnings: DataFrame


def findings(spark: SparkSession, output: str, pack: Pack | None = None) -> Findings:
    """Findings by rule and by file and the warnings over all batches that ``watch`` has written to ``output``: what one scan of all files gives.

    Only the batches' partial findings are read, not their hits.
    """
    read = lambda name: spark.read.parquet(f"{output}/{name}").drop("batch")
    cover = read("coverage")
    return Findings(G.merged_by_rule(read("rule_partials"), pack or built_in()), G.merged_by_file(cover, read("file_partials")), G.warnings(cover))


def windowed_hits(events: DataFrame, pack: Pack, time_col: str = "ts", line_col: str = "raw_line", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Hits per rule and time window of a stream (or table) of timed lines; lines more than ``late`` behind are left out of a stream."""
    line = F.col(line_col)
    hits = events.withWatermark(time_col, late).filter(may_hit(line, pack)).select(F.col(time_col), F.explode_outer(line_hits(line, pack)).alias("h")).filter("h is not null")
    counts = hits.groupBy(F.window(time_col, window).alias("w"), F.col("h.rule_id").alias("rule_id"), F.col("h.severity").alias("severity")).agg(F.count("*").alias("hit_count"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "rule_id", "severity", "hit_count")

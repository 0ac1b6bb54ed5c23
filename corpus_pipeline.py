"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Every stage but the last returns the columns of ``documents``. Toxic documents go; of near copies one stays; documents
with test passages go; secrets are masked in the text; the last stage mixes the sources and gives texts with copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import decontaminate, mixing, secrets, shingles, simhash, toxicity
from stratalog.llm.common import table
from stratalog.lineage import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _key() -> Column:
    """A document is known by its id, source and a hash of its text."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("source", "text").cast("string"))


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under a half, by a machine fitted on the labelled ones among them.

    Null and empty texts score the bias alone and stay; rows that repeat each other stay or go together; all stay without labels.
    """
    return toxicity.drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more), the document with the smallest id.

    Fingerprints are linked as operator 4 does and checked by that similarity; what they have not joined is found by the shingles.
    Null and empty texts have no shingles and are copies of each other alone; texts of fewer than five words are one shingle; of rows
    that repeat each other one stays; rows without an id stay only where no row of their group has one. No documents give none.
    """
    return simhash.keep_one(docs.select(*COLUMNS), groups=shingles.near_groups)


def test_passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a hit by a window of a benchmark item; a document is known by its id, source and a hash of its text.

    Null and empty texts stay, and so do all without benchmark items.
    """
    docs = docs.select(*COLUMNS, _key().alias("__key"))
    hit = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), id_col="__key").filter("n_hit > 0")
    return docs.join(hit.select(F.col("doc_id").alias("__key")).distinct(), "__key", "left_anti").select(*COLUMNS)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [SECRET] in place of every secret; n_chars follows the text.

    Null texts stay null, with n_chars null; empty texts and texts without secrets stay as they are; rows that repeat each other stay
    as many; an empty table stays empty.
    """
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their text, how often (copies) and how many words that makes (taken).

    Rows that repeat an id and a text come out as one, with their copies added. Null texts have no words; those that the
    mix takes have copies and no taken words. Without documents there are none.
    """
    docs = docs.select(*COLUMNS).withColumn("__key", _key())
    found = mixing.mix(docs, keep=("__key",)).filter("copies > 0").groupBy("__key").agg(*[F.max(c).alias(c) for c in ("size", "source_size", "target")], *[F.sum(c).alias(c) for c in ("copies", "taken")])
    return docs.dropDuplicates(["__key"]).join(found, "__key").drop("__key")


STAGES = [
    ("toxicity", toxic_out),
    ("near_dedup", near_copies_out),
    ("decontamination", test_passages_out),
    ("secrets", secrets_masked),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, all of them applied to the documents in turn. No documents give no rows.

    Each stage's rows are stored in the shared folder; Spark's cleaner removes those that later stages no longer need.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs


#: Boosting, fingerprints and sampling can't be said in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES = {}

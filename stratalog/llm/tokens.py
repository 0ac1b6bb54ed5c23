"""Token counts by scanning flat token files for end-of-document ids.

A token file is a bare run of little-endian token ids in which an id that no text gives ends each document; there is
no index. A file is taken in blocks, which are read apart from each other, so its size doesn't matter. Each block is searched for that id by one vectorised comparison; a document that
crosses blocks is stitched by a prefix scan over the blocks' sums (tokens so far, last end so far, documents so far),
taken in two levels so that one huge file doesn't make one huge task. What the search finds, two numbers a document, is
stored once; tokens are neither stored nor searched again.

Encoding needs the packages ``tiktoken`` and, for its vocabulary file and split pattern, ``public_tokenizers``.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .common import map_batches, spread_rows, table

BLOCK, GROUP, END_OF_DOCUMENT, VOCABULARY = 1 << 18, 1024, 50256, "byte_bpe_multi_50k.tiktoken"
_BLOCKS = "file string, block long, width int, data binary, ids array<long>"
_encoders: dict[str, object] = {}


def vocabulary(path: str | None = None) -> tuple[str, bytes]:
    """(split pattern, ranks file) of a public byte-pair vocabulary; by default the one for many languages."""
    try:
        import public_tokenizers
    except ImportError as e:
        raise ImportError("token counts need the package public_tokenizers, which holds vocabulary files") from e
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return public_tokenizers.PATTERN, f.read()


def encoder(pattern: str, ranks: bytes):
    """The tokenizer, made once in each worker."""
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _encoders:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _encoders[key]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block: int = BLOCK, end: int = END_OF_DOCUMENT) -> DataFrame:
    """Blocks (file, block, width, data, ids) of flat token streams, one stream for each partition of ``docs``.

    ``data`` holds little-endian ids of ``width`` bytes: 2, or 4 for vocabularies beyond 65,536. ``ids`` are the ids of the
    documents whose end lies in the block, in order; the scan hands them on. Null and empty texts are an end only. ``end``
    is an id that no text gives; one of the vocabulary's own is refused.
    """
    pattern, ranks = vocabulary(path)
    most = max((int(line.split()[1]) for line in ranks.splitlines() if line), default=-1)
    if end <= most:
        raise ValueError(f"the end id {end} is a token of the vocabulary, whose ids go to {most}")
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file, about 1 MB
    width = 2 if end < 1 << 16 else 4

    def run(batches):
        from pyspark import TaskContext

        bpe, name, number = encoder(pattern, sent.value), f"part-{TaskContext.get().partitionId():06d}", 0
        parts: list[np.ndarray] = []
        held, ends = 0, []

        def full(last: bool):
            nonlocal parts, held, ends, number
            if not held:
                return
            flat, at = np.concatenate(parts), 0
            while len(flat) - at >= block or last and at < len(flat):
                piece = flat[at : at + block]
                own = [i for i, e in ends if e < at + len(piece)]
                ends = ends[len(own) :]
                data = piece.astype(f"<u{width}").tobytes()
                yield pa.RecordBatch.from_pydict({"file": [name], "block": pa.array([number], pa.int64()), "width": pa.array([width], pa.int32()), "data": [data], "ids": pa.array([own], pa.list_(pa.int64()))})
                at, number = at + len(piece), number + 1
            parts, held, ends = [flat[at:]], len(flat) - at, [(i, e - at) for i, e in ends]

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py()
                own = np.array(bpe.encode_ordinary(text), np.uint32) if text else np.zeros(0, np.uint32)
                parts += [own, np.array([end], np.uint32)]
                held += len(own) + 1
                ends.append((i, held - 1))
                if held >= block:
                    yield from full(False)
        yield from full(True)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _BLOCKS)


def save_token_files(blocks: DataFrame, folder: str) -> int:
    """Writes blocks as ``encode`` gives them to flat token files in ``folder``, which all machines share; how many tokens that makes.

    Each file is written under another name first and then renamed, so a repeated task replaces its own file.
    """

    def run(batches):
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        out, names, total = None, None, 0
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    names = f"{root}/.{r['file']}.{TaskContext.get().taskAttemptId()}", f"{root}/{r['file']}.tokens"
                    out = store.open_output_stream(names[0])
                out.write(r["data"])
                total += len(r["data"]) // r["width"]
        if out is not None:
            out.close()
            store.move(*names)
        yield pa.RecordBatch.from_pydict({"n": pa.array([total], pa.int64())})

    return blocks.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_token_files(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Blocks of the token files at ``path`` (a file, folder or pattern that Spark lists), of ``width`` bytes a token.

    Spark lists names and sizes; every block is its own row and is read by its place in the file, so files may have any
    size. A last odd byte is not a token and is left out.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    last = F.floor((F.floor(F.col("length") / width) - 1) / block)
    rows = files.filter(F.col("length") >= width).select(F.col("path").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))

    def run(batch):
        for name, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            store, at = fs.FileSystem.from_uri(name if "://" in name or not name.startswith("file:") else "file://" + name.removeprefix("file:"))
            with store.open_input_file(at) as f:
                f.seek(k * block * width)
                data = f.read(block * width)
            yield pa.RecordBatch.from_pydict({"file": [name], "block": pa.array([k], pa.int64()), "width": pa.array([width], pa.int32()), "data": [data[: len(data) // width * width]], "ids": pa.array([None], pa.list_(pa.int64()))})

    return map_batches(spread_rows(cut_lineage(rows), 64), run, _BLOCKS)


def scan(blocks: DataFrame, width: int = 2, end: int = END_OF_DOCUMENT) -> DataFrame:
    """(file, number, id, start, n_tokens, ended): every document of the files, numbered from 0 in each.

    ``start`` counts tokens from the file's beginning; an end itself counts for no document. Tokens after the last end
    are a document that has not ended. ``id`` is what the blocks carry, or null. Empty files give no rows. ``width`` is
    that of blocks without such a column.
    """

    def search(batch):
        found = []
        for data, own in zip(batch.column(2), batch.column(4).to_pylist()):
            tokens = np.frombuffer(data.as_buffer(), f"<u{own}")
            found.append((len(tokens), np.flatnonzero(tokens == end)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([e for _, e in found], pa.list_(pa.int64())), batch.column(3)], names=["file", "block", "n", "ends", "ids"])

    own = F.col("width") if "width" in blocks.columns else F.lit(width)
    x = cut_lineage(map_batches(blocks.select("file", "block", "data", "ids", own.alias("width")), search, "file string, block long, n long, ends array<long>, ids array<long>"))
    x = x.withColumn("part", F.floor(F.col("block") / GROUP)).withColumn("k", F.size("ends").cast("long")).withColumn("last", F.element_at("ends", F.when(F.size("ends") > 0, -1)))
    within = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("n0", F.coalesce(F.sum("n").over(within), F.lit(0))).withColumn("k0", F.coalesce(F.sum("k").over(within), F.lit(0)))
    x = x.withColumn("e0", F.max(F.col("n0") + F.col("last")).over(within))
    sums = x.groupBy("file", "part").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.max(F.col("n0") + F.col("last")).alias("e"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("n1", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("k1", F.coalesce(F.sum("k").over(before), F.lit(0)))
    sums = sums.withColumn("e1", F.coalesce(F.max(F.col("n1") + F.col("e")).over(before), F.lit(-1)))
    y = x.join(sums.select("file", "part", "n1", "k1", "e1"), ["file", "part"])
    offset, from_ = F.col("n0") + F.col("n1"), F.coalesce(F.col("n1") + F.col("e0"), F.col("e1"))
    y = y.select("file", "ids", (F.col("k0") + F.col("k1")).alias("first"), from_.alias("from_"), F.transform("ends", lambda e: e + offset).alias("ends"))
    docs = y.select("file", "first", "from_", "ids", "ends", F.posexplode("ends").alias("i", "at"))
    start = F.when(F.col("i") == 0, F.col("from_")).otherwise(F.get("ends", F.col("i") - 1)) + 1
    ended = docs.select("file", (F.col("first") + F.col("i")).alias("number"), F.get("ids", F.col("i")).alias("id"), start.alias("start"), (F.col("at") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    whole = sums.groupBy("file").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.coalesce(F.max(F.col("n1") + F.col("e")), F.lit(-1)).alias("e"))
    open_ = whole.filter("n > e + 1").select("file", F.col("k").alias("number"), F.lit(None).cast("long").alias("id"), (F.col("e") + 1).alias("start"), (F.col("n") - F.col("e") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(open_)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document: doc_id, n_tokens.

    Null and empty texts have 0 tokens. Null and repeated ids come out as they came in; an empty table gives an empty
    result; further columns are not read.
    """
    return scan(encode(table(spark, sf_dir, "documents"))).select(F.col("id").alias("doc_id"), "n_tokens")

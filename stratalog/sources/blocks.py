"""Files of any size and encoding, read as byte ranges: printable runs and decoded, numbered lines over the edges of blocks.

A block has its own bytes and three on either side, which tell what at its edges belongs to the blocks beside it: which
character a continuation byte or a surrogate is part of, whether a line feed ends the line that a carriage return has
ended, whether a printable run goes on. So every block is looked at alone; what has to be put together afterwards is
one small row a block, and the pieces of runs and lines that cross an edge.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import CHUNK, LEAST_RUN, cut_run
from ..lineage import cut_lineage

BLOCK, EDGE = 8 << 20, 3
BYTES = "before binary, data binary, after binary"
_ODD = np.isin(np.arange(256), (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_END = re.compile("\r\n|\r|\n")
#: Bytes of a character by its first byte; others count as one.
_LENGTH = np.ones(256, np.int64)
_LENGTH[0xC0:0xE0], _LENGTH[0xE0:0xF0], _LENGTH[0xF0:0xF8] = 2, 3, 4


#: Bytes of rows that go into one batch.
_BATCH = 8 << 20


def _starts(length: Column, block: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.greatest(length - 1, F.lit(0)).cast("long"), F.lit(block).cast("long"))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some megabytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) if isinstance(x, (str, bytes)) else 8 for x in r)
        if size > _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def cut(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks (artifact_path, start, BYTES) of rows (artifact_path, content); an empty content is one empty block, a null one none.

    Cut in one pass over each content: an expression would compute the content again for every block of it.
    """
    schema = pa.schema([("artifact_path", pa.string()), ("start", pa.int64()), *[(c, pa.binary()) for c in ("before", "data", "after")]])

    def pieces(batches):
        for b in batches:
            for path, value in zip(b.column(0), b.column(1)):
                path, c = path.as_py(), value.as_py()
                for at in range(0, max(len(c), 1), block) if c is not None else ():
                    yield path, at, c[max(at - EDGE, 0) : at], c[at : at + block], c[at + block : at + block + EDGE]

    return files.select("artifact_path", "content").mapInArrow(lambda batches: _batches(pieces(batches), schema), f"artifact_path string, start long, {BYTES}")


def _dealt(rows: DataFrame) -> DataFrame:
    """Blocks dealt over all tasks: the work on each is much for its bytes, so the number of parts must not be adapted to them."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "artifact_path", "start")


def index(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Blocks (artifact_path, start, size) of the files at a path that Spark lists; nothing is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("artifact_path"), "length")
    rows = found.select("artifact_path", F.explode(_starts(F.col("length"), block)).alias("start"), F.lit(block).cast("long").alias("size"))
    return _dealt(rows)  # rows are small, what is read for each is not


def read(rows: DataFrame) -> DataFrame:
    """Rows of ``index``, perhaps with more columns, with their BYTES."""
    columns = rows.columns
    at = [columns.index(c) for c in ("artifact_path", "start", "size")]

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for i in range(b.num_rows):
                own = b.slice(i, 1)
                path, start, size = (own.column(k)[0].as_py() for k in at)
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    left = max(start - EDGE, 0)
                    f.seek(left)
                    data = f.read(start - left + size + EDGE)
                cut_at = start - left
                parts = (data[:cut_at], data[cut_at : cut_at + size], data[cut_at + size :])
                yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array([p], pa.binary()) for p in parts]], names=[*own.schema.names, "before", "data", "after"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, {BYTES}")


def _each(df: DataFrame, f: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """``f`` of each row as a dict gives tuples of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def rows(batches):
        for b in batches:
            for values in zip(*b.columns):
                yield from f(dict(zip(b.schema.names, (v.as_py() for v in values))))

    def run(batches):
        yield from _batches(rows(batches), arrow)

    return df.mapInArrow(run, schema)


# --- printable runs


def chains(mask: np.ndarray) -> np.ndarray:
    """(begin, end) of every stretch that is true."""
    edges = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.column_stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)])


def _runs(r: dict) -> Iterator[tuple]:
    """(path, kind_ord, byte_offset, characters, goes on to the left, to the right, text) of a block's printable runs."""
    own = len(r["data"])
    at, data = len(r["before"]), r["before"] + r["data"] + r["after"]
    raw = np.frombuffer(data, np.uint8)
    seen = (raw >= 0x20) & (raw <= 0x7E)
    pair = np.append(seen[:-1] & (raw[1:] == 0), False) if len(raw) else seen
    for width, parity, mask in ((1, 0, seen), (2, 0, pair), (2, 1, pair)):
        first = at if width == 1 else at + (r["start"] + parity) % 2
        places = np.arange(first, at + own, width)
        found = chains(mask[places])
        # text of the other width makes a stretch of every character: none of those is looked at one by one
        kept = (found[:, 1] - found[:, 0] >= LEAST_RUN) | (found[:, 0] == 0) | (found[:, 1] == len(places))
        for a, b in found[kept].tolist():
            begin, end = int(places[a]), int(places[b - 1]) + width
            left = a == 0 and begin - width >= 0 and bool(mask[begin - width])
            right = b == len(places) and end < len(mask) and bool(mask[end])
            if left or right or b - a >= LEAST_RUN:
                yield r["artifact_path"], 0 if width == 1 else 1 + parity, r["start"] + begin - at, b - a, left, right, data[begin:end:width].decode("latin-1")


def block_fragments(blocks: DataFrame, exact_chunks: bool = True) -> DataFrame:
    """(artifact_ord, artifact_path, kind_ord, byte_offset, raw_line) of the printable runs of files given as blocks with BYTES: what
    ``scan.fragments`` gives for whole contents, for blocks of any size from four bytes up.

    Runs inside a block are told where they are. Pieces that cross an edge are put together by where their run begins,
    which is found over rows without text; with ``exact_chunks`` only pieces in the chunk in which a run begins are.
    """
    found = cut_lineage(_each(blocks, _runs, "artifact_path string, kind_ord int, byte_offset long, n long, goes_left boolean, goes_right boolean, run string"))  # read three times
    inside = found.filter("not goes_left and not goes_right").select("artifact_path", "kind_ord", "byte_offset", "run")
    pieces = found.filter("goes_left or goes_right")
    order = Window.partitionBy("artifact_path", "kind_ord").orderBy("byte_offset").rowsBetween(Window.unboundedPreceding, 0)
    head = pieces.select("artifact_path", "kind_ord", "byte_offset", "goes_left").withColumn("head", F.last(F.when(~F.col("goes_left"), F.col("byte_offset")), ignorenulls=True).over(order)).drop("goes_left")
    if exact_chunks:
        head = head.filter(F.col("byte_offset") < (F.floor(F.col("head") / CHUNK) + 1) * CHUNK)
    said = F.sort_array(F.collect_list(F.struct("byte_offset", "run")))
    whole = pieces.select("artifact_path", "kind_ord", "byte_offset", "run").join(head, ["artifact_path", "kind_ord", "byte_offset"]).groupBy("artifact_path", "kind_ord", F.col("head").alias("byte_offset")).agg(F.array_join(F.transform(said, lambda x: x["run"]), "").alias("run"))
    x = inside.unionByName(whole)
    width = F.when(F.col("kind_ord") == 0, 1).otherwise(2)
    room = [cut_run(F.col("byte_offset"), F.length("run") * w, w, exact_chunks) for w in (1, 2)]
    x = x.withColumn("n", F.when(width == 1, room[0]).otherwise(room[1])).filter(F.col("n") >= LEAST_RUN)
    return x.select(F.col("artifact_path").alias("artifact_ord"), "artifact_path", "kind_ord", "byte_offset", F.substring("run", F.lit(1), F.col("n").cast("int")).alias("raw_line"))


# --- decoded lines


def _own8(r: dict) -> tuple[bytes | None, bytes]:
    """The bytes of the characters of UTF-8 that begin in a block; None if they, or what it continues, are not valid."""
    data, at = r["before"] + r["data"] + r["after"], len(r["before"])
    end, first = at + len(r["data"]), at
    while first < end and data[first] & 0xC0 == 0x80:
        first += 1
    lead = at - 1
    while lead >= 0 and data[lead] & 0xC0 == 0x80:
        lead -= 1
    due = max(0, lead + int(_LENGTH[data[lead]]) - at) if lead >= 0 else 0
    last = end - 1
    while last >= first and data[last] & 0xC0 == 0x80:
        last -= 1
    own = data[first : max(end, last + int(_LENGTH[data[last]]))] if last >= first else b""
    try:
        own.decode("utf-8")
    except UnicodeError:
        return None, own
    return (own if first - at == min(due, len(r["data"])) else None), own


def _own16(r: dict, kind: str) -> bytes | None:
    """The bytes of the characters of UTF-16 that begin in a block, behind a mark; None if not valid. Blocks begin at even places."""
    data = r["data"][2:] if r["start"] == 0 else r["data"]
    before = r["before"] if r["start"] > 2 else b""
    if len(data) % 2:
        return None
    high = lambda b: len(b) == 2 and 0xD8 <= b[1 if kind == "utf-16-le" else 0] <= 0xDB
    low = lambda b: len(b) == 2 and 0xDC <= b[1 if kind == "utf-16-le" else 0] <= 0xDF
    if high(before[-2:]) != low(data[:2]) and data:
        return None
    own = data[2:] if high(before[-2:]) else data
    if own and high(own[-2:]):
        own += r["after"][:2]
    try:
        own.decode(kind)
    except UnicodeError:
        return None
    return own


def _ends(text: str, after_return: bool) -> int:
    return len(_END.findall(text)) - (after_return and text.startswith("\n"))


def _looked_at(r: dict) -> Iterator[tuple]:
    """One row a block: what each encoding would make of it."""
    raw = np.frombuffer(r["data"], np.uint8)
    mark = r["data"][:3] if r["start"] == 0 else b""
    kind = "utf-8-sig" if mark == b"\xef\xbb\xbf" else "utf-16-le" if mark[:2] == b"\xff\xfe" else "utf-16-be" if mark[:2] == b"\xfe\xff" else None
    wide = {k: _own16(r, k) for k in ("utf-16-le", "utf-16-be")}
    ends = [_ends(r["data"].decode("latin-1"), r["before"][-1:] == b"\r")]
    for k, unit in (("utf-16-le", b"\r\0"), ("utf-16-be", b"\0\r")):
        ends.append(_ends(wide[k].decode(k), r["start"] > 2 and r["before"][-2:] == unit) if wide[k] is not None else 0)
    yield r["artifact_path"], r["start"], kind, _own8(r)[0] is not None, wide["utf-16-le"] is not None, wide["utf-16-be"] is not None, bool(_ODD[raw].any()), *ends


def _pieces(r: dict) -> Iterator[tuple]:
    """(path, start, line, at an edge, text): the parts of a block's text between line ends."""
    kind = r["codec"]
    if kind in ("utf-8", "utf-8-sig"):
        own = _own8(r)[0]
        text = own.decode("utf-8")
        text = text[1:] if kind == "utf-8-sig" and r["start"] == 0 else text
        returned = r["before"][-1:] == b"\r"
    elif kind.startswith("utf-16"):
        text = _own16(r, kind).decode(kind)
        returned = r["start"] > 2 and r["before"][-2:] == ("\r").encode(kind)
    else:
        text, returned = r["data"].decode(kind), r["before"][-1:] == b"\r"
    if returned and text.startswith("\n"):
        text = text[1:]
    parts = _END.split(text)
    for k, part in enumerate(parts):
        yield r["artifact_path"], r["start"], r["ended"] + k + 1, k in (0, len(parts) - 1), part


def encodings(looked: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """(artifact_path, encoding, codec, ok, n_ends): the decision of ``text.encoding_of`` for each file, folded over its blocks, or the encoding it is ``told``."""
    every = lambda c: F.bool_and(c)
    x = looked.groupBy("artifact_path").agg(
        F.max("mark").alias("mark"), every("utf8").alias("utf8"), every("le").alias("le"), every("be").alias("be"), F.bool_or("odd").alias("odd"),
        F.sum("ends").alias("e8"), F.sum("ends_le").alias("ele"), F.sum("ends_be").alias("ebe"),
    )
    wide = F.coalesce(F.col("mark").startswith("utf-16"), F.lit(False))
    codec = F.when(F.col("mark").isNotNull(), F.col("mark")).when(F.col("utf8"), "utf-8").when(F.col("odd"), "latin-1").otherwise("cp1252")
    ok = F.when(F.col("mark") == "utf-8-sig", F.col("utf8")).when(F.col("mark") == "utf-16-le", F.col("le")).when(F.col("mark") == "utf-16-be", F.col("be")).otherwise(F.lit(True))
    ends = F.when(F.col("mark") == "utf-16-le", F.col("ele")).when(F.col("mark") == "utf-16-be", F.col("ebe")).otherwise(F.col("e8"))
    if told is not None:
        x, known = x.join(told.select("artifact_path", F.col("encoding").alias("told")), "artifact_path", "left"), F.col("told").isNotNull()
        fits = F.when(F.col("told") == "utf-8", F.col("utf8")).when(F.col("told") == "cp1252", ~F.col("odd")).otherwise(F.lit(True))
        wide, codec, ok, ends = wide & ~known, F.coalesce("told", codec), F.when(known, fits).otherwise(ok), F.when(known, F.col("e8")).otherwise(ends)
    return x.select("artifact_path", F.when(wide, "utf-16").otherwise(codec).alias("encoding"), codec.alias("codec"), ok.alias("ok"), ends.alias("n_ends"))


def decoded_lines(blocks: DataFrame, reader: Callable[[DataFrame], DataFrame] | None = None, told: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, lines) of files given as blocks of an even size: files (artifact_path, encoding, ok) and, of those that decode strictly, lines
    (artifact_ord, artifact_path, line_number, raw_line, encoding), as ``scan.line_arrays`` gives them for whole contents.

    ``reader`` adds the bytes to rows that have none (``read``); they are then read once to decide and once for the lines, and never
    shuffled. Lines inside a block stay where they are; only the pieces of those that cross an edge are gathered. ``told`` (artifact_path,
    encoding) are files whose encoding, utf-8, cp1252 or latin-1, is known: bytes alone can't tell where two of them fit.
    """
    reader = reader or (lambda df: df)
    looked = cut_lineage(_each(reader(blocks), _looked_at, "artifact_path string, start long, mark string, utf8 boolean, le boolean, be boolean, odd boolean, ends long, ends_le long, ends_be long"))
    files = cut_lineage(encodings(looked, told))
    wide = lambda k: F.col("codec") == k
    own = F.when(wide("utf-16-le"), F.col("ends_le")).when(wide("utf-16-be"), F.col("ends_be")).otherwise(F.col("ends"))
    before = Window.partitionBy("artifact_path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    told = looked.join(files.filter("ok"), "artifact_path").withColumn("ended", F.coalesce(F.sum(own).over(before), F.lit(0))).select("artifact_path", "start", "codec", "ended")
    parts = _each(reader(_dealt(blocks).join(told, ["artifact_path", "start"])), _pieces, "artifact_path string, start long, line_number long, edge boolean, raw_line string")
    said = F.sort_array(F.collect_list(F.struct("start", "raw_line")))
    crossed = parts.filter("edge").groupBy("artifact_path", "line_number").agg(F.array_join(F.transform(said, lambda x: x["raw_line"]), "").alias("raw_line"))
    lines = parts.filter("not edge").select("artifact_path", "line_number", "raw_line").unionByName(crossed)
    lines = lines.join(files.select("artifact_path", "encoding", "n_ends"), "artifact_path").filter((F.col("raw_line") != "") | (F.col("line_number") <= F.col("n_ends")))
    return files.select("artifact_path", "encoding", "ok"), lines.select(F.col("artifact_path").alias("artifact_ord"), "artifact_path", "line_number", "raw_line", "encoding")

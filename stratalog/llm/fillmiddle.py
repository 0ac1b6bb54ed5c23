"""Fill-in-the-middle transformation by a secondary sort.

A text is cut into lines and two places among them, told by a hash of its id, part it into prefix, middle and suffix. The
output gives them in another order behind marks. Texts are not put together where they are cut: every text becomes pieces of
whole lines (long lines in parts), each keyed by (document, place in the output). ``repartitionAndSortWithinPartitions`` brings
the pieces of a document together in the order of the output, and they stream one after another into digests or to a
writer, so no task needs more of a document than a piece. To restore the text, the marks are looked for in the stream of the
output itself; each stretch gets its place in the text as key and the stream is sorted again by that. The partitioning
stays as it is, so the second sort moves nothing between machines.

A document is known by a digest of its id and text and by the partition it came from. Rows of one partition that
repeat each other share that key and their places; they are counted instead of kept apart. So keys do not depend on
the order in which a partition is read, and rows computed again after a loss get the same keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.rdd import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Place of the stretch behind each mark in the text.
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
SEED, RATE, SPM, PIECE, PART_BYTES = 7, 100, 50, 1 << 16, 32 << 20
ROW = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
#: Sorts behind every piece.
_LAST = (9, 0)


def hashes(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """h1 to h4 of an id; of a null id those of the seed alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def line_ends(data: bytes) -> np.ndarray:
    """0, then the place behind each line: text up to and with a line feed, or what is left at the end."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.concatenate([[0], ends, [len(data)] if data and not data.endswith(b"\n") else []]).astype(np.int64)


def parted(data: bytes, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[str, int, list[tuple[bytes, int, int]]]:
    """(form, number of lines, stretches (mark, begin, end) in the order of the output); one stretch without a mark if plain."""
    ends = line_ends(data)
    n = len(ends) - 1
    h1, h2, h3, h4 = hashes(doc_id, seed)
    if not data or any(m in data for m in PLACE) or h3 % 100 >= rate:
        return "plain", n, [(b"", 0, len(data))]
    form = "spm" if h4 % 100 < spm else "psm"
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = {PREFIX: (0, int(ends[a])), MIDDLE: (int(ends[a]), int(ends[b])), SUFFIX: (int(ends[b]), len(data))}
    return form, n, [(m, *at[m]) for m in MARKS[form]]


def _cuts(data: bytes, begin: int, end: int, piece: int) -> Iterator[bytes]:
    """Pieces of whole lines of up to ``piece`` bytes; a longer line is cut."""
    while begin < end:
        stop = min(begin + piece, end)
        if stop < end and (line := data.rfind(b"\n", begin, stop)) >= 0:
            stop = line + 1
        yield data[begin:stop]
        begin = stop


def _key(doc_id: int | None, data: bytes, part: int) -> bytes:
    return hashlib.blake2b(f"{part}:{doc_id}:".encode() + data, digest_size=16).digest()


def _owner(key: tuple) -> int:
    """Partitions go by the document alone, whatever the place."""
    return int.from_bytes(key[0][:8], "big")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, piece: int = PIECE, **rules) -> RDD:
    """((document, (stretch, number)), data), the pieces of each document together and in the order of the output.

    The first record of a document, at (-1, 0), has its id, form and number of lines instead of data; a row that repeats
    another of its partition adds such a record and no pieces.
    """

    def cut(part, rows):
        seen: set[bytes] = set()
        for id_, text in rows:
            data = (text or "").encode("utf-8", "replace")
            key = _key(id_, data, part)
            form, n, stretches = parted(data, id_, **rules)
            yield (key, (-1, 0)), repr((id_, form, n)).encode()
            if key in seen:
                continue
            seen.add(key)
            for k, (mark, begin, end) in enumerate(stretches):
                yield (key, (k, 0)), mark
                for i, x in enumerate(_cuts(data, begin, end, piece), 1):
                    yield (key, (k, i)), x

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = texts.rdd.mapPartitionsWithIndex(cut)
    return keyed.repartitionAndSortWithinPartitions(parts or parts_for(texts), _owner)


def parts_for(texts: DataFrame) -> int:
    """As many partitions as keep the text of each near PART_BYTES: nothing adapts the number of an RDD's partitions later on."""
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first().n
    return max(texts.sparkSession.sparkContext.defaultParallelism, -(-total // PART_BYTES))


def _head(data: bytes) -> tuple:
    from ast import literal_eval

    return literal_eval(data.decode())


def _documents(records: Iterator) -> Iterator[tuple[bytes, tuple, int, Iterator[tuple[tuple[int, int], bytes]]]]:
    """(document, head, number of rows like it, its pieces) of a sorted stream; what is left of the pieces is skipped."""
    for doc, own in groupby(records, lambda r: r[0][0]):
        head, copies, first = None, 0, None
        for (_, place), data in own:
            if place[0] >= 0:
                first = (place, data)
                break
            head, copies = data, copies + 1
        rest = ((place, data) for (_, place), data in own)
        yield doc, _head(head), copies, _chained(first, rest)


def _chained(first, rest):
    if first is not None:
        yield first
    yield from rest


def _chars(data: bytes) -> int:
    """Code points that begin in these bytes."""
    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


def stretches_of(output: Iterator[bytes], form: str) -> Iterator[tuple[int, bytes]]:
    """(place in the text, data) of an output that comes in pieces of any size, by the marks found in it; marks are left out."""
    if form == "plain":
        yield from ((0, x) for x in output)
        return
    marks, place, held = list(MARKS[form]), None, b""
    for x in output:
        held += x
        while marks and (at := held.find(marks[0])) >= 0:
            if place is not None and at:
                yield place, held[:at]
            held, place = held[at + len(marks[0]) :], PLACE[marks.pop(0)]
        keep = len(PREFIX) - 1 if marks else 0  # a mark may begin here and end in the next piece
        if place is not None and len(held) > keep:
            yield place, held[: len(held) - keep]
            held = held[len(held) - keep :]
    if place is not None and held:
        yield place, held


def digests(sorted_pieces: RDD) -> DataFrame:
    """ROW with output_sha256 and restored_sha256, once for each row of the documents behind the pieces."""
    spark = SparkSession.active()

    def out(records):
        for doc, (id_, form, n), copies, own in _documents(records):
            digest, chars, number = hashlib.sha256(), [0, 0, 0], 0

            def streamed(own=own, digest=digest):
                for _, data in own:
                    digest.update(data)
                    yield data

            for place, data in stretches_of(streamed(), form):
                chars[place] += _chars(data)
                yield (doc, (place, number)), data
                number += 1
            yield (doc, _LAST), repr((id_, form, n, chars, digest.hexdigest(), copies)).encode()

    def restored(records):
        for _, own in groupby(records, lambda r: r[0][0]):
            digest = hashlib.sha256()
            for (_, place), data in own:
                if place != _LAST:
                    digest.update(data)
                    continue
                id_, form, n, chars, output, copies = _head(data)
                told = (None, None) if form == "plain" else (chars[0], chars[1])
                for _ in range(copies):
                    yield id_, n, form, *told, output, digest.hexdigest()

    again = sorted_pieces.mapPartitions(out, preservesPartitioning=True)
    again = again.repartitionAndSortWithinPartitions(again.getNumPartitions(), _owner)  # partitioned like this already: sorts only
    return spark.createDataFrame(again.mapPartitions(restored), f"{ROW}, output_sha256 string, restored_sha256 string", verifySchema=False)


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """(doc_id, form, output) of every row: the texts that a model is trained on."""

    def out(records):
        for _, (id_, form, _), copies, own in _documents(records):
            text = b"".join(data for _, data in own).decode()
            for _ in range(copies):
                yield id_, form, text

    return docs.sparkSession.createDataFrame(pieces(docs, id_col, text_col, **rules).mapPartitions(out), "doc_id long, form string, output string", verifySchema=False)


def restored(outputs: DataFrame) -> DataFrame:
    """(doc_id, text) of rows (doc_id, form, output)."""

    def run(batches):
        for b in batches:
            texts = []
            for form, output in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = sorted(stretches_of(iter([output.encode()]), form), key=lambda s: s[0])
                texts.append(b"".join(x for _, x in own).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return outputs.select("doc_id", "form", "output").mapInArrow(run, "doc_id long, text string")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    Null and empty texts are plain, with no lines and the digest of nothing. A null id is hashed as no digits. Rows that
    repeat each other come out as often as they came in; an empty table gives an empty result. Only doc_id and text are read.
    """
    return digests(pieces(table(spark, sf_dir, "documents")))

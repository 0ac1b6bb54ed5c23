"""Files read by blocks against the same contents read whole."""

import random

import pytest
from pyspark.sql import functions as F

from stratalog.functions.rules import built_in
from stratalog.functions.text import CHUNK
from stratalog.operators.scan import fragments, line_arrays
from stratalog.sources import blocks
from stratalog.sources.artifacts import from_contents


def frame(spark, contents):
    return spark.createDataFrame([(f"f{k}", c) for k, c in enumerate(contents)], "artifact_path string, content binary")


def binary(rnd: random.Random, n: int) -> bytes:
    """Bytes of printable runs, wide runs at both parities, and others."""
    out = b""
    while len(out) < n:
        word = bytes(rnd.randrange(0x20, 0x7F) for _ in range(rnd.choice((1, 3, 4, 9, 40))))
        out += rnd.choice((word, word.decode().encode("utf-16-le"), b"\x00" + word.decode().encode("utf-16-le"), bytes(rnd.randrange(256) for _ in range(3)), b"\x00\x00", b"\xff"))
    return out[:n]


@pytest.mark.parametrize("block", [4, 7, 64, 1000])
def test_fragments_of_blocks(spark, block):
    rnd = random.Random(block)
    contents = [b"", b"\x00", b"abc", b"abcd", b"a\x00b\x00c\x00d\x00", b"x" * 300, "y".encode("utf-16-le") * 100, b"\x01" + "z".encode("utf-16-le") * 100] + [binary(rnd, rnd.randrange(400)) for _ in range(25)]
    files = frame(spark, contents)
    for exact in (True, False):
        want = fragments(files.withColumn("artifact_ord", F.col("artifact_path")), exact).collect()
        got = blocks.block_fragments(blocks.cut(files, block), exact).collect()
        assert sorted(map(tuple, got)) == sorted((r.artifact_ord, r.artifact_path, r.kind_ord, r.byte_offset, r.raw_line) for r in want) and got


def test_fragments_over_chunks(spark):
    edge = CHUNK - 10
    contents = [b"\x00" * edge + b"seen as far as the chunk" + b"\x00", b"\x00" * (CHUNK - 3) + b"not seen", b"\x00" * (CHUNK - 7) + "wide run".encode("utf-16-le"), b"q" * (2 * CHUNK + 5)]
    files = frame(spark, contents)
    for exact in (True, False):
        want = fragments(files.withColumn("artifact_ord", F.col("artifact_path")), exact)
        got = blocks.block_fragments(blocks.cut(files, 100_000), exact)
        columns = ["artifact_path", "kind_ord", "byte_offset", "raw_line"]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def text(rnd: random.Random, n: int, letters: str) -> str:
    return "".join(rnd.choice(letters) for _ in range(n))


def texts() -> list[bytes]:
    rnd = random.Random(9)
    out = [b"", b"\n", b"\r", b"\r\n", b"one", b"one\r\n\r\ntwo\r", b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff", b"\xff\xfea", b"\xff\xfe\x00\xd8", b"\xff\xfe\x00\xdc", b"\xef\xbb\xbf\xff", b"ab\xc3", b"ab\x81", b"abcdefgh\x81", "é".encode() + b"\x81", b"\x80abc", b"ab\x81\n", b"\xed\xa0\x80\n", b"\xf0\x9f\x98\x80" * 9]
    for _ in range(12):
        t = text(rnd, rnd.randrange(90), "ab\r\né漢😀\n ")
        plain = text(rnd, rnd.randrange(90), "ab\r\né\n")
        out += [t.encode(), b"\xef\xbb\xbf" + t.encode(), t.encode("utf-16"), b"\xfe\xff" + t.encode("utf-16-be"), plain.encode("latin-1"), plain.encode("latin-1") + b"\x81\r", t.encode()[:-1]]
    return out


@pytest.mark.parametrize("block", [4, 6, 64])
def test_lines_of_blocks(spark, block):
    contents = texts()
    files = frame(spark, contents)
    whole = line_arrays(from_contents(files.select(F.col("artifact_path").alias("path"), "content")))
    want = {r.artifact_path: (r.encoding, r.ok, r.lines) for r in whole.collect()}
    found, lines = blocks.decoded_lines(blocks.cut(files, block))
    assert {r.artifact_path: (r.encoding, r.ok) for r in found.collect()} == {k: v[:2] for k, v in want.items()}
    got: dict = {}
    for r in lines.orderBy("artifact_path", "line_number").collect():
        got.setdefault(r.artifact_path, []).append(r.raw_line)
        assert r.line_number == len(got[r.artifact_path]) and r.encoding == want[r.artifact_path][0]
    assert {k: got.get(k, []) for k, v in want.items() if v[1]} == {k: v[2] for k, v in want.items() if v[1]}
    assert not {k for k, v in want.items() if not v[1]} & set(got)


def test_files_on_disk(spark, tmp_path):
    from stratalog import api

    (tmp_path / "wide.log").write_bytes("first\r\nerror é here\nlast".encode("utf-16"))
    (tmp_path / "plain.log").write_bytes("ok\nok\nerror ü\nend\n".encode("latin-1"))
    (tmp_path / "payload.bin").write_bytes(b"\x00\x01prefix services.bit9.com timeout suffix\x00\xff")
    hits = api.scan_large_logs(spark, str(tmp_path), built_in(), block=8).filter("matched_text = 'error'").collect()
    assert sorted((h.artifact_path.rsplit("/", 1)[-1], h.line_number, h.raw_line, h.context_before, h.context_after, h.encoding) for h in hits) == [
        ("plain.log", 3, "error ü", "ok\nok", "end", "cp1252"), ("wide.log", 2, "error é here", "first", "last", "utf-16")
    ]
    hits = api.scan_large_binaries(spark, str(tmp_path / "payload.bin"), built_in(), block=8).collect()
    assert [(h.matched_text, h.byte_offset, h.match_type) for h in hits] == [("timeout", 2, "ascii-string"), ("services.bit9.com", 2, "ascii-string")]


def test_contents_are_computed_once(spark):
    """A content that is costly to compute is not computed again for every block of it."""
    met = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def costly(n):
        met.add(1)
        return b"ab" * n

    files = spark.range(3).select(F.col("id").cast("string").alias("artifact_path"), costly((F.col("id") * 500).cast("int")).alias("content"))
    got = blocks.cut(files, 64).groupBy("artifact_path").count().collect()
    assert {(r.artifact_path, r["count"]) for r in got} == {("0", 1), ("1", 16), ("2", 32)} and met.value == 3
    plan = blocks.cut(files, 64)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "substring" not in plan


def test_encodings_that_bytes_do_not_tell(spark, tmp_path):
    """Documents whose bytes fit another encoding by accident are read in the one they were written in, as the SQL has it."""
    from stratalog.plans import registry

    texts = [(0, "\ufeffmark"), (2, "Ã¼ber\nÃ¤"), (3, "word\nSpaß"), (5, "\ufeff"), (7, "ÿþab"), (8, "þÿ\nab"), (10, "ß"), (12, "plain"), (13, "é and ß"), (17, "Spaß"), (18, "漢É"), (6, "\ufeffx"), (9, "ÿþ"), (23, "Ã" * 600 + "É")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {k: {1: "utf-8-sig", 2: "cp1252", 3: "latin-1", 4: "utf-16"}.get(k % 5, "utf-8") for k, _ in texts} | {12: "utf-8"}
    known = {k: ("".join(c if c < "\x80" or "\xa0" <= c <= "\xff" else "?" for c in t) if k % 5 in (2, 3) else t) + ("\x81" if k % 5 == 3 else "") for k, t in texts}
    lines = registry.QUERIES["block_lines"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, lines)) == sorted((k, want[k], n + 1, x) for k, t in known.items() for n, x in enumerate(t.split("\n")))
    chain = registry.QUERIES["decode_chain"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, chain)) == sorted((k, want[k], t.count("\n") + 1, len(t)) for k, t in known.items())

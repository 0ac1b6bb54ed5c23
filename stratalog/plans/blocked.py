"""Queries over files that are read by blocks: runs and lines cross the edges of blocks much smaller than the files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import blocks
from . import views as V
from .register import query

#: Bytes of a block.
RUNS, LINES = 1024, 512
_PARTS = r"""string_split_regex(w, '[\x20-\x7e]{4,}') AS g, regexp_extract_all(w, '[\x20-\x7e]{4,}') AS m"""


@query("block_fragments", rf"""WITH t AS (SELECT doc_id, {_PARTS} FROM (SELECT doc_id, coalesce(text, '') AS w FROM documents)),
x AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM t)
SELECT 'doc-' || doc_id || '.bin' AS artifact_path, CAST(0 AS INT) AS kind_ord, CAST(list_sum(list_transform(g[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: strlen(x))), 0) AS BIGINT) AS byte_offset, m[i] AS raw_line
FROM x WHERE doc_id % 2 = 0
UNION ALL SELECT 'doc-' || doc_id || '.bin', CAST(1 + doc_id // 2 % 2 AS INT), CAST(doc_id // 2 % 2 + 2 * (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)) AS BIGINT), m[i]
FROM x WHERE doc_id % 2 = 1""")
def block_fragments(spark, sf_dir):
    """Printable runs of documents as UTF-8 or, for odd ids, as UTF-16LE at even or odd places, read by blocks of 1 KiB."""
    t, k = F.coalesce("text", F.lit("")), F.col("doc_id")
    wide = F.concat(F.when(F.floor(k / 2) % 2 == 1, F.lit(b"\x01")).otherwise(F.lit(b"")), F.encode(t, "UTF-16LE"))
    name = F.concat(F.lit("doc-"), k.cast("string"), F.lit(".bin"))
    files = V.read(spark, sf_dir, "documents").select(name.alias("artifact_path"), F.when(k % 2 == 1, wide).otherwise(t.cast("binary")).alias("content"))
    return blocks.block_fragments(blocks.cut(files, RUNS)).drop("artifact_ord")


@query("block_lines", r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 IN (2, 3) THEN regexp_replace(t, '[^\x{00}-\x{7f}\x{a0}-\x{ff}]', '?', 'g') ELSE t END || CASE WHEN doc_id % 5 = 3 THEN chr(129) ELSE '' END AS t
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
s AS (SELECT doc_id, string_split_regex(t, '\r\n|\r|\n') AS s, CASE WHEN doc_id % 5 = 1 THEN 'utf-8-sig' WHEN doc_id % 5 = 3 THEN 'latin-1' WHEN doc_id % 5 = 4 THEN 'utf-16'
  WHEN doc_id % 5 = 2 AND regexp_matches(t, '[\x{a0}-\x{ff}]') THEN 'cp1252' ELSE 'utf-8' END AS encoding FROM t)
SELECT doc_id, encoding, i AS line_number, s[i] AS raw_line FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM s) WHERE i < len(s) OR s[i] <> ''""")
def block_lines(spark, sf_dir):
    """Numbered lines of documents in five encodings, each decided over all blocks of a file, unless its bytes can't tell, and decoded by blocks of 512 bytes."""
    files = V.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("artifact_path"), V.encoded_text().alias("content"))
    _, lines = blocks.decoded_lines(blocks.cut(files, LINES), told=V.told_encodings(spark, sf_dir))
    return lines.select(F.col("artifact_path").cast("long").alias("doc_id"), "encoding", "line_number", "raw_line")

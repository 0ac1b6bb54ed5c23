"""Vector code compression: product codes by integer k-means, nearest entries by equal-average search.

Components become integers, vectors are cut into parts, and every part position has a codebook of its own. In each round
tasks assign their vectors' parts to the nearest entries and sum them by entry; the sums of all tasks are added by Spark and
become the next codebook, which has a fixed size whatever the number of vectors. All of it is integer arithmetic, so
results do not depend on how rows are dealt.

The nearest entry is found by equal-average search: entries are sorted by the sum of their components; from the place of a
part's own sum the search goes outward to both sides, always to the entry with the smaller gap between the sums. By the
Cauchy-Schwarz inequality the squared gap over the dimension is no more than the squared distance, so the search ends as
soon as it strictly exceeds the best distance so far; equal bounds are still looked at, so ties go to the lower index.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .common import join_counted, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
_TOP, _BOTTOM = (1 << 63) - 1, -(1 << 63)
PACKED = "ids array<long>, labels array<long>, kind string, data binary"


@dataclass(frozen=True)
class Codebook:
    """``entries[p]`` is a matrix of the entries of part position p, all of the same width."""

    entries: tuple[np.ndarray, ...]

    @property
    def width(self) -> int:
        return self.entries[0].shape[1]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = SCALE) -> DataFrame:
    """(id, label, v array<long>): floor(scale * x) of every component; beyond 64 bits the largest or smallest long.

    Rows with a null vector or a null or non-finite component are dropped; null ids and labels stay.
    """
    inf = float("inf")
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(F.col(vector_col), lambda e: e.cast("double")).alias("x"))
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(inf))
    whole = lambda e: F.floor(F.least(F.greatest(F.lit(scale) * e, F.lit(-(2.0**63))), F.lit(2.0**63)))
    return x.filter(F.col("x").isNotNull() & ~F.exists("x", bad)).select("id", "label", F.transform("x", whole).alias("v"))


def _narrow(m: np.ndarray) -> np.ndarray:
    least, most = int(m.min(initial=0)), int(m.max(initial=0))
    return m.astype(next(t for t in map(np.dtype, ("<i1", "<i2", "<i4", "<i8")) if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def packed(vectors: DataFrame, width: int) -> DataFrame:
    """PACKED rows of many vectors each: their matrix, padded with zeros to ``width``, in as few bytes a component as it takes."""

    def run(batches):
        for b in batches:
            lists = b.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            m = np.zeros((len(sizes), width), np.int64)
            m[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            m = _narrow(m)
            yield pa.RecordBatch.from_pydict({"ids": [b.column(0).to_pylist()], "labels": [b.column(1).to_pylist()], "kind": [m.dtype.str], "data": [m.tobytes()]})

    return vectors.select("id", "label", "v").mapInArrow(run, PACKED)


def _matrices(batches):
    for b in batches:
        for r in b.to_pylist():
            yield r["ids"], r["labels"], np.frombuffer(r["data"], r["kind"]).reshape(len(r["ids"]), -1)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, squared distance, distances computed) for each row of ``parts``, by equal-average search."""
    n, dim = parts.shape
    top = max([0, *(max(int(m.max()), -int(m.min())) for m in (parts, entries) if m.size)])
    kind = np.int64 if 4 * top * top * max(dim, 1) ** 2 < 1 << 62 else object  # beyond that Python's own integers
    parts, entries = parts.astype(kind), entries.astype(kind)
    sums, own = entries.sum(axis=1), parts.sum(axis=1)
    order = sorted(range(len(entries)), key=lambda k: (sums[k], k))
    sums, entries, order = sums[order], entries[order], np.array(order)
    right = np.searchsorted(sums, own) if kind is np.int64 else np.array([sum(1 for s in sums if s < o) for o in own], np.int64)
    left = right - 1
    best, at, computed = np.full(n, -1, kind), np.full(n, len(order), np.int64), 0
    active = np.arange(n)
    for _ in range(len(order)):
        lo, hi, mine = left[active], right[active], own[active]
        down = mine - sums[np.maximum(lo, 0)]
        up = sums[np.minimum(hi, len(order) - 1)] - mine
        go_down = (lo >= 0) & ((hi >= len(order)) | (down <= up))
        gap = np.where(go_down, down, up)
        open_ = (best[active] < 0) | (gap * gap <= best[active] * dim)
        active, go_down = active[open_], go_down[open_]
        if not len(active):
            break
        k = np.where(go_down, left[active], right[active])
        left[active] -= go_down
        right[active] += ~go_down
        d = parts[active] - entries[k]
        distance = (d * d).sum(axis=1).astype(kind)
        computed += len(active)
        better = (best[active] < 0) | (distance < best[active]) | ((distance == best[active]) & (order[k] < at[active]))
        best[active[better]], at[active[better]] = distance[better], order[k[better]]
    return at, best, computed


def _first(vectors: DataFrame, parts: int, entries: int, width: int) -> Codebook:
    """The parts of the vectors with the smallest ids; null ids come last, ties go by the components."""
    rows = vectors.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    m = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        m[i, : len(r.v)] = r.v
    return Codebook(tuple(np.hsplit(m, parts)))


def _moved(blocks: DataFrame, book: Codebook) -> Codebook:
    """One round: every entry goes to the floor of the mean of the parts assigned to it; those without any stay."""
    parts, width = len(book.entries), book.width

    def run(batches):
        sums: dict[tuple[int, int], list] = {}
        for _, _, m in _matrices(batches):
            for p in range(parts):
                own = m[:, p * width : (p + 1) * width]
                at, _, _ = nearest(own, book.entries[p])
                wide = own.dtype.itemsize < 8
                for k in np.unique(at):
                    some = own[at == k]
                    total = some.sum(axis=0, dtype=np.int64).tolist() if wide else [sum(c) for c in zip(*some.tolist())]
                    n, before = sums.get((p, int(k)), (0, [0] * width))
                    sums[p, int(k)] = (n + len(some), [a + b for a, b in zip(before, total)])
        if sums:
            rows = [(p, k, i, n, s) for (p, k), (n, total) in sums.items() for i, s in enumerate(total)]
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)))], names=["part", "entry", "place", "n", "total"])

    moved = [e.copy() for e in book.entries]
    summed = blocks.mapInArrow(run, "part int, entry int, place int, n long, total decimal(38,0)").groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    for r in summed.collect():  # as many rows as the codebook has components
        moved[r.part][r.entry, r.place] = int(r.total) // r.n
    return Codebook(tuple(moved))


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebook]:
    """(packed vectors, stored; codebook) for the vectors (id, label, v). At most 256 entries a part.

    Vectors of unlike lengths, or lengths that the parts do not divide, count as padded with zeros. Of fewer vectors than
    entries each is an entry.
    """
    longest = vectors.agg(F.max(F.size("v")).alias("n")).first().n or 0
    width = -(-longest // parts) * parts
    blocks = cut_lineage(packed(vectors, width))
    book = _first(vectors, parts, entries, width)
    for _ in range(rounds if len(book.entries[0]) else 0):
        book = _moved(blocks, book)
    return blocks, book


def encode(blocks: DataFrame, book: Codebook) -> DataFrame:
    """(id, label, code, error) of every packed vector; an error beyond 64 bits is the largest long."""
    parts, width = len(book.entries), book.width

    def run(batches):
        for ids, labels, m in _matrices(batches):
            found = [nearest(m[:, p * width : (p + 1) * width], book.entries[p])[:2] for p in range(parts)]
            codes = np.column_stack([at for at, _ in found]).astype(np.uint8)
            total = sum(d.astype(object) for _, d in found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array([c.tobytes().hex() for c in codes]), pa.array([min(int(t), _TOP) for t in total], pa.int64())], names=["id", "label", "code", "error"])

    return blocks.mapInArrow(run, "id long, label long, code string, error long")


def decode(codes: DataFrame, book: Codebook) -> DataFrame:
    """(id, v) of rows (id, code): the vectors that the codes stand for."""

    def run(batches):
        for b in batches:
            found = [np.concatenate([book.entries[p][k] for p, k in enumerate(bytes.fromhex(c))]).tolist() for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "v"])

    return codes.select("id", "code").mapInArrow(run, "id long, v array<long>")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded``, which is stored, with label_error: the sum of error over equal labels, nulls together; beyond 64 bits the largest long."""
    keyed = coded.withColumn("no_label", F.col("label").isNull()).withColumn("key", F.coalesce("label", F.lit(0).cast("long"))).drop("label")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_TOP).cast("decimal(38,0)")).cast("long")
    counted = cut_lineage(keyed.groupBy("no_label", "key").agg(total.alias("label_error"), F.count("*").alias("rows_of_key")))
    return join_counted(keyed, counted, ["no_label", "key"]).withColumn("label", F.when(~F.col("no_label"), F.col("key"))).drop("no_label", "key")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of every vector that is kept: vec_id, code, error, label_error, codebooks_sha256.

    Null vectors and vectors with null or non-finite components are dropped; null ids are coded and come last among the
    first entries; rows that repeat an id are coded each; null labels are one label; an empty table gives an empty result.
    Columns other than vec_id, embedding and label are not read.
    """
    blocks, book = learn(quantise(table(spark, sf_dir, "embeddings")))
    out = with_label_errors(cut_lineage(encode(blocks, book)))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL: a codebook table and an assignment for each round, by comparing every part with every entry."""
    distance = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    out = [f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE:.0f} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS n, len(v) // {PARTS} AS w FROM kept
), parts AS MATERIALIZED (
  SELECT n, p, v[p * w + 1 : p * w + w] AS v FROM numbered, range({PARTS}) t(p)
), book0 AS MATERIALIZED (SELECT p, n - 1 AS k, v FROM parts WHERE n <= {ENTRIES})"""]
    for r in range(ROUNDS + 1):
        out.append(f"""near{r} AS MATERIALIZED (
  SELECT n, p, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT x.n, x.p, c.k, CAST({distance} AS BIGINT) AS d FROM parts x JOIN book{r} c USING (p)) GROUP BY n, p
)""")
        if r < ROUNDS:
            out.append(f"""means{r} AS MATERIALIZED (
  SELECT p, k, list(CAST(floor(s / c) AS BIGINT) ORDER BY i) AS v FROM (
    SELECT p, k, i, CAST(sum(x.v[i]) AS BIGINT) AS t, count(*) AS c, t - ((t % c) + c) % c AS s
    FROM parts x JOIN near{r} USING (n, p), range(1, len(x.v) + 1) g(i) GROUP BY p, k, i) GROUP BY p, k
), book{r + 1} AS MATERIALIZED (SELECT p, b.k, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN means{r} m USING (p, k))""")
    out.append(f"""book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book{ROUNDS}
), coded AS (
  SELECT n, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY n
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN numbered USING (n), book""")
    return ",\n".join(out)


OP13_SQL = _sql()

"""Exact top-k search by exhaustive term-at-a-time accumulation.

A term is a vector component; its postings are the components of a block of candidates. For each term, the query rows
that hold it (weight not zero) scatter weight x posting into a dense score array of queries x candidates. Each block
gives its k best by partition selection; the blocks' best are merged. Blocks of queries meet blocks of candidates by
an equi-join on the cells of a grid, whose sides follow the numbers of blocks: a cell has a bounded number of pairs of
blocks, and each side is copied as rarely as that allows. Nothing unbounded is broadcast or collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .common import map_batches, table

K, QUERY_BLOCK, CANDIDATE_BLOCK = 5, 512, 1024
#: Pairs of blocks in a cell of the grid.
PAIRS = 64


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, row, v array<long>): floor(scale * x) of every component; beyond 64 bits the largest or smallest long. ``row`` tells rows
    apart that repeat an id; to be the same in two places the result has to be stored.

    Rows with a null id, a null vector, or a null or non-finite component take no part.
    """
    v, inf = F.col(vector_col), float("inf")
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda e: e.cast("double")).alias("x"))
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(inf))
    whole = lambda e: F.floor(F.least(F.greatest(F.lit(scale) * e, F.lit(-(2.0**63))), F.lit(2.0**63)))
    return x.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", bad)).select("id", F.monotonically_increasing_id().alias("row"), F.transform("x", whole).alias("v"))


def _pack(rows: pa.Table) -> pa.Table:
    """Rows (block, id, row, v) of one block as one row of the ids, the rows' numbers and the zero-padded matrix, in as few bytes a component as it takes."""
    lists = rows.column("v").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat, dim = lists.flatten().to_numpy(zero_copy_only=False), int(sizes.max(initial=0))
    least, most = int(flat.min(initial=0)), int(flat.max(initial=0))
    kind = next(t for t in map(np.dtype, ("<i1", "<i2", "<i4", "<i8")) if np.iinfo(t).min <= least and most <= np.iinfo(t).max)
    m = np.zeros((len(sizes), dim), kind)
    m[np.arange(dim)[None, :] < sizes[:, None]] = flat
    ids, own = (pa.array([rows.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in ("id", "row"))
    return pa.table({"block": rows.column("block").slice(0, 1), "ids": ids, "rows": own, "dim": pa.array([dim], pa.int32()), "kind": pa.array([kind.str]), "data": pa.array([m.tobytes()], pa.binary())})


def _blocks(vectors: DataFrame, size: int, rows: int) -> DataFrame:
    """(block, ids, rows, dim, kind, data): the ``rows`` vectors dealt by their place into blocks of about ``size``."""
    n = max(1, -(-rows // size))
    dealt = vectors.select("id", "row", "v", F.pmod(F.xxhash64("row"), F.lit(n)).alias("block"))
    return dealt.select("block", "id", "row", "v").groupBy("block").applyInArrow(_pack, "block long, ids binary, rows binary, dim int, kind string, data binary")


def grid(queries: int, candidates: int, parallelism: int, pairs: int = PAIRS) -> tuple[int, int]:
    """(rows, columns) of the grid for so many blocks: candidates are dealt over rows and copied to every column, queries the other way round."""
    cells = max(min(3 * parallelism, queries * candidates), -(-queries * candidates // pairs))
    columns = min(queries, max(1, round((cells * queries / candidates) ** 0.5)))
    return min(candidates, -(-cells // columns)), columns


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of q and c, one term after another; beyond 64 bits the largest or smallest long."""
    terms = min(q.shape[1], c.shape[1])
    most = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    top = most(q) * most(c) * max(terms, 1)
    scores = np.zeros((len(q), len(c)), np.int64 if top < 1 << 62 else object)
    for t in range(terms):
        holders = np.flatnonzero(q[:, t])
        if len(holders) == 0:
            continue
        weights, postings = q[holders, t].astype(scores.dtype), c[:, t].astype(scores.dtype)
        if len(holders) == len(q):
            scores += weights[:, None] * postings[None, :]
        else:
            scores[holders] += weights[:, None] * postings[None, :]
    return scores if scores.dtype != object else np.clip(scores, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(scores: np.ndarray, qids: np.ndarray, qrows: np.ndarray, cids: np.ndarray, crows: np.ndarray, k: int):
    """(query, its row, candidate, score) of the k best of each row, ties to the smaller id, the query's own row left out."""
    order = np.argsort(cids, kind="stable")
    cids, crows, scores = cids[order], crows[order], scores[:, order]
    for i, q in enumerate(qids):
        row, ids = scores[i], cids
        if (own := crows == qrows[i]).any():
            row, ids = row[~own], ids[~own]
        if len(row) > k:
            least = row[np.argpartition(row, len(row) - k)[len(row) - k]]
            above, ties = np.flatnonzero(row > least), np.flatnonzero(row == least)
            at = np.concatenate((above, ties[: k - len(above)]))
        else:
            at = np.arange(len(row))
        for j in at:
            yield int(q), int(qrows[i]), int(ids[j]), int(row[j])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query (id, row, v) among the candidates (id, row, v), both stored.

    Shorter vectors count as padded with zeros. Ties go to the smaller id; a query never finds its own row. Rows that
    repeat an id are candidates of their own and, among the queries, queries of their own: each has its k best, in which the
    other rows of its id may stand. Scores beyond 64 bits are the largest or smallest long. No queries or no candidates give no rows.
    """
    n_queries, n_candidates = queries.count(), candidates.count()
    rows, columns = grid(max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n_candidates // CANDIDATE_BLOCK)), queries.sparkSession.sparkContext.defaultParallelism)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = _blocks(queries, QUERY_BLOCK, n_queries).withColumn("col", F.pmod("block", F.lit(columns))).withColumn("row", every(rows))
    c = _blocks(candidates, CANDIDATE_BLOCK, n_candidates).withColumn("row", F.pmod("block", F.lit(rows))).withColumn("col", every(columns))
    sides = [F.col(f"{side}.{name}").alias(f"{side}_{name}") for side in "qc" for name in ("ids", "rows", "dim", "kind", "data")]
    met = q.alias("q").join(c.alias("c"), ["row", "col"]).select(*sides)

    def run(batch):
        for r in batch.to_pylist():
            ids = [np.frombuffer(r[f"{x}_{name}"], np.int64) for x in "qc" for name in ("ids", "rows")]
            m = [np.frombuffer(r[f"{x}_data"], r[f"{x}_kind"]).reshape(len(i), r[f"{x}_dim"]) for x, i in zip("qc", ids[::2])]
            a = list(zip(*_best(_scores(*m), *ids, k))) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in a], names=["query_id", "query_row", "vec_id", "score"])

    best = map_batches(met, run, "query_id long, query_row long, vec_id long, score long")
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every vector whose vec_id is divisible by 50 against all vectors: query_id, rank, vec_id, score.

    Vectors null or with null or non-finite components take no part, nor do null ids; repeated rows are candidates and
    queries of their own; ties go to the smaller id; an empty table gives an empty result.
    """
    vectors = cut_lineage(quantise(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))
    return top_k(vectors.filter("id % 50 = 0"), vectors)


OP10_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id AS id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.id AS query_id, q.n, c.id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id % 50 = 0 AND q.n <> c.n
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

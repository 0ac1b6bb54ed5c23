"""Quality of texts: random Fourier features of document statistics, ridge scores, isotonic calibration.

``statistics`` describes a whole text by seventeen numbers: its length, shapes of its words and lines, shares of kinds of
characters, and how much it repeats itself. They are brought to mean zero and unit spread over all documents. Cosines of
random projections of them approximate a Gaussian kernel (Rahimi and Recht), so ridge regression on the cosines is kernel
regression whose normal equations have a fixed size. Every partition of labelled rows sums its own equations, one matrix for
each fold; the sums of all partitions are added row by row of the matrix, and the small system is solved once for each fold
and once for all. Scores of rows under the model of the other folds, with their labels, give an isotonic curve by pooling
adjacent violators; it turns scores into probabilities.

Every labelled document is used; there is no sample. What reaches the driver has a size that does not depend on the
number of rows: the equations, seventeen means and spreads, and a table of labels by score, scores being kept to four
decimals between -1 and 2 for it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .common import map_batches, table

FOLDS, HELD_OUT = 3, 1
FEATURES, WIDTH, RIDGE, SEED = 256, 4.0, 1e-3, 11
#: Folds for calibration, steps of a score in the table of labels, labelled rows for each part that sums equations.
CALIBRATION, STEPS, ROWS, PARTS = 5, 10_000, 20_000, 2_000

#: Kinds of bytes of a text in UTF-8.
SPACE, LINE, SMALL, CAPITAL, DIGIT, STOP, MARK, OTHER, HIGH, FOLLOWS = range(10)
NAMES = (
    "characters", "words", "letters of a word", "spread of word lengths", "capitals of letters", "digits", "stops", "marks", "words without a letter", "words that end in a mark",
    "distinct words", "words like the one before", "most frequent word", "entropy of words", "characters of a line", "lines that repeat", "entropy of letters",
)


def _kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, np.int64)
    for codes, kind in ((b" \t\v\f\r", SPACE), (b"\n", LINE), (bytes(range(97, 123)), SMALL), (bytes(range(65, 91)), CAPITAL), (b"0123456789", DIGIT), (b".,;:?!'\"()-", STOP), (b"#$%&*+/<=>@[\\]^_`{|}~", MARK), (bytes(range(0xC0, 256)), HIGH), (bytes(range(0x80, 0xC0)), FOLLOWS)):
        kinds[list(codes)] = kind
    return kinds


_KINDS = _kinds()
_LETTER = np.isin(_KINDS, (SMALL, CAPITAL, HIGH, FOLLOWS))


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(counts.sum(), 1)
    return float(-(p * np.log(p)).sum())


def statistics(text: str | None) -> np.ndarray:
    """The numbers of NAMES for a whole text; null counts as empty, all numbers of which are zero."""
    data = (text or "").encode("utf-8", "replace")
    out = np.zeros(len(NAMES))
    if not data:
        return out
    raw = np.frombuffer(data, np.uint8)
    by_byte = np.bincount(raw, minlength=256)
    n = np.bincount(_KINDS, by_byte, 10)
    chars = n.sum() - n[FOLLOWS]
    letters = n[SMALL] + n[CAPITAL] + n[HIGH]
    words = data.split()
    lines = data.split(b"\n")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    count = max(len(words), 1)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    often = np.bincount(ids) if len(ids) else np.zeros(1, np.int64)
    ends = np.fromiter((w[-1] for w in words), np.int64, len(words))
    bare = sum(1 for w in words if not _LETTER[w[0]] and not _LETTER[np.frombuffer(w, np.uint8)].any())
    small = by_byte[97:123] + by_byte[65:91]
    out[:] = (
        np.log1p(chars), np.log1p(len(words)), letters / count, np.log1p(lengths.std()) if len(words) else 0.0, n[CAPITAL] / max(letters, 1), n[DIGIT] / chars, n[STOP] / chars, (n[MARK] + n[OTHER]) / chars, bare / count,
        float(np.isin(_KINDS[ends], (MARK, OTHER)).sum()) / count, len(numbers) / count, float((ids[1:] == ids[:-1]).sum()) / count, float(often.max()) / count, _entropy(often), np.log1p(chars / len(lines)),
        1 - len(set(lines)) / len(lines), _entropy(small),
    )
    return out


@dataclass(frozen=True)
class Scorer:
    """``curve`` holds scores and their probabilities, both rising."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        """Probabilities of rows of statistics."""
        raw = features(stats, self.mean, self.spread) @ self.weights
        return np.clip(np.interp(raw, *self.curve), 0.0, 1.0)


def features(stats: np.ndarray, mean: np.ndarray, spread: np.ndarray, n: int = FEATURES, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """One, then ``n`` random Fourier features of each row; the statistics are clipped to eight spreads."""
    rng = np.random.default_rng(seed)
    directions, shift = rng.normal(0, 1 / width, (stats.shape[1], n)), rng.uniform(0, 2 * np.pi, n)
    x = np.clip((stats - mean) / spread, -8, 8)
    return np.column_stack([np.ones(len(x)), np.sqrt(2 / n) * np.cos(x @ directions + shift)])


def pooled(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: (scores, shares) of the ends of the pooled blocks. ``scores`` rise; labels are sums over counts."""
    blocks: list[list[float]] = []  # first score, last score, sum, count
    for s, y, n in zip(scores.tolist(), labels.tolist(), counts.tolist()):
        blocks.append([s, s, y, n])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, last, y1, n1 = blocks.pop()
            blocks[-1][1:] = [last, blocks[-1][2] + y1, blocks[-1][3] + n1]
    at = [x for b in blocks for x in b[:2]]
    return np.array(at), np.array([b[2] / b[3] for b in blocks for _ in range(2)])


def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text leaves HELD_OUT by FOLDS; a null id is not held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats) of every row: its whole text is read once."""

    def run(batch):
        stats = np.concatenate([np.zeros((0, len(NAMES))), *[statistics(t.as_py())[None] for t in batch.column(1)]])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, stats.size + 1, len(NAMES)), stats.ravel())], names=["id", "stats"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def _equations(known: DataFrame, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Sums [fold, row, column] of x x^T with x y as last column and y^2 left out; ``known`` is (id, stats, label, fold)."""
    size = FEATURES + 1

    def partial(batches):
        sums = np.zeros((CALIBRATION, size, size + 1))
        for b in batches:
            stats, y, fold = _matrix(b.column(1)), b.column(2).to_numpy(), b.column(3).to_numpy()
            for k in np.unique(fold):
                x = features(stats[fold == k], mean, spread)
                sums[k] += x.T @ np.column_stack([x, y[fold == k]])
        yield pa.RecordBatch.from_pydict({"row": pa.array(range(size), pa.int32()), "sums": [np.ascontiguousarray(sums[:, i]).tobytes() for i in range(size)]})

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(CALIBRATION * (size + 1))
        for s in sorted(rows.column("sums").to_pylist()):
            total += np.frombuffer(s)
        return pa.table({"row": rows.column("row").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    summed = known.mapInArrow(partial, "row int, sums binary").groupBy("row").applyInArrow(add, "row int, sums binary")
    out = np.zeros((CALIBRATION, size, size + 1))
    for r in summed.collect():  # as many rows as features
        out[:, r["row"]] = np.frombuffer(r["sums"]).reshape(CALIBRATION, size + 1)
    return out


def _solved(sums: np.ndarray, rows: float) -> np.ndarray:
    a = sums[:, :-1].copy()
    a[np.arange(1, len(a)), np.arange(1, len(a))] += RIDGE * max(rows, 1.0)  # the constant is not held down
    a[0, 0] += 1e-9
    return np.linalg.solve(a, sums[:, -1])


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Scorer:
    """The scorer for the rows of ``stats``, which is stored, that have a label and are not held out.

    Repeated labels count as the highest of them; null ids and labels do not count; rows that repeat a labelled id count
    each. Without any labelled row there is nothing to tell by and every score is a half; with labels of one kind only,
    every score is that kind.
    """
    n = len(NAMES)
    parts = [f(F.get("stats", F.lit(k))) for k in range(n) for f in (F.avg, F.stddev_pop)]
    told = stats.agg(*[c.alias(f"c{k}") for k, c in enumerate(parts)]).first()
    mean = np.array([told[2 * k] or 0.0 for k in range(n)])
    spread = np.array([told[2 * k + 1] or 0.0 for k in range(n)])
    spread = np.where(spread > 1e-9, spread, 1.0)
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("double").alias("label"))
    known = cut_lineage(stats.join(marked, "id").select("id", "stats", F.when(F.col("label") > 0, 1.0).otherwise(0.0).alias("label"), F.pmod(F.xxhash64("id"), F.lit(CALIBRATION)).cast("int").alias("fold")))
    rows = known.count()
    if not rows:
        return Scorer(mean, spread, np.zeros(FEATURES + 1), (np.zeros(1), np.full(1, 0.5)))
    dealt = known.repartition(min(PARTS, -(-rows // ROWS)), "id") if rows > ROWS else known.coalesce(1)
    sums = _equations(dealt, mean, spread)
    whole, every = sums.sum(axis=0), sums[:, 0, 0]
    others = np.array([_solved(whole - sums[k], rows - every[k]) if every[k] < rows else _solved(whole, rows) for k in range(CALIBRATION)])

    def told_apart(batches):
        for b in batches:
            x, fold = features(_matrix(b.column(1)), mean, spread), b.column(3).to_numpy()
            raw = np.clip(np.einsum("ij,ij->i", x, others[fold]), -1, 2)
            yield pa.RecordBatch.from_pydict({"step": np.rint(raw * STEPS).astype(np.int32), "label": b.column(2)})

    counts = known.mapInArrow(told_apart, "step int, label double").groupBy("step").agg(F.sum("label").alias("y"), F.count("*").cast("double").alias("n")).orderBy("step").collect()  # at most 3 * STEPS + 1 rows
    curve = pooled(np.array([r.step / STEPS for r in counts]), np.array([r.y for r in counts]), np.array([r.n for r in counts]))
    return Scorer(mean, spread, _solved(whole, rows), curve)


def score(stats: DataFrame, scorer: Scorer) -> DataFrame:
    """(id, score) of every row of ``stats``."""
    model = stats.sparkSession.sparkContext.broadcast(scorer)

    def run(batch):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value(_matrix(batch.column(1))))], names=["id", "score"])

    return map_batches(stats, run, "id long, score double")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document: doc_id, held_out, score, predicted.

    Null and empty texts have statistics of zero and are scored like any other. Null ids are not held out; null and
    repeated ids come out as they came in; the same texts get the same score; an empty table gives an empty result.
    Columns other than doc_id and text are not read.
    """
    stats = cut_lineage(described(table(spark, sf_dir, "documents")))
    scored = score(stats, fit(stats, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

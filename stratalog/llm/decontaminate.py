"""Benchmark decontamination through a distributed positional inverted index; built-in functions only.

The index has one posting (row, term, pos) for each place of a wanted term in the corpus. A test window is looked up
from its rarest terms, by the counts of the whole corpus: the posting lists of the rarest and the second rarest are
adjusted by the terms' offsets in the window and intersected; where both agree on a start, the whole phrase is compared
with the words that the rarest term's posting has around it. Windows with the same two terms at the same distance share
one intersection. Only terms that are one of the two rarest of some window have postings, so common words have none.

The index is built once for all windows, in one pass over the texts after one pass that counts the terms, and is stored
in the shared folder, so its row numbers are given once. The empty term, which no text holds, marks the end of each row:
its place is the row's length in words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .common import ascii_lower, broadcast_if_small, table

WINDOW = 10
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text after A-Z became a-z; null has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), _GAPS), ""), F.array().cast("array<string>"))


def test_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(window, items): distinct runs of ``size`` words, and the sorted ids of the items that hold them.

    An item of fewer words, but not none, is one window. Items with a null id are left out.
    """
    w = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    runs = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.lit(size)))).alias("window"))
    return runs.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, words) of every row."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))


def term_counts(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, freq): how often each of the terms, which are stored, occurs in the whole corpus."""
    found = rows.select(F.explode_outer("words").alias("term")).join(broadcast_if_small(terms), "term")
    return found.groupBy("term").agg(F.count("*").alias("freq"))


def build_index(rows: DataFrame, terms: DataFrame, radius: int = WINDOW - 1) -> DataFrame:
    """Postings (row, doc_id, term, pos, low, near) of the terms (term, anchor), and the end of each row under the empty term.

    At anchors ``near`` holds the words from place ``low`` to ``pos`` + ``radius``; elsewhere it is null, and ``doc_id`` is
    null but at ends. Without a column ``anchor`` no term is one. The index is stored in the shared folder.
    """
    anchor = F.col("anchor") if "anchor" in terms.columns else F.lit(False)
    ends = terms.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(False).alias("anchor"))
    wanted = cut_lineage(terms.select("term", anchor.alias("anchor")).unionByName(ends))
    places = rows.select("row", "doc_id", "words", F.posexplode_outer(F.concat("words", F.array(F.lit("")))).alias("pos", "term"))
    low = F.greatest(F.col("pos") - radius, F.lit(0))
    near = F.slice("words", F.col("low") + 1, F.col("pos") - F.col("low") + 1 + radius)
    met = places.join(broadcast_if_small(wanted), "term").withColumn("low", low)
    return cut_lineage(met.select("row", F.when(F.col("term") == "", F.col("doc_id")).alias("doc_id"), "term", "pos", "low", F.when(F.col("anchor"), near).alias("near")))


def lookups(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, n, term, off, term2, gap, pair): the rarest and second rarest place of each window; windows with an absent term are left out.

    ``pair`` is a number for (term, term2, gap); windows of one word have it twice.
    """
    places = windows.select("window", F.posexplode("window").alias("off", "term")).join(broadcast_if_small(counts), "term", "left")
    rare = places.groupBy("window").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "term", "off"))).alias("rare"))
    first, second = F.col("rare")[0], F.coalesce(F.get("rare", F.lit(1)), F.col("rare")[0])
    told = rare.filter(first["freq"] > 0).select("window", F.size("window").alias("n"), first["term"].alias("term"), first["off"].alias("off"), second["term"].alias("term2"), (second["off"] - first["off"]).alias("gap"))
    return told.withColumn("pair", F.xxhash64("term", "term2", "gap"))


def phrase_matches(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, low, high, window): every place of every window of ``wanted`` (as ``lookups`` gives them), from its first word to behind its last."""
    pairs = cut_lineage(wanted.select("term", "term2", "gap", "pair").distinct())
    shapes = cut_lineage(wanted.groupBy("pair").agg(F.collect_set(F.struct("off", "n")).alias("shapes")))  # at most a window's length squared each
    postings = index.filter("term <> ''")
    first = postings.select("row", "pos", "term").join(broadcast_if_small(pairs.select("term", "pair")), "term").select("row", "pos", "pair")
    second = postings.select("row", "pos", F.col("term").alias("term2")).join(broadcast_if_small(pairs.select("term2", "gap", "pair")), "term2").select("row", (F.col("pos") - F.col("gap")).alias("pos"), "pair")
    met = cut_lineage(first.join(second, ["row", "pos", "pair"]).join(broadcast_if_small(shapes), "pair").select("row", "pos", "shapes"))
    around = postings.filter("near is not null").select("row", "pos", "low", "near")
    met = around.join(met, ["row", "pos"]).select("row", "pos", "low", "near", F.explode("shapes").alias("s"))
    start = F.col("pos") - F.col("s.off")
    met = met.filter(start >= F.col("low")).select("row", start.alias("low"), (start + F.col("s.n")).alias("high"), F.slice("near", start - F.col("low") + 1, F.col("s.n")).alias("window"))
    return met.join(broadcast_if_small(wanted.select("window")), "window").select("row", "low", "high", "window")


def proximity_matches(index: DataFrame, pairs: DataFrame, within: int = WINDOW - 1) -> DataFrame:
    """(row, doc_id, a, b, pos, gap): places of a with b at most ``within`` words away, gap < 0 if before; nearest first, the earlier of ties.

    The index has to hold every a and b of ``pairs`` (a, b). Postings meet by row and stretch of ``within`` + 1 words.
    """
    pairs, stretch = cut_lineage(pairs.select("a", "b").distinct()), within + 1
    own = F.floor(F.col("pos") / stretch)
    left = index.join(broadcast_if_small(pairs), index.term == pairs.a).select("row", "a", "b", "pos", F.explode(F.array(own - 1, own, own + 1)).alias("stretch"))
    right = index.filter("term <> ''").select("row", F.col("term").alias("b"), F.col("pos").alias("at"), own.alias("stretch"))
    gap = F.col("at") - F.col("pos")
    met = left.join(right, ["row", "b", "stretch"]).filter((gap != 0) & (F.abs(gap) <= within))
    best = met.groupBy("row", "a", "b", "pos").agg(F.min(F.struct(F.abs(gap).alias("far"), gap.alias("gap"))).alias("best"))
    ends = index.filter("term = ''").select("row", "doc_id")
    return best.join(ends, "row").select("row", "doc_id", "a", "b", "pos", F.col("best.gap").alias("gap"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(row, doc_id, n_words, n_hit, items) for every row of ``docs``, repeated rows and null ids included.

    Null and empty texts have no words and no hits; without items with words no row has hits. A word is hit if it lies
    in any occurrence of a test window. An empty table of documents gives an empty result; further columns don't matter.
    """
    held = cut_lineage(test_windows(items, size=size))
    rows = numbered(docs, id_col, text_col)
    terms = cut_lineage(held.select(F.explode("window").alias("term")).distinct())
    wanted = cut_lineage(lookups(held, cut_lineage(term_counts(rows, terms))))
    rare = wanted.select("term", F.lit(True).alias("anchor")).unionByName(wanted.select(F.col("term2").alias("term"), F.lit(False).alias("anchor")))
    index = build_index(rows, rare.groupBy("term").agg(F.bool_or("anchor").alias("anchor")), size - 1)
    matches = cut_lineage(phrase_matches(index, wanted))
    spans = matches.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("spans"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["high"] - F.greatest(s["low"], a["end"]))).cast("long").alias("n"), F.greatest(a["end"], s["high"]).alias("end"))
    hit = spans.select("row", F.aggregate("spans", start, step, lambda a: a["n"]).alias("n_hit"))
    of = matches.select("row", "window").distinct().join(broadcast_if_small(held), "window").select("row", F.explode("items").alias("item")).distinct()
    of = of.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    lengths = index.filter("term = ''").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    out = lengths.join(hit, "row", "left").join(of, "row", "left")
    return out.select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts, and texts of separators alone, have no words and no hits; items without words, or with a null id, count
    for nothing; rows that repeat each other come out as often as they came in, null ids too; an item that several windows
    name counts once. Without documents there are no rows, without items no hits. Further columns are not read.
    """
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item, array_to_string(w[i : i + 9], ' ') AS k, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win), runs AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT r, i, runs.n, item FROM runs JOIN win ON runs.k = win.k AND runs.n = win.n
), cov AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r
), its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""

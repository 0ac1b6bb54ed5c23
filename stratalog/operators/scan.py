"""Matching lines and printable runs against a rule pack."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..functions.rules import Pack, compiled, listed_hits
from ..lineage import cut_lineage

LINE_BLOCK = 8192
_KEYS = ["rule_id", "severity", "product", "issue_category", "component", "kb_candidate_ids", "matched_text"]
#: Columns of hits before they are numbered: what orders them, then what they say.
HIT_ORDER = ["artifact_ord", "chunk_no", "kind_ord", "pos", "rule_ord"]
CONTEXT = ("context_before", "context_after")
HITS = [*HIT_ORDER, "artifact_path", "line_number", "byte_offset", *_KEYS, "raw_line", "context_before", "context_after", "match_type", "scanner", "encoding"]


def _exploded(df: DataFrame, pack: Pack, rules: bool) -> DataFrame:
    """The rows whose raw_line has hits, once for each hit; the cheap test comes first.

    Outer generators here and below: from others Spark infers a filter that computes the generated array once more.
    """
    may, hits = compiled("raw_line", pack, rules)
    return df.filter(may).withColumn("__h", F.explode_outer(hits)).filter("__h is not null")


def _shape(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"__h.{c}") if c in (*_KEYS, "rule_ord") else F.col(c) for c in HITS])


def line_arrays(artifacts: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """Text artifacts (artifact_ord, artifact_path, content, utf16_text) with encoding, ok, text and lines.

    ``lines`` is null where strict decoding fails. ``told`` (artifact_path, encoding) are artifacts whose encoding, utf-8, cp1252 or latin-1, is known.
    """
    x = artifacts.withColumn("__e", T.encoding_of(F.col("content"), F.col("utf16_text").isNotNull()))
    if told is not None:
        x = x.join(told.select("artifact_path", F.col("encoding").alias("__told")), "artifact_path", "left")
        x = x.withColumn("__e", F.when(F.col("__told").isNotNull(), F.struct(F.col("__told").alias("encoding"), T.fits(F.col("content"), F.col("__told")).alias("ok"))).otherwise(F.col("__e"))).drop("__told")
    x = x.select("*", "__e.encoding", "__e.ok").drop("__e")
    x = x.withColumn("text", F.when(F.col("ok"), T.decoded(F.col("content"), F.col("encoding"), F.col("utf16_text"))))
    return x.withColumn("lines", T.split_lines(F.col("text")))


def text_hits(arrays: DataFrame, pack: Pack) -> DataFrame:
    """Hits of artifacts whose lines come as arrays: context is cut from the array, so nothing is shuffled."""
    x = arrays.select("artifact_ord", "artifact_path", "encoding", "lines", F.posexplode_outer("lines").alias("i", "raw_line")).filter("i is not null")
    x = _exploded(x, pack, True)
    x = x.withColumn("context_before", T.lines_before(F.col("lines"), F.col("i"))).withColumn("context_after", T.lines_after(F.col("lines"), F.col("i")))
    return _shape(_as_text(x.withColumn("line_number", (F.col("i") + 1).cast("long"))))


def _as_text(x: DataFrame) -> DataFrame:
    return x.withColumns({
        "chunk_no": F.lit(0).cast("long"), "kind_ord": F.lit(0), "pos": F.col("line_number"), "byte_offset": F.lit(None).cast("long"),
        "match_type": F.lit("text-line"), "scanner": F.lit("text-line-scanner"),
    })


def _in_blocks(lines: DataFrame, block: int, n: int) -> DataFrame:
    """``lines`` dealt to blocks of line numbers (__block; its own is __own), each with the ``n`` lines on either side."""
    own = F.floor((F.col("line_number") - 1) / block)
    edges = F.array_distinct(F.array(own, F.floor((F.col("line_number") - 1 - n) / block), F.floor((F.col("line_number") - 1 + n) / block)))
    return lines.withColumn("__own", own).withColumn("__block", F.explode_outer(edges))


def _around(dealt: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``dealt`` with context_before and context_after; every line once, in its own block."""
    w = Window.partitionBy(*keys, "__block").orderBy("line_number")
    line = F.coalesce("raw_line", F.lit(""))
    before, after = [F.lag(line, k).over(w) for k in range(n, 0, -1)], [F.lead(line, k).over(w) for k in range(1, n + 1)]
    out = dealt.withColumns({"context_before": F.concat_ws("\n", *before), "context_after": F.concat_ws("\n", *after)})
    return out.filter(F.col("__block") == F.col("__own")).drop("__own", "__block")


def with_context(lines: DataFrame, block: int = LINE_BLOCK, n: int = T.CONTEXT) -> DataFrame:
    """Lines (artifact_path, line_number, raw_line, ...) that come as rows, with context_before and context_after.

    Windows run over blocks of line numbers, each with the ``n`` lines on either side, so one huge log is many small
    groups. A null line counts as empty.
    """
    dealt = _in_blocks(lines.withColumn("raw_line", F.coalesce("raw_line", F.lit(""))), block, n)
    return _around(dealt, ["artifact_path"], n)


def _few(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df``, stored, with a broadcast hint if it has at most ``most`` rows; beyond that both sides of a join are shuffled."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def row_hits(lines: DataFrame, pack: Pack, encoding: str | None = "utf-8") -> DataFrame:
    """Hits of lines that come as rows (artifact_ord, artifact_path, line_number, raw_line), without context: for logs too large for one row.

    Lines are matched where they are; nothing is shuffled and nothing runs before the result is asked for. Lines of one path
    have different numbers. Without ``encoding`` lines have a column of that name. ``add_context`` gives the lines around.
    """
    x = _as_text(_exploded(lines.withColumn("encoding", F.lit(encoding)) if encoding else lines, pack, True))
    return x.select(*[F.col(f"__h.{c}") if c in (*_KEYS, "rule_ord") else F.col(c) for c in HITS if c not in CONTEXT])


def add_context(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """HITS of the hits of ``row_hits``, with context from the ``lines`` they were found in. A null line counts as empty.

    Hits are stored; the lines next to a line with hits are then looked for in one more pass, and only they go through a
    shuffle, as long as they are few enough to be told to all tasks.
    """
    hits = cut_lineage(hits)
    steps = F.array(*[F.lit(k) for k in range(-T.CONTEXT, T.CONTEXT + 1) if k])
    wanted = hits.select("artifact_path", F.col("line_number").alias("at")).distinct().withColumn("step", F.explode(steps))
    wanted = _few(wanted.select("artifact_path", "at", (F.col("at") + F.col("step")).alias("line_number")))
    near = lines.select("artifact_path", "line_number", F.coalesce("raw_line", F.lit("")).alias("line")).join(wanted, ["artifact_path", "line_number"])
    said = F.sort_array(F.collect_list(F.struct("line_number", "line")))
    near = near.groupBy("artifact_path", "at").agg(said.alias("near"))  # at most the lines of the context
    joined = lambda on: F.array_join(F.transform(F.filter("near", on), lambda x: x["line"]), "\n")
    context = near.select("artifact_path", F.col("at").alias("line_number"), joined(lambda x: x["line_number"] < F.col("at")).alias("context_before"), joined(lambda x: x["line_number"] > F.col("at")).alias("context_after"))
    return hits.join(context, ["artifact_path", "line_number"], "left").na.fill("", list(CONTEXT)).select(*HITS)


def fragments(artifacts: DataFrame, exact_chunks: bool = True) -> DataFrame:
    """Printable runs of at least four characters of binary artifacts: (artifact_ord, artifact_path, kind_ord, byte_offset, raw_line).

    kind_ord is 0 for ASCII, 1 and 2 for UTF-16LE-like runs at even and odd offsets.
    """
    x = artifacts.select("artifact_ord", "artifact_path", T.latin1(F.col("content")).alias("__l"))
    parts = []
    for name, pattern, width in (("a", T.ASCII_RUN, 1), ("w", T.WIDE_RUN, 2)):
        y = x.select("artifact_ord", "artifact_path", F.regexp_extract_all("__l", F.lit(pattern), F.lit(0)).alias("m"), F.split("__l", pattern, -1).alias("g"))
        y = y.filter(F.size("m") > 0).withColumn("p", F.arrays_zip("m", T.places(F.col("m"), F.col("g")).alias("at")))
        y = y.select("artifact_ord", "artifact_path", F.explode_outer("p").alias("p")).filter("p is not null").select("artifact_ord", "artifact_path", F.col("p.m").alias("run"), F.col("p.at").alias("byte_offset"))
        y = y.withColumn("n", T.cut_run(F.col("byte_offset"), F.length("run"), width, exact_chunks)).filter(F.col("n") >= T.LEAST_RUN)
        raw = F.substring(F.translate("run", "\x00", "") if width == 2 else F.col("run"), F.lit(1), F.col("n").cast("int"))
        parts.append(y.select("artifact_ord", "artifact_path", (F.lit(0) if width == 1 else 1 + F.col("byte_offset") % 2).cast("int").alias("kind_ord"), "byte_offset", raw.alias("raw_line")))
    return parts[0].unionByName(parts[1])


def binary_hits(runs: DataFrame, pack: Pack) -> DataFrame:
    """Hits of printable runs: terms only, rules are for lines."""
    x = _exploded(runs, pack, False)
    x = x.withColumns({
        "chunk_no": F.floor(F.col("byte_offset") / T.CHUNK), "pos": F.col("byte_offset"), "line_number": F.lit(None).cast("long"), "context_before": F.lit(""), "context_after": F.lit(""),
        "match_type": F.when(F.col("kind_ord") == 0, "ascii-string").otherwise("utf-16le-string"), "scanner": F.lit("binary-string-scanner"), "encoding": F.lit("binary"),
    })
    return _shape(x)


def _starts(stored: DataFrame, n: Column) -> Column:
    """For rows of ``stored``, with ``__at`` by monotonically_increasing_id: the sum of ``n`` over all parts before their own."""
    counts = {r["part"]: r["n"] for r in stored.select(F.spark_partition_id().alias("part"), n.alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(k, 0)
    return F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.shiftright("__at", 33).cast("int")) if before else F.lit(0).cast("long")


def _with_numbers(rows: DataFrame, start: Column, prefix: str, width: int) -> DataFrame:
    """``rows``, in order in each part, with hit_no and hit_id: their place in their part beyond ``start``."""
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    x = rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("hit_no", start + place + 1).drop("__at")
    no = F.col("hit_no").cast("string")
    return x.withColumn("hit_id", F.concat(F.lit(prefix), F.when(F.length(no) >= width, no).otherwise(F.lpad(no, width, "0"))))


def numbered(hits: DataFrame, prefix: str = "H", width: int = 6) -> DataFrame:
    """Hits in their total order with ``hit_no`` and hit_id.

    Rows are dealt by ranges of the order, stored and counted by partition; each partition then numbers its own rows from the
    sum of those before it, so no task sees all rows.
    """
    hits = cut_lineage(hits)  # finding the ranges reads them once more
    parted = cut_lineage(hits.repartitionByRange(*HIT_ORDER).sortWithinPartitions(*HIT_ORDER))
    return _with_numbers(parted, _starts(parted, F.lit(1)), prefix, width)


def hits_in_order(lines: DataFrame, pack: Pack, block: int = LINE_BLOCK, prefix: str = "H", width: int = 6) -> DataFrame:
    """The same as ``numbered(add_context(row_hits(lines, pack), lines))``, with one shuffle of the lines and none of the hits.

    Lines (artifact_ord, artifact_path, line_number, raw_line) are dealt by ranges of their order, in blocks with the lines
    next to them, and matched there. A row for each line with hits is stored, in order, with what its rules are and matched;
    the numbers of hits by part then tell every hit its own. No task sees all rows or all of a long log. Of one path all
    lines come, numbered without gaps, and an artifact_ord has one path.
    """
    keys = ["artifact_ord", "artifact_path"]
    dealt = _in_blocks(lines.select(*keys, "line_number", "raw_line"), block, T.CONTEXT).repartitionByRange("artifact_ord", "__block")
    may, hits = compiled("raw_line", pack, True)
    short = F.transform(hits, lambda h: F.struct(h["rule_ord"].alias("rule_ord"), h["matched_text"].alias("matched_text")))
    stored = cut_lineage(_around(dealt, keys, T.CONTEXT).filter(may).withColumn("__found", short))
    told = listed_hits(pack)
    x = stored.select(*keys, "line_number", "raw_line", *CONTEXT, F.lit("utf-8").alias("encoding"), F.explode("__found").alias("__f"))
    x = _with_numbers(x, _starts(stored, F.size("__found")), prefix, width).withColumn("__h", F.get(told, F.col("__f.rule_ord")))
    own = {"rule_ord": F.col("__f.rule_ord"), "matched_text": F.col("__f.matched_text")}
    return _as_text(x).select(*[own[c].alias(c) if c in own else F.col(f"__h.{c}") if c in _KEYS else F.col(c) for c in HITS], "hit_no", "hit_id")


def pattern_flags(text: Column, specs=fixed.NEGATIVE_SEARCHES) -> Column:
    """A bit for each negative search whose words, one or two, occur together in one line of the text; for up to 31 searches.

    ``index.negative_specs`` takes any number of searches and words.
    """
    if len(specs) > 31 or any(len(needles) > 2 for _, _, needles, _ in specs):
        raise ValueError("more than 31 searches, or more than two words in one: use index.negative_specs")

    def bits(low: Column) -> Column:
        out = F.lit(0)
        for k, (_, _, needles, _) in enumerate(specs):
            if len(needles) == 1:
                out = out + F.when(F.contains(low, F.lit(needles[0])), 1 << k).otherwise(0)
            elif needles:
                a, b = (re.sub(r"(\W)", r"\\\1", n) for n in needles)
                out = out + F.when(low.rlike(rf"{a}[^\r\n]*{b}|{b}[^\r\n]*{a}"), 1 << k).otherwise(0)
        return out

    return F.coalesce(F.get(F.transform(F.array(F.lower(text)), bits), F.lit(0)), F.lit(0))

"""Case numbers in paths and report texts."""

from __future__ import annotations

import os
import re
from collections import Counter
from importlib import util
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..sources.decoders import pdf_text

UNKNOWN = "UNKNOWN"


def in_path(path: Column) -> Column:
    """All case numbers of a path, in order."""
    return F.regexp_extract_all(path, F.lit(fixed.CASE_IN_PATH), F.lit(1))


def in_text(text: Column) -> Column:
    """All case numbers that a text calls so, pattern by pattern; a mention counts for every pattern that fits it."""
    return F.concat(*[F.regexp_extract_all(text, F.lit("(?iU)" + p), F.lit(1)) for p in fixed.CASE_IN_TEXT])


def most_common(mentions: DataFrame) -> DataFrame:
    """(case_number, ambiguous) of mentions (ord, case_number): the most frequent; of several the first mentioned, ambiguous."""
    by = mentions.groupBy("case_number").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    top = by.agg(F.max("n").alias("top"), F.min(F.struct("first", "case_number")).alias("f"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "case_number"))).alias("all"))
    tied = F.size(F.filter("all", lambda x: x["m"] == -F.col("top"))) > 1
    return top.filter("top is not null").select(F.when(tied, F.col("f.case_number")).otherwise(F.col("all")[0]["case_number"]).alias("case_number"), tied.alias("ambiguous"))


def detect(inputs: list[str]) -> tuple[str, list[str]]:
    """(case number, warnings) from the given paths, the names below given folders, sorted, and the texts of standard reports."""
    found: list[str] = []
    below = {}
    for given in inputs:
        path = Path(given)
        found += re.findall(fixed.CASE_IN_PATH, str(path))
        below[given] = sorted(os.path.join(d, n) for d, subs, names in os.walk(path) for n in [*subs, *names]) if path.is_dir() else []
        for child in below[given]:
            found += re.findall(fixed.CASE_IN_PATH, child)
    module = next((m for m in ("pypdf", "PyPDF2") if util.find_spec(m)), None)
    for given in inputs:
        files = [given] if Path(given).is_file() else [c for c in below[given] if c.endswith(".pdf") and os.path.isfile(c)]
        for f in files:
            if "standardreport" not in os.path.basename(f).lower() or not module:
                continue
            try:
                text = pdf_text(module, Path(f).read_bytes())
            except Exception:  # PDF libraries raise anything on broken files; such a report says nothing
                continue
            for p in fixed.CASE_IN_TEXT:
                found += re.findall(p, text, re.I)
    if not found:
        return UNKNOWN, []
    counts = Counter(found)
    top = [c for c, n in counts.items() if n == max(counts.values())]
    if len(top) == 1:
        return top[0], []
    return found[0], [f"Multiple possible case numbers found; selected {found[0]}."]

"""What became of every artifact: classification, scan statistics and limitations in one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import decoded, encoding_of, line_count
from ..schema import COVERAGE_COLUMNS
from .classify import classify, meaning
from .scan import fragments, pattern_flags


def classified(artifacts: DataFrame) -> DataFrame:
    """Artifacts with ``cls``, null for policy rows."""
    number = classify(*[F.col(c) for c in ("artifact_path", "content", "is_zip", "is_tar", "is_json", "marker_text")])
    numbered = artifacts.withColumn("__outcome", F.when(F.col("policy").isNull(), number))
    return numbered.withColumn("cls", meaning(F.col("__outcome"))).drop("__outcome")


def text_part(found: DataFrame) -> DataFrame:
    return found.filter(F.col("cls.family").isin(*fixed.TEXT_FAMILIES))


def binary_part(found: DataFrame) -> DataFrame:
    """Binary families, and formats whose decoder falls back to strings; unreadable files have no content to scan."""
    return found.filter((F.col("cls.family").isin(*fixed.BINARY_FAMILIES) | F.coalesce(F.col("decoder.fallback"), F.lit(False))) & F.col("content").isNotNull())


def coverage(found: DataFrame, exact_chunks: bool = True) -> DataFrame:
    """(artifact_ord, flags, COVERAGE_COLUMNS): one row per artifact; ``flags`` has a bit per negative search found in the text.

    One pass decides everything but the number of printable runs, which is counted over the binary artifacts alone and
    joined as a number.
    """
    cls, dec, pol = (lambda n: F.col(f"cls.{n}")), (lambda n: F.col(f"decoder.{n}")), (lambda n: F.col(f"policy.{n}"))
    family = cls("family")
    fallback = F.coalesce(dec("fallback"), F.lit(False))
    has = F.col("content").isNotNull()
    kind = (
        F.when(F.col("policy").isNotNull(), "policy").when(family.isin(*fixed.TEXT_FAMILIES), "text").when((family.isin(*fixed.BINARY_FAMILIES) | fallback) & has, "binary")
        .when(family.isin(*fixed.BINARY_FAMILIES), "unread").when(F.col("decoder").isNotNull(), "decoded").otherwise("other")
    )
    x = found.withColumn("kind", kind).withColumn("utf16", F.col("utf16_text").isNotNull())
    x = x.withColumn("e", F.when(F.col("kind") == "text", encoding_of(F.col("content"), F.col("utf16"))))
    x = x.withColumn("text", F.when(F.col("e.ok"), decoded(F.col("content"), F.col("e.encoding"), F.col("utf16_text"))))
    x = x.withColumns({"n_lines": line_count(F.col("text")), "flags": pattern_flags(F.col("text")), "size": F.coalesce("size", F.octet_length("content").cast("long"))}).drop("content", "text", "utf16_text", "marker_text")
    counts = fragments(binary_part(found), exact_chunks).groupBy("artifact_ord").agg(F.count("*").alias("runs"))
    x = x.join(counts, "artifact_ord", "left")
    ok, runs, told = F.coalesce(F.col("e.ok"), F.lit(False)), F.coalesce("runs", F.lit(0)), F.col("decoder").isNotNull()
    status, limited = dec("status"), F.size("archive_limitations") > 0

    def by(policy, text, binary, unread, decoded_, other):
        """The value for each kind."""
        out = F.lit(None)
        for name, v in (("policy", policy), ("text", text), ("binary", binary), ("unread", unread), ("decoded", decoded_), ("other", other)):
            out = F.when(F.col("kind") == name, v if not isinstance(v, str) else F.lit(v)).otherwise(out)
        return out

    no, zero = F.lit(False), F.lit(0)
    tool_mode = F.when(status.isin("specialized-tool-unavailable", "decode-failed"), "specialized-tool-unavailable").otherwise("metadata-only")
    other_limits = F.concat_ws(" ", F.when(cls("limitations") != "", cls("limitations")), F.when(limited, F.array_join("archive_limitations", " ")))
    values = {
        "artifact_family": by(pol("family"), family, family, family, family, family),
        "identified_by": by(pol("identified_by"), *[cls("identified_by")] * 5),
        "review_mode": by(pol("review_mode"), F.when(ok, "stream-scanned").otherwise("unreadable"), "binary-string-scanned", "unreadable", tool_mode, cls("review_mode")),
        "line_numbers_supported": by(no, *[cls("line_numbers")] * 5),
        "lines_or_rows_scanned": by(zero, F.when(ok, F.col("n_lines")).otherwise(0), runs, zero, zero, zero).cast("long"),
        "bytes_scanned": F.when(F.col("kind") == "policy", 0).otherwise(F.coalesce("size", F.lit(0))).cast("long"),
        "decoded_successfully": by(no, ok, F.lit(True), no, status.isin("decoded", "decoded-with-limitation"), no),
        "decoder_used": by("none", "text-line-scanner", F.when(told, dec("used")).otherwise("binary-string-scanner"), "binary-string-scanner", dec("used"), "none"),
        "decoder_status": by(pol("status"), F.when(ok, "scanned").otherwise("decode-failed"), F.when(told, status).otherwise("scanned"), "unreadable", status, F.when(limited, "extracted-with-limitations").otherwise(cls("status"))),
        "encoding": by("", F.col("e.encoding"), "binary", "binary", "", ""),
        "root_cause_value": F.lit(""),
        "related_rule_ids": F.lit(""),
        "limitations": by(
            pol("limitations"), F.when(ok, "").otherwise(F.coalesce("utf16_error", F.lit(""))), F.when(told, dec("limitations")).when(runs == 0, fixed.LIMIT_NO_STRINGS).otherwise(""), "Binary scan failed.", dec("limitations"), other_limits
        ),
    }
    kept = [F.col(c) for c in COVERAGE_COLUMNS if c not in values]
    return x.select("artifact_ord", F.when(ok, F.col("flags")).otherwise(0).cast("int").alias("flags"), *kept, *[v.alias(n) for n, v in values.items()]).select("artifact_ord", "flags", *COVERAGE_COLUMNS)

"""Artifact families by content first, then by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import latin1

_FIELDS = ("family", "identified_by", "review_mode", "line_numbers", "status", "limitations")
_TOOL = "specialized-tool-unavailable"
_OUTCOMES: list[tuple] = []


def _add(family: str, by: str, mode: str = "stream-scanned", lines: bool | None = None, status: str = "pending-scan", limits: str = "") -> int:
    """The number of an outcome; expressions choose among numbers, and one constant array holds what they mean."""
    _OUTCOMES.append((family, by, mode, mode == "stream-scanned" if lines is None else lines, status, limits))
    return len(_OUTCOMES) - 1


_ZIP, _TAR = (_add(f, f"content:{f}file", "metadata-only", status="archive-detected") for f in ("zip", "tar"))
_UNREADABLE = _add("unknown", "probe:unreadable", "unreadable", status="unreadable")
_MARKED = {f: _add(f, "content:app-control-marker") for f in fixed.MARKERS}
_JSON, _XML, _HTML = (_add(f, f"content:{f}") for f in ("json", "xml", "html"))
_NAMED_ZIP, _NAMED_TAR = (_add(f, by, "metadata-only", status="invalid-or-unreadable-archive") for f, by in (("zip", "extension:.zip"), ("tar", "extension:tar")))
_REPORT_PDF = _add("standard_report_pdf", "extension:.pdf:name:standard-report", _TOOL, status=_TOOL, limits=fixed.LIMIT_REPORT_PDF)
_BY_SUFFIX = {
    **{s: _add(f, f"extension:{s}", _TOOL, status=_TOOL, limits=fixed.LIMIT_TOOL_ARCHIVE) for s, f in fixed.TOOL_ARCHIVE_SUFFIXES.items()},
    **{s: _add(f, f"extension:{s}", _TOOL, status=_TOOL, limits=fixed.LIMIT_DECODER) for s, f in fixed.DECODER_SUFFIXES.items()},
    **{s: _add(f, f"extension:{s}") for s, f in fixed.TEXT_SUFFIXES.items()},
    **{s: _add("image_metadata_only", f"extension:{s}", "metadata-only", status="metadata-only") for s in fixed.IMAGE_SUFFIXES},
}
_TEXT, _BINARY = _add("text_log", "content:text"), _add("opaque_binary", "fallback:binary", "binary-string-scanned")


def meaning(number: Column) -> Column:
    """(family, identified_by, review_mode, line_numbers, status, limitations) of an outcome."""
    return F.get(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, _FIELDS)]) for o in _OUTCOMES]), number)


def marker_family(text: Column, markers: dict = fixed.MARKERS, strong=fixed.STRONG_MARKERS) -> Column:
    """The family with most of its markers in the text, the first of ties; a single marker counts only along with a strong one of any family."""
    families = F.array(*[F.struct(F.lit(f).alias("family"), F.array(*[F.lit(m.lower()) for m in ms]).alias("markers")) for f, ms in markers.items()])
    listed = F.array(*[F.lit(m.lower()) for m in strong])

    def best(low: Column) -> Column:
        counts = F.transform(families, lambda f, i: F.struct(F.size(F.filter(f["markers"], lambda m: F.contains(low, m))).alias("n"), (-i).alias("order"), f["family"].alias("family")))
        accepted = lambda c: (c["n"] >= 2) | (c["n"] == 1) & F.exists(listed, lambda m: F.contains(low, m))
        return F.get(F.transform(F.filter(F.array(F.array_max(counts)), accepted), lambda c: c["family"]), F.lit(0))

    return F.get(F.transform(F.array(F.lower(text)), best), F.lit(0))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def suffix_of(path: Column) -> Column:
    """The lower-cased last suffix with its dot; names that only begin or end with a dot have none."""
    return F.lower(F.regexp_extract(file_name(path), r"\A\.*[^.](?s:.*)(\.[^.]+)\z", 1))


def _suffix_number(path: Column) -> Column:
    name, suffix = F.lower(file_name(path)), suffix_of(path)
    tar = name.rlike("(?:" + "|".join(x.replace(".", r"\.") for x in fixed.TAR_SUFFIXES) + r")\z")
    report = (suffix == ".pdf") & name.contains("standard") & name.contains("report")
    numbers = F.create_map(*[F.lit(x) for pair in _BY_SUFFIX.items() for x in pair])
    return F.when(suffix == ".zip", _NAMED_ZIP).when(tar, _NAMED_TAR).when(report, _REPORT_PDF).otherwise(F.try_element_at(numbers, suffix))


def by_suffix(path: Column) -> Column:
    """Classification by name, or null."""
    return meaning(_suffix_number(path))


def classify(path: Column, content: Column, is_zip: Column, is_tar: Column, is_json: Column, marker_text: Column, probe: int = 4096) -> Column:
    """The number of an artifact's outcome, to be kept in a column of its own before ``meaning`` is taken; null content is unreadable.

    ``marker_text`` is the decoded probe, or null where the probe holds NUL bytes without a UTF-16 mark.
    """
    sample = F.substring(content, 1, probe)
    stripped = F.regexp_replace(latin1(sample), r"\A[\x20\t\n\r\x0b\f]+", "")
    marked = F.try_element_at(F.create_map(*[F.lit(x) for pair in _MARKED.items() for x in pair]), marker_family(F.coalesce(marker_text, F.lit(""))))
    plain = F.is_valid_utf8(sample.cast("string")) & ~latin1(sample).contains("\x00")
    return F.coalesce(
        F.when(is_zip, _ZIP).when(is_tar, _TAR).when(content.isNull(), _UNREADABLE),
        marked,
        F.when(is_json, _JSON).when(stripped.rlike(r"\A<(?:\?xml|Event)"), _XML).when(F.lower(F.substring(stripped, 1, 512)).rlike("<html|<!doctype html"), _HTML),
        _suffix_number(path),
        F.when(plain, _TEXT).otherwise(_BINARY),
    )

"""Decoding, splitting into lines and finding printable runs, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What bytes 80 to 9F mean in cp1252, but for the five that have no meaning.
_C1 = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
CHUNK, LEAST_RUN, CONTEXT = 1 << 20, 4, 2
_SUMS = 64


def latin1(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def starts_with_bytes(content: Column, prefix: str) -> Column:
    """Whether the bytes begin with ``prefix``, given in hexadecimal."""
    return F.coalesce(F.hex(F.substring(content, 1, len(prefix) // 2)) == prefix.upper(), F.lit(False))


def _odd(content: Column) -> Column:
    return latin1(content).rlike(r"[\x81\x8d\x8f\x90\x9d]")


def fits(content: Column, encoding: Column) -> Column:
    """Whether bytes decode strictly in utf-8, cp1252 or latin-1."""
    return F.when(encoding == "utf-8", F.is_valid_utf8(content.cast("string"))).when(encoding == "cp1252", ~_odd(content)).otherwise(F.lit(True))


def encoding_of(content: Column, utf16_ok: Column) -> Column:
    """(encoding, ok): by byte order mark, which decides alone, else the first of utf-8, cp1252 and latin-1 that decodes strictly."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    odd = _odd(content)
    by = F.struct
    lit = lambda name, ok: by(F.lit(name).alias("encoding"), ok.alias("ok"))
    return (
        F.when(starts_with_bytes(content, "efbbbf"), lit("utf-8-sig", utf8))
        .when(starts_with_bytes(content, "fffe") | starts_with_bytes(content, "feff"), lit("utf-16", utf16_ok))
        .when(utf8, lit("utf-8", F.lit(True)))
        .when(odd, lit("latin-1", F.lit(True)))
        .otherwise(lit("cp1252", F.lit(True)))
    )


def decoded(content: Column, encoding: Column, utf16_text: Column) -> Column:
    """The text of bytes known to be valid in ``encoding``."""
    chars = "".join(map(chr, _C1)), "".join(_C1.values())
    return (
        F.when(encoding == "utf-16", utf16_text)
        .when(encoding == "utf-8-sig", F.substring(content, 4, 1 << 30).cast("string"))
        .when(encoding == "utf-8", content.cast("string"))
        .when(encoding == "cp1252", F.translate(latin1(content), *chars))
        .otherwise(latin1(content))
    )


def split_lines(text: Column) -> Column:
    r"""Lines ended by \r\n, \r or \n, without their ends; what follows the last end is a line unless it is empty."""
    parts = F.split(text, "\r\n|\r|\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    """How many lines ``split_lines`` gives, without making them."""
    ends = F.regexp_count(text, F.lit("\r\n|\r|\n"))
    return F.when(text == "", 0).otherwise(ends + F.when(text.rlike(r"[\r\n]\z"), 0).otherwise(1))


def lines_before(lines: Column, pos: Column, n: int = CONTEXT) -> Column:
    """Up to ``n`` lines before the 0-based ``pos``, joined by line feeds."""
    return F.array_join(F.slice(lines, F.greatest(pos - n + 1, F.lit(1)), F.least(pos, F.lit(n))), "\n")


def lines_after(lines: Column, pos: Column, n: int = CONTEXT) -> Column:
    return F.array_join(F.slice(lines, pos + 2, F.lit(n)), "\n")


def places(matches: Column, gaps: Column) -> Column:
    """Offsets of matches, given the gaps around them: sums of all lengths before, taken in chunks so that the work stays in proportion."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    sizes = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: (F.length(m) + F.length(g)).cast("long"))
    box = F.transform(F.array(F.struct(matches.alias("m"), gaps.alias("g"), sizes.alias("n"))), lambda b: F.struct(b["m"].alias("m"), b["g"].alias("g"), b["n"].alias("n"), F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(b["n"]) - 1) / _SUMS).cast("int"), F.lit(0))), lambda c: total(F.slice(b["n"], c * _SUMS + 1, F.lit(_SUMS)))).alias("c")))
    box = F.transform(box, lambda b: F.struct(b["m"].alias("m"), b["g"].alias("g"), b["n"].alias("n"), F.transform(b["c"], lambda _, i: total(F.slice(b["c"], F.lit(1), i))).alias("c")))
    return F.flatten(F.transform(box, lambda b: F.transform(b["m"], lambda m, i: F.get(b["c"], F.floor(i / _SUMS).cast("int")) + total(F.slice(b["n"], F.floor(i / _SUMS).cast("int") * _SUMS + 1, i % _SUMS)) + F.length(F.get(b["g"], i)))))


ASCII_RUN = r"[\x20-\x7e]{4,}+"
WIDE_RUN = r"(?:[\x20-\x7e]\x00){4,}+"


def cut_run(start: Column, length: Column, width: int, exact_chunks: bool = True) -> Column:
    """Characters of a run that are reported: scans go by chunks of 1 MiB, and what lies beyond the chunk in which a run starts is not seen."""
    if not exact_chunks:
        return F.floor(length / width)
    room = (F.floor(start / CHUNK) + 1) * CHUNK - start
    return F.floor(F.least(length, room) / width)

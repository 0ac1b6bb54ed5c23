"""Rule packs: loading, and compiling to expressions with literal patterns."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed


@dataclass(frozen=True)
class Rule:
    rule_id: str
    patterns: tuple[str, ...]
    severity: str = "Info"
    product: str = fixed.GENERIC_PRODUCT
    issue_category: str = fixed.GENERIC_CATEGORY
    component: str = fixed.GENERIC_COMPONENT
    kb_candidates: tuple[str, ...] = ()
    required_evidence: tuple[str, ...] = ()
    missing_evidence: str = ""
    false_positive_cautions: str = ""


@dataclass(frozen=True)
class Pack:
    rules: tuple[Rule, ...]
    terms: tuple[str, ...] = tuple(fixed.TERMS)
    kb_titles: dict[str, str] = field(default_factory=dict)


def built_in() -> Pack:
    """The built-in rules, terms and KB titles."""
    rules = [Rule(i, tuple(p), s, fixed.PRODUCT, cat, comp, tuple(kb), tuple(req), miss, fixed.CAUTION) for i, s, cat, comp, kb, req, miss, p in fixed.RULES]
    return Pack(tuple(rules), tuple(fixed.TERMS), dict(fixed.KB_TITLES))


def load_pack(path: str, terms=fixed.TERMS, kb_path: str | None = None) -> Pack:
    """A pack from a JSON file with a list ``rules``; a missing or broken KB file means no titles."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("rules", [])
    text = lambda r, k, d="": str(r.get(k, d))
    rules = [
        Rule(
            text(r, "rule_id"), tuple(r.get("patterns", [])), text(r, "severity", "Info"), text(r, "product", "Unknown"), text(r, "issue_category"), text(r, "component"),
            tuple(map(str, r.get("kb_candidates", []))), tuple(map(str, r.get("required_evidence", []))), text(r, "missing_evidence"), text(r, "false_positive_cautions"),
        )
        for r in found
    ]
    titles = {}
    if kb_path:
        try:
            with open(kb_path, encoding="utf-8") as f:
                titles = {str(x.get("kb_id")): str(x.get("title")) for x in json.load(f).get("candidates", [])}
        except (OSError, json.JSONDecodeError):
            titles = {}
    return Pack(tuple(rules), tuple(terms), titles)


def to_java(pattern: str) -> str:
    """A case-insensitive Python pattern over text in Java's dialect.

    Unicode case and classes, ``.`` stops at line feeds only, and white space takes in U+001C to U+001F. Inside a
    character class ``\\s`` becomes its members without brackets.
    """
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            two = pattern[i : i + 2]
            out.append((r"\s\x1c-\x1f" if inside else r"[\s\x1c-\x1f]") if two == r"\s" else r"\z" if two == r"\Z" else two)
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
            out.append(c)
            i += 1
            for lead in ("^", "]"):
                if pattern[i : i + 1] == lead:
                    out.append("\\]" if lead == "]" else lead)
                    i += 1
            continue
        if inside and c == "[":
            out.append("\\[")
        elif inside and c == "&" and pattern[i : i + 2] == "&&":
            out.append("&\\&")
            i += 1
        else:
            inside = inside and c != "]"
            out.append(c)
        i += 1
    return "(?iUd)" + "".join(out)


_HIT = "struct<rule_ord:int,rule_id:string,severity:string,product:string,issue_category:string,component:string,kb_candidate_ids:string,matched_text:string>"


def _hit(ord_: int, rule: Rule, matched: Column) -> Column:
    labels = ";".join(f"KB candidate {k}" for k in rule.kb_candidates)
    values = [F.lit(ord_), *map(F.lit, (rule.rule_id, rule.severity, rule.product, rule.issue_category, rule.component, labels)), matched]
    return F.struct(*[v.alias(n.split(":")[0]) for v, n in zip(values, _HIT[7:-1].split(","))]).cast(_HIT)


#: Letters that match s or i without case although their lower case is another letter.
_ODD = ("\u017f", "\u0131", "\u0130")


def literal_of(pattern: str, letters: str = r"\x00-\x7f") -> str:
    """The longest text, in lower case and of ``letters`` (a class without brackets), that whatever the pattern matches has to hold; empty if none is plain to see."""
    runs, run, i = [], [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "|":
            return ""
        if c in "([":
            depth, inside = 0, False
            while i < len(pattern):
                d = pattern[i]
                if d == "\\":
                    i += 1
                elif inside:
                    inside = d != "]"
                elif d == "[":
                    inside = True
                elif d == "(":
                    depth += 1
                elif d == ")":
                    depth -= 1
                if depth == 0 and not inside:
                    break
                i += 1
            runs.append("".join(run))
            run = []
        elif c in "?*{":
            runs.append("".join(run[:-1]))
            run = []
            if c == "{":
                i = pattern.index("}", i)
        elif c in "+.^$":
            runs.append("".join(run))
            run = []
        elif c == "\\":
            i += 1
            if pattern[i].isalnum():
                runs.append("".join(run))
                run = []
            else:
                run.append(pattern[i])
        else:
            run.append(c)
        i += 1
    return max((x for r in [*runs, "".join(run)] for x in re.split(f"[^{letters}]+", r.lower())), key=len)


def alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between bars that stand outside groups and classes: one of them matches wherever the pattern does."""
    parts, depth, inside, begin, i = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            i += pattern[i + 1 : i + 2] == "]" or 2 * (pattern[i + 1 : i + 3] == "^]")  # a bracket that comes first is a member
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            parts.append(pattern[begin:i])
            begin = i + 1
        i += 1
    return [*parts, pattern[begin:]]


def _bound(line: Column, f) -> Column:
    """``f`` of (lower-case line, whether it holds odd letters), each computed once for a line."""
    low = F.lower(line)
    odd = F.contains(low, F.lit(_ODD[0]))
    for c in _ODD[1:]:
        odd = odd | F.contains(line, F.lit(c))
    return F.get(F.transform(F.array(F.struct(low.alias("low"), odd.alias("odd"))), lambda x: f(x["low"], x["odd"])), F.lit(0))


def _match(line: Column, low: Column, odd: Column, rule: Rule) -> Column:
    out = F.lit(None).cast("string")
    for p in reversed(rule.patterns):
        java, text = to_java(p), literal_of(p)
        found = line.rlike(java)
        out = F.when((F.contains(low, F.lit(text)) | odd) & found if text else found, F.regexp_extract(line, java, 0)).otherwise(out)
    return out


def rule_match(line: Column, rule: Rule) -> Column:
    """What the first pattern of the rule, in order, that is found in the line matches; else null. A pattern is tried only where its literal text occurs."""
    return _bound(line, lambda low, odd: _match(line, low, odd, rule))


def _as_hit(ord_: int, rule: Rule):
    return lambda matched: _hit(ord_, rule, matched)


def line_hits(line: Column, pack: Pack, rules: bool = True) -> Column:
    """All hits of a line: rules in pack order, one hit each, then terms in order. Empty for null."""

    def listed(low, odd):
        found = []
        for k, r in enumerate(pack.rules if rules else ()):
            hit = F.get(F.transform(F.filter(F.array(_match(line, low, odd, r)), lambda m: m.isNotNull()), _as_hit(k, r)), F.lit(0))
            found.append(hit)
        for k, t in enumerate(pack.terms):
            found.append(F.when(F.contains(low, F.lit(t)), _hit(len(pack.rules) + k, Rule(fixed.GENERIC_RULE, ()), F.lit(t))))
        return F.array_compact(F.array(*found)) if found else F.array().cast(f"array<{_HIT}>")

    return F.coalesce(_bound(line, listed), F.array().cast(f"array<{_HIT}>"))


def listed_hits(pack: Pack) -> Column:
    """What a hit says by its rule_ord, with an empty matched_text: constants, one of each rule and term."""
    known = [*pack.rules, *[Rule(fixed.GENERIC_RULE, ())] * len(pack.terms)]
    return F.array(*[_hit(k, r, F.lit("")) for k, r in enumerate(known)]) if known else F.array().cast(f"array<{_HIT}>")


def may_hit(line: Column, pack: Pack, rules: bool = True) -> Column:
    """A cheap test that every line with hits passes: the terms and the literal texts of the patterns, less those that hold another of them."""
    texts, patterns = {t.lower() for t in pack.terms}, []
    for r in pack.rules if rules else ():
        for p in r.patterns:
            if len(text := literal_of(p)) > 1:
                texts.add(text)
            else:
                patterns.append(f"(?:{to_java(p)[6:]})")
    least = sorted(t for t in texts if not any(o != t and o in t for o in texts))
    listed = F.array(*map(F.lit, least)) if least else F.array().cast("array<string>")
    test = _bound(line, lambda low, odd: F.exists(listed, lambda t: F.contains(low, t)) | (odd if rules else F.lit(False)))
    if patterns:
        test = test | line.rlike("(?iUd)" + "|".join(patterns))
    return F.coalesce(test, F.lit(False))


_KEPT: dict[tuple, tuple] = {}


def compiled(name: str, pack: Pack, rules: bool = True) -> tuple[Column, Column]:
    """(may_hit, line_hits) of the column ``name``; the expressions of the last few packs are kept, for they are large."""
    key = (name, id(pack), rules, id(SparkContext._active_spark_context))
    if key not in _KEPT:
        while len(_KEPT) >= 8:
            _KEPT.pop(next(iter(_KEPT)))
        _KEPT[key] = (may_hit(F.col(name), pack, rules), line_hits(F.col(name), pack, rules), pack)
    return _KEPT[key][:2]


def rules_table(spark: SparkSession, pack: Pack) -> DataFrame:
    """The pack's rules as a table: (rule_ord, rule_id, severity, ..., kb_candidates, required_evidence, patterns)."""
    rows = [(k, r.rule_id, r.severity, r.product, r.issue_category, r.component, list(r.kb_candidates), r.false_positive_cautions, list(r.required_evidence), r.missing_evidence, list(r.patterns)) for k, r in enumerate(pack.rules)]
    return spark.createDataFrame(rows, "rule_ord int, rule_id string, severity string, product string, issue_category string, component string, kb_candidates array<string>, false_positive_cautions string, required_evidence array<string>, missing_evidence string, patterns array<string>")


def dynamic_hits(lines: DataFrame, rules: DataFrame, block: int = 500) -> DataFrame:
    """Lines with the rules of a table whose patterns come as data: every (line, rule) that matches, with the first pattern's match.

    A join on patterns would be a nested loop that compiles every pattern for every line. Rules are a dimension, not a
    table that grows with the logs: they are fetched in blocks and compiled like a pack, one pass over the lines a block.
    """
    found = None
    rows = rules.select("rule_ord", "rule_id", "patterns").orderBy("rule_ord").collect()
    for at in range(0, max(len(rows), 1), block):
        part = rows[at : at + block]
        pack = Pack(tuple(Rule(r.rule_id, tuple(r.patterns)) for r in part), ())
        ords = F.array(*[F.lit(r.rule_ord) for r in part]) if part else F.array().cast("array<int>")
        may, hits = may_hit(F.col("raw_line"), pack), line_hits(F.col("raw_line"), pack)
        x = lines.filter(may).withColumn("__m", F.explode_outer(hits)).filter("__m is not null")
        x = x.select(*lines.columns, F.get(ords, F.col("__m.rule_ord")).alias("rule_ord"), "__m.rule_id", "__m.matched_text")
        found = x if found is None else found.unionByName(x)
    return found

"""Personal data by gradient-boosted candidates; built-in functions only.

Generators propose spans: base kinds by their exact patterns, loose kinds by wider ones (mail addresses with spaces,
letters beyond A-Z or written-out marks; cards with other gaps; phone numbers without a plus; IPv6). Proposals of
different generators may overlap. Every proposal has a label and features, from evidence apart from each other:

* the label comes from a check of its content: octets, the length and first digit of a card issuer, number of digits and
  no date, the whole mail grammar once marks are undone, the groups of an IPv6 address;
* the features are its format and context: generator, digits, groups, separators, words before it (of its own kind or of
  another), what it is glued to, and whether the check digit of a card number holds. None of them is the label's check.

Loose proposals that overlap a passing base span are not judged, since the base span stays. One grouping counts all
others of the corpus by label and feature values; there are at most a few thousand value combinations whatever the
corpus, so these counts go to the driver, where trees of depth two are boosted on one fold and thresholds calibrated on
the other: for a loose kind the least score, of at least even odds, beyond which the held-out labels have the wanted
precision. A kind whose own held-out positives can't tell takes the threshold of itself and its base kind together, and if
that can't tell either, that of all kinds. Cards inside a longer run of digits, whose base match fails, are proposed alone.
The trees return as one expression. Base spans stay; loose spans at or beyond their threshold are added, whether or not
they pass the check: it says what the format is worth on the whole, as for a card number with one wrong digit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .common import table

BASE = ("email", "ip", "card", "phone")
LOOSE = ("mail_like", "card_like", "number_like", "ip6")
KINDS = BASE + LOOSE
#: The base kind of each loose one.
FAMILY = ("email", "card", "phone", "ip")
_LOCAL = "A-Za-z0-9._%+-"
_AT, _DOT = r"(?:\x20?@\x20?|\x20?[\[({]\x20?(?:at|AT|At|@)\x20?[\])}]\x20?)", r"(?:\.|\x20?[\[({]\x20?(?:dot|DOT|Dot|\.)\x20?[\])}]\x20?)"
_NAME = r"[\p{L}0-9_%+-]"
#: The base patterns begin only where a leftmost match can, and don't give back what they have taken; both change no match.
_PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "mail_like": rf"(?<!{_NAME}){_NAME}++(?:{_DOT}{_NAME}++)*+{_AT}[\p{{L}}0-9-]++(?:{_DOT}[\p{{L}}0-9-]++)++",
    "card_like": r"(?<![0-9])[0-9]{4}[\x20._/-]{0,2}[0-9]{4}[\x20._/-]{0,2}[0-9]{4}[\x20._/-]{0,2}[0-9]{1,7}(?![0-9])",
    "number_like": r"(?<![0-9.,])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{2,5}(?:[\x20./-][0-9]{2,5}){1,4}(?![0-9])",
    "ip6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4})?(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}(?![0-9A-Fa-f:])",
}
#: A text without any of these has no proposals.
_ANY = r"[0-9][0-9().\x20/_-]|@|:[0-9A-Fa-f]|[\[({]\x20?(?i:at)\x20?[\])}]"
#: Words that may stand before a proposal, and the generators they speak of.
_CONTEXT = {
    r"(?i)(?:e-?mail|mail|contact|kontakt|correo|courriel|write to|@)\W{0,3}$": ("email", "mail_like"),
    r"(?i)(?:ip|host|server|address|addr|ipv6|from|node)\W{0,3}$": ("ip", "ip6"),
    r"(?i)(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta|cc|number|no)\W{0,3}$": ("card", "card_like"),
    r"(?i)(?:tel|telephone|phone|call|mobile|cell|fax|telefon|t\p{L}l|whatsapp|sms|reach)\W{0,3}$": ("phone", "number_like"),
}
_OCTETS = r"\A0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}\z"
_MAIL = r"\A[\p{L}0-9_%+-]+(?:\.[\p{L}0-9_%+-]+)*@(?:[\p{L}0-9](?:[\p{L}0-9-]*[\p{L}0-9])?\.)+\p{L}{2,}\z"
_IP6 = r"\A(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[0-9A-Fa-f]*:){2,7}[0-9A-Fa-f]+\z)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{1,4})*::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*))\z"
_DATE = r"(?:\A|\D)(?:(?:19|20)[0-9]{2}[./\x20-][0-9]{2}[./\x20-][0-9]{2}|[0-9]{2}[./\x20-][0-9]{2}[./\x20-](?:19|20)[0-9]{2})(?:\D|\z)"
#: Feature -> number of values.
FEATURES = {"generator": len(KINDS), "digits": 8, "groups": 5, "gaps": 5, "context": 3, "glued_before": 2, "glued_after": 2, "check": 3}
ROUNDS, RATE, PRECISION, LEAST_POSITIVES, CHUNK = 60, 0.3, 0.9, 5, 64


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _features(kind: Column, m: Column, before: Column, after: Column) -> Column:
    """The feature values of a proposal, as one number in mixed radix."""
    digits = F.length(_digits(m))
    bucket = F.when(digits >= 20, 7).when(digits >= 16, 6).when(digits >= 13, 5).when(digits >= 10, 4).when(digits >= 8, 3).when(digits >= 5, 2).when(digits >= 1, 1).otherwise(0)
    groups = F.least(F.regexp_count(m, F.lit("[^0-9]+")), F.lit(4))
    gaps = F.when(m.rlike(r"[\[{(]\x20?\p{L}"), 4).when(m.rlike(r"[\x20_./-]{2}"), 3).when(m.rlike(r"[/_:]|\x20@|@\x20"), 2).when(m.rlike(r"[\x20-]"), 1).otherwise(0)
    own, other = F.lit(False), F.lit(False)
    for words, kinds in _CONTEXT.items():
        there, said = before.rlike(words), kind.isin(*kinds)
        own, other = own | (there & said), other | (there & ~said)
    values = [
        F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int") - 1, bucket, groups, gaps, F.when(own, 2).when(other, 1).otherwise(0),
        F.when(before.rlike(r"[\p{L}0-9=\"'_:/.-]\z"), 1).otherwise(0), F.when(after.rlike(r"\A[\p{L}0-9=\"'_:/-]"), 1).otherwise(0),
        F.when(~kind.isin("card", "card_like") | ~digits.between(13, 19), 0).when(_luhn(_digits(m), 13), 2).otherwise(1),
    ]
    out = F.lit(0)
    for v, n in zip(values, FEATURES.values()):
        out = out * n + v
    return out.cast("int")


def _luhn(digits: Column, low: int) -> Column:
    n = F.length(digits)
    return n.between(low, 19) & F.call_function("luhn_check", F.when(n.between(low, 19), digits).otherwise("1"))


def _label(kind: Column, m: Column, good: Column) -> Column:
    """What a proposal counts as when trees are fitted: for cards the length and first digit of an issuer, since their check digit is a feature."""
    return F.when(kind.isin("card", "card_like"), _digits(m).rlike(r"\A[3-6][0-9]{12,18}\z")).otherwise(good)


def _passes(kind: Column, m: Column) -> Column:
    """Whether a proposal's content passes the check of its kind; for base kinds, whether it is a base span."""
    digits = _digits(m)
    marks = F.regexp_replace(F.regexp_replace(m, rf"(?:{_AT})", "@"), rf"(?:{_DOT})", ".")
    return (
        F.when(kind == "email", True).when(kind == "ip", m.rlike(_OCTETS)).when(kind == "card", _luhn(digits, 14)).when(kind == "phone", F.length(digits).between(10, 15))
        .when(kind == "mail_like", marks.rlike(_MAIL)).when(kind == "card_like", _luhn(digits, 13) & digits.rlike(r"\A[3-6]"))
        .when(kind == "number_like", F.length(digits).between(9, 15) & ~m.rlike(_DATE)).otherwise(m.rlike(_IP6))
    )


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end, good, label, cell>>) of every row, in code points; null and empty texts have none.

    Matches and the gaps between them come from the same pattern; a match begins after all gaps and matches before it.
    The sums are taken in chunks, so a text with many matches costs no more than in proportion.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("any", F.col("text").rlike(_ANY))
    one = lambda k: F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(_PATTERNS[k]), F.lit(0)).alias("m"), F.split("text", _PATTERNS[k], -1).alias("g"))
    empty = "array<struct<kind:string,m:array<string>,g:array<string>>>"
    x = rows.select("id", F.when(F.col("any"), F.filter(F.array(*[one(k) for k in KINDS]), lambda p: F.size(p["m"]) > 0)).otherwise(F.array().cast(empty)).alias("p"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    sized = lambda p: F.struct(p["kind"].alias("kind"), p["m"].alias("m"), p["g"].alias("g"), F.zip_with(p["m"], F.slice(p["g"], 1, F.size(p["m"])), lambda m, g: (F.length(m) + F.length(g)).cast("long")).alias("n"))
    chunks = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p["n"]) - 1) / CHUNK).cast("int")), lambda c: total(F.slice(p["n"], c * CHUNK + 1, F.lit(CHUNK))))
    x = x.withColumn("p", F.transform("p", sized))
    x = x.withColumn("p", F.transform("p", lambda p: F.struct(p["kind"].alias("kind"), p["m"].alias("m"), p["g"].alias("g"), p["n"].alias("n"), chunks(p).alias("c"))))
    x = x.withColumn("p", F.transform("p", lambda p: F.struct(p["kind"].alias("kind"), p["m"].alias("m"), p["g"].alias("g"), p["n"].alias("n"), F.transform(p["c"], lambda _, i: total(F.slice(p["c"], F.lit(1), i))).alias("c"))))

    def placed(p):
        def one_span(m, i):
            at = F.get(p["c"], F.floor(i / CHUNK).cast("int")) + total(F.slice(p["n"], F.floor(i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK)) + F.length(F.get(p["g"], i))
            return F.struct(p["kind"].alias("kind"), at.alias("start"), (at + F.length(m)).alias("end"), _passes(p["kind"], m).alias("good"), _label(p["kind"], m, _passes(p["kind"], m)).alias("label"), _features(p["kind"], m, F.right(F.get(p["g"], i), F.lit(24)), F.left(F.get(p["g"], i + 1), F.lit(1))).alias("cell"))

        return F.transform(p["m"], one_span)

    return x.select("id", F.flatten(F.transform("p", placed)).alias("spans"))


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


@dataclass(frozen=True)
class Trees:
    """Trees (feature, cut, [(feature, cut, low, high) for each side]) and each loose kind's least score, if any."""

    bias: float
    trees: list
    least: dict[str, float]

    def expression(self, cell: Column) -> Column:
        value, rest = {}, cell
        for name, n in reversed(FEATURES.items()):
            value[name], rest = rest % n, F.floor(rest / n)
        out = F.lit(self.bias)
        for f, cut, sides in self.trees:
            low, high = [F.when(value[g] <= c, a).otherwise(b) for g, c, a, b in sides]
            out = out + F.when(value[f] <= cut, low).otherwise(high)
        return out


def _stump(x: np.ndarray, g: np.ndarray, h: np.ndarray):
    """(gain, feature, cut, low, high): the best single split of the cells."""
    names, best = list(FEATURES), None
    score = lambda a, b: a * a / (b + 1.0)
    whole = score(g.sum(), h.sum())
    for k, n in enumerate(FEATURES.values()):
        gs, hs = np.cumsum(np.bincount(x[:, k], g, n)), np.cumsum(np.bincount(x[:, k], h, n))
        for cut in range(n - 1):
            gain = score(gs[cut], hs[cut]) + score(gs[-1] - gs[cut], hs[-1] - hs[cut]) - whole
            if best is None or gain > best[0] + 1e-12:
                best = (gain, names[k], cut, -RATE * gs[cut] / (hs[cut] + 1.0), -RATE * (gs[-1] - gs[cut]) / (hs[-1] - hs[cut] + 1.0))
    return best


def boost(cells: np.ndarray, n: np.ndarray, pos: np.ndarray, held_n: np.ndarray, held_pos: np.ndarray) -> Trees:
    """Trees for the counts of each cell in the training fold.

    A loose kind's threshold is the least score, of at least even odds, beyond which the other fold has the wanted precision.
    """
    x, rest = np.zeros((len(cells), len(FEATURES)), np.int64), cells.copy()
    for k, size in reversed(list(enumerate(FEATURES.values()))):
        x[:, k], rest = rest % size, rest // size
    share = (pos.sum() + 1) / (n.sum() + 2)
    bias, trees = float(np.log(share / (1 - share))), []
    f, names = np.full(len(cells), bias), list(FEATURES)
    for _ in range(ROUNDS if len(cells) else 0):
        p = 1 / (1 + np.exp(-f))
        g, h = n * p - pos, n * p * (1 - p)
        gain, name, cut, _, _ = _stump(x, g, h)
        if gain < 1e-6:
            break
        low = x[:, names.index(name)] <= cut
        sides = [_stump(x[s], g[s], h[s])[1:] for s in (low, ~low)]
        for s, (g2, c2, a, b) in zip((low, ~low), sides):
            f[s] += np.where(x[s, names.index(g2)] <= c2, a, b)
        trees.append((name, cut, [(a, b, float(c), float(d)) for a, b, c, d in sides]))
    return Trees(bias, trees, thresholds(x[:, 0], f, held_n, held_pos))


def thresholds(generator: np.ndarray, f: np.ndarray, n: np.ndarray, pos: np.ndarray) -> dict[str, float]:
    """Each loose kind's least score, from the held-out counts of its own cells; where they can't tell, of those of its base kind too, then of all; none: not added."""

    def least(own: np.ndarray, enough: int) -> float | None:
        own = own[np.argsort(-f[own], kind="stable")]
        good, every = np.cumsum(pos[own]), np.cumsum(n[own])
        at = [i for i in range(len(own)) if f[own[i]] >= 0 and good[i] >= enough and good[i] >= PRECISION * every[i] and (i + 1 == len(own) or f[own[i + 1]] < f[own[i]])]
        return float(f[own[at[-1]]]) - 1e-9 if at else None

    out = {}
    for kind, base in zip(LOOSE, FAMILY):
        groups = [np.flatnonzero(generator == KINDS.index(kind)), np.flatnonzero(np.isin(generator, (KINDS.index(kind), KINDS.index(base)))), np.arange(len(f))]
        found = (least(own, LEAST_POSITIVES) for own in groups if pos[own].sum() >= LEAST_POSITIVES)
        told = next((t for t in found if t is not None), None)
        if told is not None:
            out[kind] = told
    return out


def _is_base(s: Column) -> Column:
    return s["good"] & s["kind"].isin(*BASE)


def fit(found: DataFrame) -> Trees:
    """Trees and thresholds from all proposals of ``found`` (id, base, rest); rows fall into folds by a hash of their id."""
    told = found.filter(F.size("rest") + F.size("base") > 0).select((F.pmod(F.xxhash64("id"), F.lit(2)) == 0).alias("held"), F.explode(F.concat("base", "rest")).alias("s"))
    told = told.select("held", F.col("s.cell").alias("cell"), F.col("s.label").cast("long").alias("y"))
    held = F.col("held")
    of = lambda c, on: F.coalesce(F.sum(F.when(on, c)), F.lit(0))
    rows = told.groupBy("cell").agg(of(F.lit(1), ~held).alias("n"), of(F.col("y"), ~held).alias("pos"), of(F.lit(1), held).alias("hn"), of(F.col("y"), held).alias("hpos")).orderBy("cell").collect()
    return boost(*[np.array([r[k] for r in rows], np.int64 if k == "cell" else float) for k in ("cell", "n", "pos", "hn", "hpos")])


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, rest), stored: spans of base kinds that pass their check, and all other proposals that overlap none of them."""
    found = proposals(docs, id_col, text_col).withColumn("base", F.filter("spans", _is_base))
    rest = F.when(F.size("spans") > 0, F.filter("spans", lambda s: ~_is_base(s) & ~F.exists("base", lambda b: _overlap(b, s)))).otherwise(F.col("base"))
    return cut_lineage(found.select("id", "base", rest.alias("rest")))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<start, kind_no, kind, end, base>>) of every row, by start, then kind.

    Null and empty texts have no spans; repeated rows and null ids are judged like any others, and count as often as they
    occur; an empty table gives an empty result; further columns are not read.
    """
    found = judged(docs, id_col, text_col)
    model = fit(found)

    def taken(s):
        over = F.lit(False)
        for kind, least in model.least.items():
            over = over | ((s["kind"] == kind) & (model.expression(s["cell"]) >= least))
        return over

    number = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    shaped = lambda c, base: F.transform(c, lambda s: F.struct(s["start"].alias("start"), number(s).alias("kind_no"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(base).alias("base")))
    spans = F.sort_array(F.concat(shaped("base", True), shaped(F.filter("rest", taken), False)))
    return found.select("id", F.when(F.size("base") + F.size("rest") > 0, spans).otherwise(F.array().cast("array<struct<start:bigint,kind_no:bigint,kind:string,end:bigint,base:boolean>>")).alias("spans"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of every document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null and empty texts have counts 0, the hash of the empty string and no spans. Null and repeated ids come out as they
    came in; an empty table gives an empty result.
    """
    found = find_personal_data(table(spark, sf_dir, "documents"))
    told = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    base = told(F.filter("spans", lambda s: s["base"]))
    return found.select(F.col("id").alias("doc_id"), *[of(k) for k in BASE], F.sha2(base.cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))

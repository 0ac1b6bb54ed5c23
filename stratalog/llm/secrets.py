"""Secret scans by one combined automaton.

All rules are compiled into a single transition table. One pass over the bytes gives the places where keywords, the
beginnings of keys and of tokens, and hexadecimal runs of the least length end. No rule of that table is longer than 33
bytes, so texts are cut into pieces anywhere. From each such place an automaton of the rule's rest goes on to the span's
end; runs of any length are skipped at once. Beyond the base kinds (assign, access, hex) the operator adds ``github``,
``slack`` and ``pem`` spans. A ``pem`` span is a whole private key, to its END line or over the base64 lines.
"""

from __future__ import annotations

from functools import cache
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import Automaton, Tail, compile_rules, compile_tail
from .common import map_batches, rows_by, table

KINDS = ("assign", "access", "hex", "github", "slack", "pem")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_VALUE = "[A-Za-z0-9+/_.=-]"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
_RULES = [
    *((k, True) for k in KEYWORDS),
    ("AKIA[A-Z0-9]{2}", False),
    ("[^0-9a-f][0-9a-f]{%d}" % LEAST_HEX, False),
    ("gh[pousr]_[A-Za-z0-9]{4}", False),
    ("xox[abprs]-[A-Za-z0-9-]{4}", False),
    ("-----BEGIN ", False),
    ("-----END ", False),
]
_N = len(KEYWORDS)
_END_OF_LINE, _B64, _SPACE = r"(\r?\n|\\r|\\n)", "[A-Za-z0-9+/=]", r"[\x20\x09-\x0D]"
#: What goes on from the place of a rule to the end of the span. A body is what follows the header of a key without an END
#: line: header fields, base64 lines (ends of lines may be written as \n), a short last one, and what may stand behind.
_TAILS = {
    "assign": "[\"']?\\x20*[:=]\\x20*[\"']?" + _VALUE + "+",
    "access": "[A-Z0-9]{%d,}" % (LEAST_ACCESS - 6),
    "hex": "[0-9a-f]+",
    "github": "[A-Za-z0-9]{32,}",
    "slack": "[A-Za-z0-9-]{6,}",
    "header": "[A-Z\\x20]*PRIVATE\\x20KEY-----",
    "body": f"({_END_OF_LINE}{_SPACE}*[A-Za-z][A-Za-z-]*:[^\\r\\n\\\\]*)*(({_SPACE}|\\\\r|\\\\n)+(>\\x20?)*{_B64}{{16,}})+"
    + f"([\\x20\\x09-\\x0D\\\\\"',;<]|(\\r?\\n|\\\\n)[\\x20\\x09>]*{_B64}+[\\x20\\x09]*[\\r\\n\\\\\"'<])",
}


@cache
def automaton() -> Automaton:
    return compile_rules(_RULES, b"\n")


@cache
def tail(kind: str) -> Tail:
    return compile_tail(_TAILS[kind])


def _keys(text: bytes, begins: list[int], ends: list[int]) -> list[tuple[int, int, str]]:
    """Spans of private keys whose BEGIN and END marks end before these places, each up to the next header at most."""
    data = np.frombuffer(text, np.uint8)
    whole = lambda places: [(at, got[1]) for at in places if (got := tail("header").follow(text, data, at, len(text)))]
    heads, closes = whole(begins), whole(ends)
    out, k = [], 0
    for (at, body), (most, _) in zip(heads, [*heads[1:], (len(text) + 11, 0)]):
        most -= 11  # the next header's own mark
        while k < len(closes) and closes[k][0] < body:
            k += 1
        label = text[at:body]
        close = next((e for p, e in takewhile(lambda c: c[0] < most, islice(closes, k, None)) if e <= most and text[p:e] == label), None)
        if close is None:
            padded = text[body:most] + b"\n"
            got = tail("body").follow(padded, np.frombuffer(padded, np.uint8), 0, len(padded))
            close = body + len(padded[: got[1] - 1].rstrip(b"\x20\t")) if got else body
        out.append((at - 11, close, "pem"))
    return out


def _spans(text: bytes, where: np.ndarray, what: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans in bytes of one text from the places where rules end."""
    data = np.frombuffer(text, np.uint8)
    of = lambda k: (where[(what >> k) & 1 == 1] + 1).tolist()
    out, last = [], 0
    for end, size in sorted((e, len(k)) for i, k in enumerate(KEYWORDS) for e in of(i)):
        if end - size >= last and (got := tail("assign").follow(text, data, end, len(text))):
            last = got[1]
            if got[1] - got[0] + 1 >= LEAST_VALUE:
                out.append((end - size, last, "assign"))
    for k, kind, size in ((0, "access", 6), (1, "hex", LEAST_HEX), (2, "github", 8), (3, "slack", 9)):
        last = 0
        for end in of(_N + k):
            if end - size >= last:
                got = tail(kind).follow(text, data, end, len(text))
                last = got[1] if got else last
                if got or kind == "hex":
                    last = max(last, end)
                    out.append((end - size, last, kind))
    out += _keys(text, of(_N + 4), of(_N + 5))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def scan_texts(texts: pa.Array, scanner: Automaton) -> dict[int, list[tuple[int, int, str]]]:
    """Spans in code points of those of the texts that have any, by index; null texts have none."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or offsets[-1] == offsets[0]:
        return {}
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets - offsets[0]
    where, what = scanner.events(data, starts[:-1])
    owner = np.searchsorted(starts, where, side="right") - 1
    found = {}
    for i in np.unique(owner).tolist():
        a, b = np.searchsorted(owner, i), np.searchsorted(owner, i, side="right")
        own = data[starts[i] : starts[i + 1]]
        if spans := _spans(own.tobytes(), where[a:b] - starts[i], what[a:b]):
            before = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
            found[i] = [(int(before[s]), int(before[e]), k) for s, e, k in spans]
    return found



def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, starts, ends, kinds) for every row, spans in code points by start, then kind.

    Null and empty texts have none. Null and repeated ids come out as they came in; an empty table gives an empty result;
    further columns are not read.
    """
    scanner = automaton()

    def run(batch):
        for a, b in rows_by(batch, "text"):
            part = batch.slice(a, b - a)
            found = scan_texts(part.column(1), scanner)
            rows = [found.get(i, []) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([[s for s, _, _ in r] for r in rows], pa.list_(pa.int64())), pa.array([[e for _, e, _ in r] for r in rows], pa.list_(pa.int64())), pa.array([[k for _, _, k in r] for r in rows], pa.list_(pa.string()))],
                names=["id", "starts", "ends", "kinds"],
            )

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, starts array<long>, ends array<long>, kinds array<string>")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span, overlapping ones joined, replaced by ``mask``."""
    scanner = automaton()

    def run(batch):
        for a, b in rows_by(batch, text_col):
            part = batch.slice(a, b - a)
            k = part.schema.get_field_index(text_col)
            if found := scan_texts(part.column(k), scanner):
                texts = part.column(k).to_pylist()
                for i, spans in found.items():
                    out, last = [], 0
                    for s, e, _ in spans:
                        if s >= last:
                            out += [texts[i][last:s], mask]
                        last = max(last, e)
                    texts[i] = "".join([*out, texts[i][last:]])
                part = part.set_column(k, part.schema.field(k), pa.array(texts, part.schema.field(k).type))
            yield part

    return map_batches(docs, run, docs.schema)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have counts 0, the hash of the empty string and no spans. Null and repeated ids come out as they
    came in; an empty table gives an empty result.
    """
    found = find_secrets(table(spark, sf_dir, "documents"))
    told = F.zip_with(F.zip_with("kinds", "starts", lambda k, s: F.concat(k, F.lit(":"), s.cast("string"))), "ends", lambda x, e: F.concat(x, F.lit(":"), e.cast("string")))
    base = F.filter("told", lambda x: F.split(x, ":")[0].isin(*KINDS[:3]))
    of = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return found.withColumn("told", told).select(
        F.col("id").alias("doc_id"), *[of(k) for k in KINDS[:3]],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join("told", ",").alias("spans"),
    )

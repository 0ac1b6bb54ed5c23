"""Queries with rules and searches that come as tables as large as the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.index import indexed_hits, lines_of_specs, negative_specs
from . import views as V
from .register import query

#: A rule looks for so many words at the beginning and at the end of a text.
WORDS = 4


def text_rules(spark, sf_dir: str):
    """(rule_ord, rule_id, patterns): a rule for each different beginning of a document, with the end of the first such document as second pattern."""
    docs = V.read(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \n]+"), lambda w: w != "").alias("w")).filter(F.size("w") >= WORDS)
    quoted = lambda c: F.regexp_replace(F.array_join(c, " "), r"([^\p{L}\p{N} ])", r"\\$1")
    rules = docs.select("doc_id", quoted(F.slice("w", 1, WORDS)).alias("a"), quoted(F.slice("w", -WORDS, WORDS)).alias("b"))
    first = rules.groupBy("a").agg(F.min(F.struct("doc_id", "b")).alias("x"))
    return first.select(F.col("x.doc_id").cast("int").alias("rule_ord"), F.concat(F.lit("TEXT-"), F.col("x.doc_id").cast("string")).alias("rule_id"), F.array("a", "x.b").alias("patterns"))


_AT = "substr(raw_line, strpos(lower(raw_line), lower({0})), length({0}))"


@query("indexed_rules", f"""WITH {V.DOCUMENT_LINES}, w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\n]+'), lambda x: x <> '') AS w FROM documents),
r AS (SELECT min(doc_id) AS id, a, arg_min(b, doc_id) AS b FROM (SELECT doc_id, array_to_string(w[1:{WORDS}], ' ') AS a, array_to_string(w[-{WORDS}:], ' ') AS b FROM w WHERE len(w) >= {WORDS}) GROUP BY a)
SELECT artifact_path, line_number, 'TEXT-' || id AS rule_id, CASE WHEN contains(lower(raw_line), lower(a)) THEN {_AT.format('a')} ELSE {_AT.format('b')} END AS matched_text
FROM lines JOIN r ON contains(lower(raw_line), lower(a)) OR contains(lower(raw_line), lower(b))""")
def indexed_rules(spark, sf_dir):
    """As many rules as texts, against all lines of all documents."""
    lines = V.document_lines(spark, sf_dir).select("artifact_path", "line_number", "raw_line")
    return indexed_hits(lines, text_rules(spark, sf_dir)).select("artifact_path", "line_number", "rule_id", "matched_text")


_FAMILY = "'log_' || coalesce(lang, 'none')"


def word_specs(spark, sf_dir: str):
    """(spec_ord, message, families, needles, target): for each benchmark item its first, third and fifth word, in families by its number."""
    items = V.read(spark, sf_dir, "benchmark").select(F.row_number().over(V.Window.orderBy("item_id")).alias("spec_ord"), F.col("item_id").cast("string").alias("message"), F.split("text", " ").alias("w"))
    families = F.when(F.col("spec_ord") % 3 == 0, F.array(F.lit("log_en"), F.lit("log_de"))).otherwise(F.array(F.lit("log_fr"), F.lit("log_en"), F.lit("log_xx")))
    needles = F.filter(F.array(*[F.get("w", F.lit(k)) for k in (0, 2, 4)]), lambda x: x.isNotNull())
    return items.select("spec_ord", "message", families.alias("families"), needles.alias("needles"), F.when(F.col("spec_ord") % 5 == 0, "log_es").otherwise("log_yy").alias("target"))


_SPECS = """items AS (SELECT row_number() OVER (ORDER BY item_id) AS spec_ord, CAST(item_id AS VARCHAR) AS message, list_filter([w[1], w[3], w[5]], lambda x: x IS NOT NULL) AS needles FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)),
specs AS (SELECT *, CASE WHEN spec_ord % 3 = 0 THEN ['log_en', 'log_de'] ELSE ['log_fr', 'log_en', 'log_xx'] END AS families, CASE WHEN spec_ord % 5 = 0 THEN 'log_es' ELSE 'log_yy' END AS target FROM items)"""
_LINES = f"{V.DOCUMENT_LINES}, own AS (SELECT l.*, {_FAMILY} AS artifact_family FROM lines l JOIN documents d ON l.artifact_path = 'doc-' || d.doc_id || '.txt')"
_ALL = "len(needles) > 0 AND len(list_filter(needles, lambda x: NOT contains(lower(raw_line), lower(x)))) = 0"


def _lines(spark, sf_dir: str):
    family = V.read(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("artifact_path"), F.expr(_FAMILY.replace("'none'", '"none"')).alias("artifact_family"))
    return V.document_lines(spark, sf_dir).join(family, "artifact_path").select("artifact_path", "line_number", "raw_line", "artifact_family")


@query("spec_lines", f"WITH {_LINES}, {_SPECS} SELECT artifact_path, line_number, message FROM own JOIN specs ON {_ALL}")
def spec_lines(spark, sf_dir):
    """Lines that hold all words of a search, for as many searches as there are benchmark items."""
    specs = word_specs(spark, sf_dir)
    return lines_of_specs(_lines(spark, sf_dir), specs).join(specs.select("spec_ord", "message"), "spec_ord").select("artifact_path", "line_number", "message")


@query("negative_specs", f"""WITH {_LINES}, {_SPECS}, seen AS (SELECT DISTINCT {_FAMILY} AS f FROM documents)
SELECT spec_ord, message FROM specs WHERE EXISTS (SELECT 1 FROM seen WHERE list_contains(families, f)) AND NOT EXISTS (SELECT 1 FROM seen WHERE f = target)
AND NOT EXISTS (SELECT 1 FROM own WHERE list_contains(families, artifact_family) AND {_ALL})""")
def negative_specs_found(spark, sf_dir):
    """Searches without a line although a family they are for was scanned."""
    families = V.read(spark, sf_dir, "documents").select(F.expr(_FAMILY.replace("'none'", '"none"')).alias("artifact_family"))
    return negative_specs(families, _lines(spark, sf_dir), word_specs(spark, sf_dir))

"""URL filters by a path-template tree; built-in functions only.

Rules decide first. The urls that they decide are the labelled ones. Per host, a path becomes a template: digits become
wildcards, and so does a segment that fewer than ``LEAST_ROWS`` urls of the host have at its place. The templates of a
host form a tree, at any depth. Under each of its nodes, branches whose share of blocked urls is not significantly
different from that of their siblings are merged: they count together. Branches with too few labels to tell stand alone.

A template that no rule decides is rejected if its smoothed share of blocked urls is a half or more. The share of all
urls is smoothed by the host's, by that of the same template on all hosts, and then, from the root of the host's tree
down, by the counts of each branch on the way, or of the branches that it is merged with.

Counts are first summed per host and written path. Everything joined on a host, a place, a template or a path is dealt
over parts where such a key has many rows. Nodes of the tree are known by host, depth and a 64-bit hash of their path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .common import LOWER, UPPER, ascii_lower, join_counted, table

#: (verdict, host, path) of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LEAST_ROWS, LEAST_LABELS, Z, STRENGTH, REJECT = 8, 5, 1.96, 2.0, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case; path: then up to ``?``, ``#`` or the end. Both empty for null or no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return ascii_lower(F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*", 0), F.lit(""))), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. Of rules of one length the first listed wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _steps(path: Column) -> Column:
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.slice(F.split(path, "/"), 2, 1 << 30))


def templates(urls: DataFrame) -> DataFrame:
    """(host, written, l, b, rows_of_key, template) of (host, written, blocked 1/0/null): labels, blocked ones and rows of each written path."""
    t = cut_lineage(urls.groupBy("host", "written").agg(F.count("blocked").alias("l"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"), F.count("*").alias("rows_of_key")))
    keyed = t.withColumn("key", F.md5("written"))  # the rows of a deep path's steps carry no path
    x = keyed.select("host", "key", F.col("rows_of_key").alias("n"), F.posexplode(_steps(F.col("written"))).alias("j", "step"))
    places = cut_lineage(x.groupBy("host", "j", "step").agg((F.sum("n") >= LEAST_ROWS).alias("literal"), F.count("*").alias("rows_of_key")))
    told = join_counted(x.drop("n"), places, ["host", "j", "step"]).groupBy("host", "key").agg(F.sort_array(F.collect_list(F.struct("j", F.when(F.col("literal"), F.col("step")).otherwise("*").alias("step")))).alias("steps"))
    written = F.concat(F.lit("/"), F.array_join(F.transform("steps", lambda s: s["step"]), "/"))
    return cut_lineage(keyed.join(told.select("host", "key", written.alias("template")), ["host", "key"], "left").na.fill("", ["template"]).drop("key"))


def branches(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the leaves (host, key, template, l, b): the nodes above each (host, key, j, node), and each node's counts (host, j, node, gl, gb, rows_of_key), merged or own.

    A node's hash is that of its parent's hash and its own step, so a path of any depth is hashed once.
    """
    start = F.struct(F.array().cast("array<struct<node:bigint,parent:bigint>>").alias("way"), F.lit(0).cast("long").alias("last"))

    def step(a, s):
        node = F.xxhash64(a["last"], s)
        return F.struct(F.concat(a["way"], F.array(F.struct(node.alias("node"), a["last"].alias("parent")))).alias("way"), node.alias("last"))

    way = F.aggregate(_steps(F.col("template")), start, step, lambda a: a["way"])
    nodes = leaves.select("host", "key", "l", "b", way.alias("way")).select("host", "key", "l", "b", F.posexplode("way").alias("j", "n")).select("host", "key", "l", "b", "j", "n.node", "n.parent")
    one = cut_lineage(nodes.groupBy("host", "j", "node").agg(F.min("parent").alias("parent"), F.sum("l").alias("l"), F.sum("b").alias("b"), F.count("*").alias("rows_of_key")))
    around = one.groupBy("host", "j", "parent").agg(F.sum("l").alias("pl"), F.sum("b").alias("pb"), F.count("*").alias("rows_of_key"))
    rest, told = F.col("pl") - F.col("l"), (F.col("l") >= LEAST_LABELS) & (F.col("pl") - F.col("l") >= LEAST_LABELS)
    p, q, pool = F.col("b") / F.col("l"), (F.col("pb") - F.col("b")) / rest, F.col("pb") / F.col("pl")
    alike = F.when(~told, False).otherwise(F.abs(p - q) <= Z * F.sqrt(pool * (1 - pool) * (1 / F.col("l") + 1 / rest)) + 1e-9)
    one = cut_lineage(join_counted(one, around, ["host", "j", "parent"]).withColumn("alike", alike))
    merged = one.filter("alike").groupBy("host", "j", "parent").agg(F.sum("l").alias("ml"), F.sum("b").alias("mb"), F.count("*").alias("rows_of_key"))
    both = join_counted(one, merged, ["host", "j", "parent"])
    counts = both.select("host", "j", "node", F.when(F.col("alike"), F.col("ml")).otherwise(F.col("l")).alias("gl"), F.when(F.col("alike"), F.col("mb")).otherwise(F.col("b")).alias("gb"), "rows_of_key")
    return nodes.select("host", "key", "j", "node"), cut_lineage(counts)


def template_tree(urls: DataFrame) -> DataFrame:
    """(host, written, template, p, rows_of_key) of (host, written, blocked 1/0/null): the smoothed share of blocked urls of each written path's template."""
    t = templates(urls)
    every = t.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("l"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    total = F.lit((every.b + 1.0) / (every.l + 2.0))
    leaves = cut_lineage(t.groupBy("host", "template").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.count("*").alias("rows_of_key")).withColumn("key", F.md5("template")))
    nodes, counts = branches(leaves)
    way = join_counted(nodes, counts, ["host", "j", "node"]).groupBy("host", "key").agg(F.sort_array(F.collect_list(F.struct("j", "gl", "gb"))).alias("way"))
    hosts = leaves.groupBy("host").agg(F.sum("l").alias("hl"), F.sum("b").alias("hb"), F.count("*").alias("rows_of_key"))
    shapes = leaves.groupBy("template").agg(F.sum("l").alias("sl"), F.sum("b").alias("sb"), F.count("*").alias("rows_of_key"))
    x = join_counted(join_counted(leaves, cut_lineage(hosts), ["host"]), cut_lineage(shapes), ["template"]).join(way, ["host", "key"], "left")
    smooth = lambda b, n, prior: (b + STRENGTH * prior) / (n + STRENGTH)
    shape = smooth(F.col("sb"), F.col("sl"), smooth(F.col("hb"), F.col("hl"), total))
    p = F.coalesce(F.aggregate("way", shape, lambda prior, g: smooth(g["gb"], g["gl"], prior)), shape)
    shares = cut_lineage(x.select("host", "template", p.alias("p"), "rows_of_key"))
    return cut_lineage(join_counted(t.select("host", "written", "template", "rows_of_key"), shares, ["host", "template"]))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, template, p, verdict) for every row; a rule's verdict, else the template's.

    Null urls and urls without ``://`` have an empty host and path and are judged like any other template. Repeated
    rows count as often as they occur. Urls and paths may have any length and depth. Without any labelled url every share
    is a half, so all that no rule decides is rejected. An empty table gives an empty result; further columns are not read.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("by", rule_of(F.col("host"), F.col("path"), rules)).withColumn("written", F.regexp_replace("path", "[0-9]+", "*"))
    blocked = F.when(F.col("by").isNotNull(), (F.col("by.verdict") == "block").cast("long"))
    tree = template_tree(urls.select("host", "written", blocked.alias("blocked")))
    out = join_counted(urls, tree, ["host", "written"])
    verdict = F.coalesce("by.verdict", F.when(F.col("p") >= REJECT, "block").otherwise("allow"))
    return out.select("id", "host", "path", F.col("by.rule").alias("rule"), "template", "p", verdict.alias("verdict"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: page_id, host, path, rule, verdict.

    Null urls and those without ``://`` have an empty host and path and no rule. Null and repeated ids come out as they
    came in; an empty table gives an empty result.
    """
    return judge(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _sql() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered) + " END"
    steps = lambda c: f"CASE WHEN {c} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({c}, '/')[2:] END"
    return f"""
WITH u0 AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u1 AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u0),
u AS (SELECT *, {rule} AS rule, {said} AS said, regexp_replace(path, '[0-9]+', '*', 'g') AS written FROM u1),
t0 AS (SELECT host, written, count(said) AS l, count(*) FILTER (said = 'block') AS b, count(*) AS n, {steps("written")} AS s FROM u GROUP BY host, written),
x AS (SELECT host, written, n, j, s[j] AS step FROM (SELECT *, unnest(range(1, len(s) + 1)) AS j FROM t0)),
places AS (SELECT host, j, step, sum(n) >= {LEAST_ROWS} AS literal FROM x GROUP BY host, j, step),
told AS (SELECT host, written, '/' || string_agg(CASE WHEN literal THEN step ELSE '*' END, '/' ORDER BY j) AS template FROM x JOIN places USING (host, j, step) GROUP BY host, written),
t AS (SELECT t0.host, t0.written, l, b, coalesce(template, '') AS template FROM t0 LEFT JOIN told USING (host, written)),
leaves AS (SELECT host, template, CAST(sum(l) AS DOUBLE) AS l, CAST(sum(b) AS DOUBLE) AS b FROM t GROUP BY host, template),
nodes AS (SELECT host, template, l, b, j, array_to_string(s[1:j], '/') AS node, array_to_string(s[1:j - 1], '/') AS parent
  FROM (SELECT *, unnest(range(1, len(s) + 1)) AS j FROM (SELECT *, {steps("template")} AS s FROM leaves))),
b0 AS (SELECT host, j, node, any_value(parent) AS parent, sum(l) AS l, sum(b) AS b FROM nodes GROUP BY host, j, node),
b1 AS (SELECT *, sum(l) OVER (PARTITION BY host, j, parent) AS pl, sum(b) OVER (PARTITION BY host, j, parent) AS pb FROM b0),
b2 AS (SELECT *, CASE WHEN l < {LEAST_LABELS} OR pl - l < {LEAST_LABELS} THEN false
  ELSE abs(b / l - (pb - b) / (pl - l)) <= {Z} * sqrt((pb / pl) * (1 - pb / pl) * (1 / l + 1 / (pl - l))) + 1e-9 END AS alike FROM b1),
b3 AS (SELECT *, sum(l) FILTER (alike) OVER (PARTITION BY host, j, parent) AS ml, sum(b) FILTER (alike) OVER (PARTITION BY host, j, parent) AS mb FROM b2),
counts AS (SELECT host, j, node, CASE WHEN alike THEN ml ELSE l END AS gl, CASE WHEN alike THEN mb ELSE b END AS gb FROM b3),
way AS (SELECT host, template, list(struct_pack(gl := gl, gb := gb, p := CAST(0 AS DOUBLE)) ORDER BY j) AS way FROM nodes JOIN counts USING (host, j, node) GROUP BY host, template),
n1 AS (SELECT *, sum(l) OVER (PARTITION BY host) AS hl, sum(b) OVER (PARTITION BY host) AS hb, sum(l) OVER (PARTITION BY template) AS sl,
  sum(b) OVER (PARTITION BY template) AS sb, sum(l) OVER () AS al, sum(b) OVER () AS ab FROM leaves),
n2 AS (SELECT host, template, (sb + {STRENGTH} * ((hb + {STRENGTH} * ((ab + 1.0) / (al + 2.0))) / (hl + {STRENGTH}))) / (sl + {STRENGTH}) AS shape FROM n1),
n3 AS (SELECT host, template, CASE WHEN way IS NULL THEN shape ELSE list_reduce(list_prepend(struct_pack(gl := CAST(0 AS DOUBLE), gb := CAST(0 AS DOUBLE), p := shape), way),
  lambda a, g: struct_pack(gl := g.gl, gb := g.gb, p := (g.gb + {STRENGTH} * a.p) / (g.gl + {STRENGTH}))).p END AS p FROM n2 LEFT JOIN way USING (host, template))
SELECT page_id, u.host, path, rule, coalesce(said, CASE WHEN n3.p >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict
FROM u JOIN t ON u.host = t.host AND u.written = t.written JOIN n3 ON t.host = n3.host AND t.template = n3.template
"""


OP9_SQL = _sql()

"""Reports that executors write against the same reports written line after line."""

import pytest
from pyspark.sql import functions as F

from stratalog import api, sinks
from stratalog.operators import findings as G
from stratalog.schema import COVERAGE_COLUMNS, HIT_COLUMNS

from . import plain_reports as plain
from .test_files import NONE, make_zip


@pytest.mark.parametrize("quiet", [False, True])
def test_reports_are_those_of_one_machine(spark, tmp_path, quiet):
    d = tmp_path / "in"
    d.mkdir()
    files = {"a.log": b"fine\n"} if quiet else {
        "sql <1>.log": "ok\nExecution Timeout Expired <b> \"q\" é\nlast\nerror\n".encode(), "t.bt9": b"Server Communication\nGetSslError[16] CERT_CN_INVALID\n", "b.bin": b"\x00\x01tls down\x00", "p.7z": b"7z\xbc\xaf\x27\x1c\x00",
        "z.zip": make_zip({"in.log": b"Kernel assertions FailureId[778]\n", "../up": b"x"}),
    }
    for name, data in files.items():
        (d / name).write_bytes(data)
    frames = api.scan(spark, [str(d), str(d / "missing")], str(tmp_path / "w"), api.Options(tools=NONE))
    cover, hits, by_file = frames.coverage, frames.hits, frames.by_file
    summary, kbs, items = G.scan_summary(hits).first(), G.kb_list(hits, frames.pack).collect(), sinks.checklist_text(G.checklist(cover, hits).collect())
    negatives = [] if quiet else [r.message for r in G.negative_searches(cover).collect()]
    sinks.write_reports(cover, hits, by_file, sinks.Facts(cover.count(), summary, kbs, negatives, items), tmp_path / "r.txt", tmp_path / "r.html", "T & <t>")
    facts = plain.Facts(cover, hits, by_file.orderBy("artifact_path"), summary, kbs, negatives, items)
    plain.write_text_report(facts, tmp_path / "p.txt", "T & <t>")
    plain.write_html_report(facts, tmp_path / "p.html", "T & <t>")
    for kind in ("txt", "html"):
        assert (tmp_path / f"r.{kind}").read_bytes() == (tmp_path / f"p.{kind}").read_bytes()
    timed = hits.selectExpr("*", "'' as timestamp")
    for df, columns, order in ((cover, COVERAGE_COLUMNS, "artifact_ord"), (timed, HIT_COLUMNS, "hit_no")):
        sinks.write_csv(df, columns, tmp_path / "r.csv", [order])
        plain.write_csv(df.orderBy(order), columns, tmp_path / "p.csv")
        assert (tmp_path / "r.csv").read_bytes() == (tmp_path / "p.csv").read_bytes()


def test_parts_of_one_file(spark, tmp_path):
    df = spark.range(5000).repartition(6).select("id", F.concat(F.lit("é"), F.col("id").cast("string"), F.lit("\n")).alias("text"))
    sinks.write_ordered(df, ["id"], tmp_path / "f", "head\n")
    assert (tmp_path / "f").read_text() == "head\n" + "".join(f"é{k}\n" for k in range(5000))
    sinks.write_ordered(df.limit(0), ["id"], tmp_path / "f", "only\n")
    assert (tmp_path / "f").read_text() == "only\n"
    sinks.write_ordered(df.filter("id = 0").withColumn("text", F.lit(None).cast("string")), ["id"], tmp_path / "f")
    assert (tmp_path / "f").read_bytes() == b""

"""Hits numbered where they are found, and what reports say of them by expressions."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from stratalog import fixed, sinks
from stratalog.functions.rules import built_in
from stratalog.operators import scan as S
from stratalog.plans import registry, reported
from stratalog.plans import views as V


def logs(spark, n=12):
    rnd = random.Random(51)
    said = [*V.SAMPLES, "", None, "plain", "a < b & 'c' > \"d\" error"]
    rows = [(f"u{k}.log", f"u{k}.log", i + 1, rnd.choice(said)) for k in range(n) for i in range(rnd.choice([1, 2, 5, 60]))]
    return spark.createDataFrame(rows, "artifact_ord string, artifact_path string, line_number long, raw_line string").repartition(5)


@pytest.mark.parametrize("block", [3, S.LINE_BLOCK])
def test_hits_in_order_equal_numbered_hits(spark, block):
    lines, pack = logs(spark), built_in()
    want = S.numbered(S.add_context(S.row_hits(lines, pack), lines))
    got = S.hits_in_order(lines, pack, block)
    assert sorted(got.columns) == sorted(want.columns)
    told = got.select(*want.columns).orderBy("hit_no").collect()
    assert len(told) > 200 and told == want.orderBy("hit_no").collect()
    assert S.hits_in_order(lines.limit(0), pack).count() == 0


def test_pieces_say_what_the_plain_forms_say(spark):
    hits = S.numbered(S.add_context(S.row_hits(logs(spark), built_in()), logs(spark))).withColumn("severity", F.when(F.col("hit_no") % 7 == 0, "other").otherwise(F.col("severity")))
    hits = hits.withColumn("byte_offset", F.when(F.col("hit_no") % 5 == 0, F.col("line_number"))).withColumn("line_number", F.when(F.col("hit_no") % 5 > 0, F.col("line_number")))
    want = set()
    for r in hits.collect():
        h = SimpleNamespace(**r.asDict())
        marked, places = sinks._html_finding(h) + "\n", [sinks.APPENDIX]
        if h.severity in fixed.SEVERITIES:
            places.append(sinks.FIRST_SEVERITY + fixed.SEVERITIES.index(h.severity))
            want.add((sinks.TEXT, places[1], h.hit_no, "", sinks._text_finding(h) + "\n"))
        want |= {(sinks.HTML, p, h.hit_no, "", marked) for p in places}
        want.add((sinks.TEXT, sinks.APPENDIX, h.hit_no, "", f"- {h.rule_id} {h.artifact_path}:{sinks._at(h)} {h.raw_line}\n"))
    got = [tuple(r) for r in sinks.hit_lines(hits).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("query", [registry.all_hits, reported.all_hits_csv, reported.report_pieces])
def test_hits_are_neither_shuffled_nor_sent_to_python(spark, tmp_path, query):
    rows = [(e, f"2024-01-01 00:{e // 60 % 60:02d}:{e % 60:02d}", e % 9, ("error", "view")[e % 2]) for e in range(400)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    df = query(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "InArrow" not in plan and "Join" not in plan and df.count() > 300

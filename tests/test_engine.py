"""Rule compiler, scanners against plain models, reports, command line, streaming and registered queries."""

import csv
import io
import json
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stratalog import __main__ as cli
from stratalog import api, fixed, sinks
from stratalog.functions import rules as R
from stratalog.functions import text as T
from stratalog.operators import casenum
from stratalog.operators import scan as S
from stratalog.operators.classify import file_name, marker_family, suffix_of
from stratalog.plans import registry
from stratalog.streaming import dropfolder


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def run(df, expression):
    return [r.x for r in df.orderBy("i").select(expression.alias("x")).collect()]


# --- rules

LINES = [
    "Connection:  Connected(Waiting)", "connection: Disconnected(waiting)", "Session:\x1cInactive", "AD query: 12 ms", "x.NET Framework 4z8", ".NET Framework 4.8", "Kernel assertions", "FailureId[778]", "ValidationError[ x", "Current server: a\u0085b 41002",
    "Reset attempt 3 of Carbon Black File Reputation", "IIS APPPOOL\\DefaultAppPool", "", "plain", "tampeR", "443 and 14430", "certificate", "acceſs denied", "ſerver communication", "Tamper Protection and tamper protection", None,
]


def plain_hits(line, pack):
    out = []
    for k, r in enumerate(pack.rules):
        for p in r.patterns:
            if m := re.search(p, line, re.I):
                out.append((k, r.rule_id, m[0]))
                break
    return out + [(len(pack.rules) + k, fixed.GENERIC_RULE, t) for k, t in enumerate(pack.terms) if t in line.lower()]


def test_line_hits_equal_python(spark):
    pack = R.built_in()
    rnd = random.Random(1)
    texts = [p.replace("\\", "").replace("s+", " ").replace("s*", "").replace("d+", "5") for r in pack.rules for p in r.patterns]
    lines = LINES[:-1] + [rnd.choice(["", "x ", "é"]) + rnd.choice(texts).swapcase() + rnd.choice([" tail", "", " error"]) for _ in range(300)]
    df = column(spark, [*lines, None])
    got = run(df, F.transform(R.line_hits(F.col("v"), pack), lambda h: F.struct(h["rule_ord"], h["rule_id"], h["matched_text"])))
    may = run(df, R.may_hit(F.col("v"), pack))
    for line, hits, m in zip(lines, got, may):
        assert [tuple(h) for h in hits] == plain_hits(line, pack), line
        assert m or not hits
    assert got[-1] == [] and may[-1] is False


@pytest.mark.parametrize(("pattern", "text"), [(r"a\s+b", ""), (r"WSE2127", "wse2127"), (r"x(a|b)yy", "yy"), (r"ab?c", "a"), (r"abc{2}d", "ab"), ("a|b", ""), (r"a\.b\[c", "a.b[c"), (r"[ab]cd", "cd"), (r"GetSslError\[16\]", "getsslerror[16]"), ("é", "")])
def test_literal_of(pattern, text):
    found = R.literal_of(pattern)
    assert found == text or len(found) == len(text) or (not text and len(found) <= 1)


def test_to_java_classes():
    assert R.to_java(r"[\s]x\s") == r"(?iUd)[\s\x1c-\x1f]x[\s\x1c-\x1f]" and R.to_java("[]a]") == r"(?iUd)[\]a]" and R.to_java(r"a\Z") == r"(?iUd)a\z"


def test_pack_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"rules": [{"rule_id": "A", "patterns": ["x+"], "kb_candidates": [1, 2]}]}))
    pack = R.load_pack(str(tmp_path / "p.json"), ["t"], str(tmp_path / "none.json"))
    assert pack.rules[0].kb_candidates == ("1", "2") and pack.kb_titles == {} and pack.terms == ("t",)
    (hits,) = run(column(spark, ["Xx T"]), R.line_hits(F.col("v"), pack))
    assert [(h.rule_id, h.matched_text, h.kb_candidate_ids) for h in hits] == [("A", "Xx", "KB candidate 1;KB candidate 2"), (fixed.GENERIC_RULE, "t", "")]
    table = R.rules_table(spark, R.built_in())
    assert table.count() == 18 and sum(len(r.patterns) for r in table.collect()) == 86


def test_markers_and_names(spark):
    texts = ["PHPErrors", "PHP x", "API request", "LDAP", "trace.bt9", "GetSslError Session: LDAP ADHelper", "LDAP with SQLTrace", "", "ServerLog"]
    want = ["php_errors", None, "api_log", None, "agent_trace_bt9", "agent_trace_bt9", "sql_trace", None, "server_bt9"]
    assert run(column(spark, texts), marker_family(F.col("v"))) == want
    names = ["/a/b.LOG", "/a/.log", "/a/x.tar.gz", "/a/noext", "/a.d/x", "/a/b.", "/a/..x.y", "/a/b..log"]
    assert run(column(spark, names), suffix_of(F.col("v"))) == [".log", "", ".gz", "", "", "", ".y", ".log"] and run(column(spark, names), file_name(F.col("v")))[1] == ".log"


# --- lines and runs


def test_split_and_context(spark):
    texts = ["a\nb\r\nc\rd", "a\n", "", "\n", "a\r\r\nb", "x y"]
    assert run(column(spark, texts), T.split_lines(F.col("v"))) == [["a", "b", "c", "d"], ["a"], [], [""], ["a", "", "b"], ["x y"]]


def test_windows_over_blocks_equal_slices(spark):
    rnd = random.Random(2)
    logs = {f"f{k}": [rnd.choice(["", "x", "yy"]) for _ in range(rnd.choice([1, 2, 5, 37]))] for k in range(12)}
    df = spark.createDataFrame([(f, i + 1, x or None) for f, xs in logs.items() for i, x in enumerate(xs)], "artifact_path string, line_number long, raw_line string").repartition(3)
    rows = S.with_context(df, block=4).collect()
    assert len(rows) == sum(map(len, logs.values()))
    for r in rows:
        xs, i = logs[r.artifact_path], r.line_number - 1
        assert r.context_before == "\n".join(xs[max(0, i - 2) : i]) and r.context_after == "\n".join(xs[i + 1 : i + 3])


def plain_runs(data, chunk):
    """What a scan by chunks reports, each with 256 bytes of the one before."""
    out, carry = [], b""
    for at in range(0, len(data), chunk):
        part = carry + data[at : at + chunk]
        start = at - len(carry)
        for m in re.finditer(rb"[\x20-\x7e]{4,}", part):
            if start + m.start() >= at:
                out.append((at // chunk, 0, start + m.start(), m[0].decode()))
        for m in re.finditer(rb"(?:[\x20-\x7e]\x00){4,}", part):
            if start + m.start() >= at:
                out.append((at // chunk, 1 + (start + m.start()) % 2, start + m.start(), m[0][::2].decode()))
        carry = part[-256:]
    return sorted(out)


def test_runs_equal_a_chunked_scan(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 1024)
    rnd = random.Random(3)
    blobs = [b"".join(rnd.choice([b"A\x00", b"ab", b"\x00", b"\xff", b"error ", b"x\x00y\x00z\x00w\x00", b" " * 300]) for _ in range(rnd.randrange(600))) for _ in range(60)]
    df = spark.createDataFrame([(str(k), str(k), bytearray(b)) for k, b in enumerate(blobs)], "artifact_ord string, artifact_path string, content binary")
    got = {}
    for r in S.fragments(df).collect():
        got.setdefault(int(r.artifact_path), []).append((r.byte_offset // 1024, r.kind_ord, r.byte_offset, r.raw_line))
    assert {k: sorted(v) for k, v in got.items()} == {k: p for k, b in enumerate(blobs) if (p := plain_runs(b, 1024))}
    whole = S.fragments(df, exact_chunks=False).filter("kind_ord = 0").count()
    assert whole == sum(len(re.findall(rb"[\x20-\x7e]{4,}", b)) for b in blobs)


def test_decoding_chain(spark):
    blobs = [b"plain", "é".encode(), b"caf\xe9 \x80", b"\x81", b"\xef\xbb\xbfx", b"\xef\xbb\xbf\xff", b"", bytes(range(256))]
    df = column(spark, [bytearray(b) for b in blobs], "binary")
    got = run(df, T.encoding_of(F.col("v"), F.lit(False)))
    assert [(g.encoding, g.ok) for g in got] == [("utf-8", True), ("utf-8", True), ("cp1252", True), ("latin-1", True), ("utf-8-sig", True), ("utf-8-sig", False), ("utf-8", True), ("latin-1", True)]
    assert run(df.filter("i = 2"), T.decoded(F.col("v"), F.lit("cp1252"), F.lit(None))) == ["café €"]


def test_numbering_is_total(spark):
    rows = [(f"a{k % 7}", 0, 0, k // 7, k % 3) for k in range(500)]
    df = spark.createDataFrame(rows, "artifact_ord string, chunk_no long, kind_ord int, pos long, rule_ord int").repartition(6)
    out = S.numbered(df).orderBy("hit_no").collect()
    assert [r.hit_no for r in out] == list(range(1, 501)) and [tuple(r)[:5] for r in out] == sorted(rows) and out[-1].hit_id == "H000500"
    assert S.numbered(df.limit(0)).count() == 0


# --- reports and command line


@pytest.fixture(scope="module")
def reports(spark, tmp_path_factory):
    d, out = tmp_path_factory.mktemp("in"), tmp_path_factory.mktemp("out")
    (d / "sql.log").write_text('ok\nExecution Timeout Expired <b> "q"\nlast\n')
    (d / "trace.bt9").write_text("Server Communication\nSession:  Inactive\n")
    (d / "blob.bin").write_bytes(b"\x00\xff\x00 denied here\x00")
    messages = []
    return api.run_scan(spark, [str(d)], str(out), api.Options(progress=messages.append)), d, messages


def test_all_reports(reports):
    result, d, messages = reports
    assert all((result.output / n).is_file() for n in sinks.REPORTS) and len(messages) == 4 and (result.output / api.LOG_FILE).read_text()
    raw = (result.output / "all_hits.csv").read_bytes()
    rows = list(csv.DictReader(raw.decode().splitlines(keepends=True)))
    assert raw.count(b"\r\n") == len(rows) + 1 and list(rows[0]) == list(api.HIT_COLUMNS) and rows[0]["hit_id"] == "H000001"
    assert {r["raw_line"] for r in rows} >= {'Execution Timeout Expired <b> "q"', " denied here"} and len(rows) == result.hit_count
    cover = list(csv.DictReader((result.output / "artifact_coverage.csv").open(newline="")))
    assert [r["artifact_path"] for r in cover] == [f"{d}/{n}" for n in ("blob.bin", "sql.log", "trace.bt9")] and cover[1]["decoded_successfully"] == "True" and cover[0]["line_numbers_supported"] == "False"
    assert sum(result.severities.values()) == result.hit_count and result.severities["high"] == 1 and result.scanned_count == 3


def test_text_and_html(reports):
    result, _, _ = reports
    text, page = result.report("triage_report.txt").read_text(), result.report("triage_report.html").read_text()
    heads = ["Scan summary", "Product detected", "Artifacts reviewed", "Artifacts not decoded", *[f"{s} findings" for s in fixed.SEVERITIES], "Missing evidence", "Negative searches", "KB candidates", "False-positive cautions", "Raw hit appendix", "Limitations"]
    at = [text.index(f"\n{h}\n{'-' * len(h)}\n") for h in heads]
    assert at == sorted(at) and [page.index(f"<h2>{h}</h2>") for h in heads] == sorted(page.index(f"<h2>{h}</h2>") for h in heads)
    assert "Execution Timeout Expired &lt;b&gt; &quot;q&quot;" in page and "<b> &quot;" not in page
    assert "KB candidate 291435: Database timeout expired" in text and "- APPC_SQL_TIMEOUT" in text and "- No GetSslError found" in text
    items = result.report("missing_evidence_checklist.txt").read_text()
    assert items.startswith("Missing Evidence Checklist\n====") and "- [observed] trace.bt9" in items and "- [missing] dascli status" in items and items.count("- [") == 26


def test_records_in_a_folder(spark, tmp_path):
    df = spark.createDataFrame([(True, 'a"b', None), (False, "x\ny", 3)], "b boolean, s string, n long")
    sinks.write_csv_folder(df.coalesce(1), ["b", "s", "n"], str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_bytes() == b'"True","a""b",""\r\n"False","x\ny","3"\r\n'


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    assert cli.main([]) == 1 and cli.HELP in capsys.readouterr().out
    with pytest.raises(SystemExit) as e:
        cli.main(["--nope"])
    assert e.value.code == 1 and cli.HELP in capsys.readouterr().err
    (tmp_path / "a.log").write_text("error\n")
    assert cli.main([str(tmp_path / "a.log"), "--output", str(tmp_path / "o1")], spark) == 0
    said = capsys.readouterr().out
    assert "Files discovered: 1" in said and "Findings count: 1" in said and "Detected case number: UNKNOWN" in said
    monkeypatch.setattr("sys.stdin", io.StringIO("\n"))
    assert cli.main([str(tmp_path / "a.log"), str(tmp_path / "gone.log"), "--output", str(tmp_path / "o2"), "--pause"], spark) == 2
    assert "WARNING: " in capsys.readouterr().out
    monkeypatch.setattr(api, "run_scan", lambda *a: 1 / 0)
    assert cli.main([str(tmp_path / "a.log"), "--output", str(tmp_path / "o3")], spark) == 1


def test_output_names(tmp_path, monkeypatch):
    monkeypatch.setenv("USERPROFILE", str(tmp_path))
    from datetime import datetime

    now = datetime(2024, 1, 2, 3, 4, 5)
    first = cli.default_output("60114450", now)
    assert first == tmp_path / "Desktop" / "stratalog" / "Case-60114450-scan-20240102-030405"
    first.mkdir(parents=True)
    (first / "x").touch()
    assert cli.default_output("60114450", now).name.endswith("-1")
    assert api.new_workspace(str(tmp_path)) != api.new_workspace(str(tmp_path))


def test_case_numbers(spark, tmp_path):
    (tmp_path / "60114450").mkdir()
    (tmp_path / "60114450" / "a.log").touch()
    assert casenum.detect([str(tmp_path / "60114450")]) == ("60114450", [])
    two = [str(tmp_path / "60000001.log"), str(tmp_path / "60000002.log")]
    assert casenum.detect(two) == ("60000001", ["Multiple possible case numbers found; selected 60000001."])
    assert casenum.detect(["x160114450", "601144501"]) == ("UNKNOWN", [])
    assert run(column(spark, ["Case Number: 60000001, case # 60000002 CASE-60000003 case 60000004 case 6000"]), casenum.in_text(F.col("v"))) == [["60000001", "60000002", "60000003", "60000004"]]
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b")], "ord long, case_number string")
    assert tuple(casenum.most_common(df).first()) == ("b", True) and tuple(casenum.most_common(df.filter("ord > 1")).first()) == ("a", False) and casenum.most_common(df.limit(0)).count() == 0


def test_limits_file(tmp_path):
    (tmp_path / "c.json").write_text('{"extraction": {"max_archive_depth": 2}}')
    assert api.limits_from(str(tmp_path / "c.json")).max_archive_depth == 2 and api.limits_from(None).max_archive_depth == 5


# --- streams and registered queries


def test_drop_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"a{k}.log").write_text("error\nok\n")
        dropfolder.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    hits = spark.read.parquet(str(tmp_path / "out/hits"))
    assert hits.count() == 2 and hits.select("artifact_path").distinct().count() == 2


def test_archives_in_the_drop_folder(spark, tmp_path):
    from tests.test_files import NONE, make_zip

    (tmp_path / "in").mkdir()
    for k in range(2):
        inner = make_zip({"deep.log": b"dns down\n"})
        (tmp_path / "in" / f"b{k}.zip").write_bytes(make_zip({f"a{k}.log": b"error\nok\n", "inner.zip": inner, "../up.log": b"x"}))
        dropfolder.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), tools=NONE).awaitTermination(120)
    hits = spark.read.parquet(str(tmp_path / "out/hits")).collect()
    assert sorted(h.matched_text for h in hits) == ["dns", "dns", "error", "error"] and len({h.hit_id for h in hits}) == 4
    cover = spark.read.parquet(str(tmp_path / "out/coverage"))
    assert cover.filter("decoder_status = 'unsafe-archive-path-refused'").count() == 2 and cover.filter("extracted_from <> ''").count() == 8


def test_samples_match_their_patterns():
    from stratalog.plans import views

    pack, samples = R.built_in(), iter(views.SAMPLES)
    assert all(re.search(p, next(samples), re.I) for r in pack.rules for p in r.patterns) and all(t in next(samples) for t in pack.terms)


def test_windowed_hits(spark):
    rows = [("2024-01-01 00:10:00", "error"), ("2024-01-01 00:50:00", "ERROR timeout"), ("2024-01-01 01:10:00", "ok"), ("2024-01-01 02:10:00", "dns")]
    df = spark.createDataFrame(rows, "t string, raw_line string").select(F.to_timestamp("t").alias("ts"), "raw_line")
    out = dropfolder.windowed_hits(df, R.built_in()).orderBy("window_start").collect()
    assert [(r.window_start.hour, r.hit_count) for r in out] == [(0, 3), (2, 1)]


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL) and registry.FLAGSHIP in registry.QUERIES
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_equal_sql(spark, name):
    import os
    from collections import Counter

    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"create view {f.split('.')[0]} as select * from '{d}/{f}'")
    want = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    df = registry.QUERIES[name](spark, d)
    assert sorted(df.columns) == sorted(names)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(want.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython", plan)


def test_scans_read_what_they_need(spark):
    plan = registry.QUERIES["keyword_hits"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lang" not in plan and "n_chars" not in plan
    plan = registry.QUERIES["coverage_dedup_last"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan


def test_large_logs_in_splits(spark, tmp_path):
    rnd = random.Random(4)
    want = {}
    for name in ("a.log", "b.log"):
        lines = [rnd.choice(["ok", "error here", "", "é timeout", "x" * 200]) for _ in range(4000)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        want[name] = [(k + 1, x) for k, x in enumerate(lines) if "error" in x or "timeout" in x]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        got = {}
        for r in api.scan_large_logs(spark, str(tmp_path)).orderBy("hit_no").collect():
            got.setdefault(r.artifact_path.rsplit("/", 1)[-1], []).append((r.line_number, r.raw_line))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == want

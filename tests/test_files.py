"""Scans of small files and archives, end to end over the frames."""

import io
import stat
import tarfile
import zipfile

import pytest

from stratalog import api, fixed
from stratalog.operators import findings as G
from stratalog.sources.artifacts import Limits
from stratalog.sources.decoders import Tools

SMALL = Limits(5, 10 * 2**20, 2**20)
NONE = Tools("", "", "", "", "")


def make_zip(members: dict, path=None, flag_encrypted=(), links=()) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            info = zipfile.ZipInfo(name)
            if name in links:
                info.external_attr = (stat.S_IFLNK | 0o777) << 16
            z.writestr(info, data)
    data = bytearray(out.getvalue())
    if flag_encrypted:
        with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
            for i in z.infolist():
                if i.filename in flag_encrypted:
                    data[i.header_offset + 6] |= 1
            at = data.find(b"PK\x01\x02")
            while at >= 0:
                n = int.from_bytes(data[at + 28 : at + 30], "little")
                if data[at + 46 : at + 46 + n].decode() in flag_encrypted:
                    data[at + 8] |= 1
                at = data.find(b"PK\x01\x02", at + 4)
    return bytes(data)


def make_tar(members: dict, mode="w", links=()) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        for name in links:
            info = tarfile.TarInfo(name)
            info.type, info.linkname = tarfile.SYMTYPE, "x"
            t.addfile(info)
    return out.getvalue()


@pytest.fixture(scope="module")
def bundle(spark, tmp_path_factory):
    """One scan of one folder with all small cases, looked at by many tests."""
    d = tmp_path_factory.mktemp("bundle")
    files = {
        "sensor.log": b"startup ok\nerror connecting to proxy\nfinished\n",
        "utf16.log": "first\nfailed service start\n".encode("utf-16"),
        "malformed.log": b"good\nerror \x81 here\nend\n",
        "cp1252.log": b"caf\xe9 error\n",
        "bom8.log": b"\xef\xbb\xbferror first\r\nsecond\rthird",
        "badbom.log": b"\xef\xbb\xbferror \xff\n",
        "badwide.log": b"\xff\xfeA\x00\x00\xd8",
        "payload.bin": b"\x00\x01prefix services.bit9.com timeout suffix\x00\xff",
        "wide.bin": b"\x00\x00\xff" + "access denied".encode("utf-16-le") + b"\xff\x00\x01",
        "silent.bin": b"\x00\x01\x02",
        "context.log": b"one\ntwo\nblocked by policy\nfour\nfive\nsix\n",
        "reporter.log": b"ReporterService start\nAntibodyMetadataLookup metadata lookup failed\nExecution Timeout Expired while waiting\n",
        "trace.bt9": b"Server Communication\nGetSslError[16] CERT_CN_INVALID\n",
        "analysis.txt": b"CB Analysis Script\nSchema x\nCannot find the server principal\n",
        "empty.txt": b"",
        "data.json": b' {"a": [1, 2]}',
        "almost.json": b'{"a":1} x',
        "big.dat": b"[" + b"1," * 3000 + b"1]",
        "page.dat": b"  <!DOCTYPE HTML><p>x",
        "event.dat": b"<Event a='b'/>",
        "photo.JPG": b"\xff\xd8\xff",
        "noname": b"plain words\n",
        "capture.pcapng": b"\x0a\x0d\x0d\x0a dns query \x00",
        "bundle.7z": b"7z\xbc\xaf\x27\x1c\x00",
        "my StandardReport.pdf": b"%PDF-1.4\x00",
        "bad.zip": b"not a zip \xff\xff",
        "logs.zip": make_zip({"logs/app.log": b"error inside\n", "../evil.txt": b"x", "C:/drive.txt": b"x", "/abs.txt": b"x"}),
        "outer.zip": make_zip({"inner.zip": make_zip({"nested/result.json": b'{"status": "failed"}'})}),
        "mixed.zip": make_zip({"locked.log": b"secret", "open.log": b"crash\n"}, flag_encrypted=("locked.log",)),
        "links.zip": make_zip({"link": b"target", "ok.log": b"fine\n"}, links=("link",)),
        "pack.tgz": make_tar({"a/tls.log": b"tls down\n", "../up.log": b"x"}, "w:gz", links=("ln",)),
        "same1.zip": make_zip({"s.log": b"dns\n"}),
        "same2.zip": make_zip({"s.log": b"dns\n"}),
        "huge.zip": make_zip({"huge.log": b"a" * (2**20 + 1), "tiny.log": b"t\n"}),
        "chunk.bin": b"\xff\x00" + b"\x00" * (2**20 - 2 - 10) + b"error long run across" + b"\x00\x81",
    }
    for name, data in files.items():
        (d / name).write_bytes(data)
    (d / "zsub").mkdir()
    (d / "zsub" / "deep.err").write_bytes(b"Kernel assertions FailureId[778]\n")
    (d / "linked.log").symlink_to(d / "sensor.log")
    out = tmp_path_factory.mktemp("out")
    frames = api.scan(spark, [str(d), str(d / "missing.log")], str(out), api.Options(limits=SMALL, tools=NONE))
    cover = {}
    for r in frames.coverage.orderBy("artifact_ord").collect():
        cover.setdefault(r.artifact_path.replace(str(d) + "/", "").replace(str(out) + "/", ""), []).append(r)
    hits = [r for r in frames.hits.orderBy("hit_no").collect()]
    return d, out, cover, hits, frames


def of(bundle, name):
    d, out, _, hits, _ = bundle
    return [h for h in hits if h.artifact_path in (f"{d}/{name}", f"{out}/{name}")]


def terms(bundle, name):
    return [(h.matched_text, h.line_number) for h in of(bundle, name) if h.rule_id == fixed.GENERIC_RULE]


def one(bundle, name):
    return bundle[2][name][-1]


def test_lines_and_encodings(bundle):
    assert terms(bundle, "sensor.log") == [("error", 2), ("proxy", 2)]
    r = one(bundle, "sensor.log")
    assert (r.encoding, r.lines_or_rows_scanned, r.review_mode, r.decoded_successfully, r.decoder_status) == ("utf-8", 3, "stream-scanned", True, "scanned")
    assert terms(bundle, "utf16.log") == [("failed", 2)] and one(bundle, "utf16.log").encoding == "utf-16"
    assert terms(bundle, "malformed.log") == [("error", 2)] and one(bundle, "malformed.log").encoding == "latin-1"
    assert one(bundle, "cp1252.log").encoding == "cp1252" and of(bundle, "cp1252.log")[0].raw_line == "café error"
    assert one(bundle, "bom8.log").encoding == "utf-8-sig" and one(bundle, "bom8.log").lines_or_rows_scanned == 3
    assert of(bundle, "bom8.log")[0].raw_line == "error first" and of(bundle, "bom8.log")[0].context_after == "second\nthird"
    assert one(bundle, "empty.txt").lines_or_rows_scanned == 0


def test_broken_marked_encodings(bundle):
    for name, enc in (("badbom.log", "utf-8-sig"), ("badwide.log", "utf-16")):
        r = one(bundle, name)
        assert (r.review_mode, r.decoder_status, r.encoding, r.decoded_successfully) == ("unreadable", "decode-failed", enc, False)
        assert r.limitations.startswith(f"Text decode failed with {enc}: ") and not of(bundle, name)


def test_binary_runs(bundle):
    h = of(bundle, "payload.bin")
    assert [(x.matched_text, x.byte_offset, x.match_type) for x in h] == [("timeout", 2, "ascii-string"), ("services.bit9.com", 2, "ascii-string")]
    r = one(bundle, "payload.bin")
    assert (r.artifact_family, r.bytes_scanned, r.encoding, r.lines_or_rows_scanned) == ("opaque_binary", 41 + 2, "binary", 1)
    w = of(bundle, "wide.bin")
    assert [(x.matched_text, x.byte_offset, x.match_type, x.raw_line) for x in w] == [("access denied", 3, "utf-16le-string", "access denied"), ("denied", 3, "utf-16le-string", "access denied")]
    assert one(bundle, "silent.bin").limitations == fixed.LIMIT_NO_STRINGS
    assert [h.raw_line for h in of(bundle, "chunk.bin")] == ["error long"]  # the rest lies beyond the chunk


def test_context(bundle):
    h = of(bundle, "context.log")[0]
    assert (h.line_number, h.context_before, h.context_after) == (3, "one\ntwo", "four\nfive")


def test_rules(bundle):
    by = lambda n: {h.rule_id: h for h in of(bundle, n)}
    assert by("reporter.log")["APPC_SQL_TIMEOUT"].severity == "High" and by("reporter.log")["APPC_SQL_TIMEOUT"].kb_candidate_ids == "KB candidate 291435"
    assert by("trace.bt9")["APPC_CERT_CN_MISMATCH"].component == "Agent TLS"
    assert "APPC_SQL_ROLE_DSN_APPCWEBSERVER" in by("analysis.txt")
    assert by("zsub/deep.err")["APPC_KERNEL_ASSERTION"].severity == "Low"
    assert [h.rule_id for h in of(bundle, "zsub/deep.err")] == ["APPC_KERNEL_ASSERTION", fixed.GENERIC_RULE, fixed.GENERIC_RULE]


def test_families(bundle):
    want = {
        "reporter.log": ("reporter_log", "content:app-control-marker"), "trace.bt9": ("agent_trace_bt9", "content:app-control-marker"), "analysis.txt": ("cb_analysis_output", "content:app-control-marker"),
        "data.json": ("json", "content:json"), "almost.json": ("json", "extension:.json"), "big.dat": ("text_log", "content:text"), "page.dat": ("html", "content:html"), "event.dat": ("xml", "content:xml"),
        "photo.JPG": ("image_metadata_only", "extension:.jpg"), "noname": ("text_log", "content:text"), "bad.zip": ("zip", "extension:.zip"), "logs.zip": ("zip", "content:zipfile"), "pack.tgz": ("tar", "content:tarfile"),
        "my StandardReport.pdf": ("standard_report_pdf", "extension:.pdf:name:standard-report"), "sensor.log": ("text_log", "extension:.log"),
    }
    for name, (family, by) in want.items():
        r = bundle[2][name][0]
        assert (r.artifact_family, r.identified_by) == (family, by), name


def test_archives(bundle):
    cover = bundle[2]
    for bad in ("../evil.txt", "C:/drive.txt", "/abs.txt"):
        r = cover[f"logs.zip!{bad}"][0]
        assert (r.decoder_status, r.identified_by, r.limitations) == ("unsafe-archive-path-refused", "archive-member:safety-check", fixed.LIMIT_UNSAFE_PATH)
    names = [n for n in cover if n.startswith("extracted/")]
    assert any(n.endswith("logs/app.log") for n in names) and any(n.endswith("nested/result.json") for n in names)
    assert cover["mixed.zip!locked.log"][0].decoder_status == "password-required" and cover["mixed.zip"][0].decoder_status == "extracted-with-limitations"
    assert cover["links.zip!link"][0].limitations == fixed.LIMIT_ZIP_LINK
    assert cover["pack.tgz!ln"][0].limitations == fixed.LIMIT_TAR_LINK and cover["pack.tgz!../up.log"][0].limitations == fixed.LIMIT_UNSAFE_PATH
    assert [r.decoder_status for r in cover["same2.zip"]] == ["archive-detected", "archive-loop-detected"] and len(cover["same1.zip"]) == 1
    assert cover["huge.zip!huge.log"][0].limitations == f"File exceeds max_single_file_bytes ({2**20})."
    inner = next(n for n in names if n.endswith("inner.zip"))
    child = cover[next(n for n in names if n.endswith("result.json"))][0]
    assert child.extracted_from.endswith(inner)
    kids = {r.artifact_path: r.parent_family for r in G.lineage(bundle[4].coverage).collect()}
    assert kids[child.artifact_path] == "zip"


def test_policy_rows(bundle):
    assert one(bundle, "linked.log").decoder_status == "skipped-symlink-input"
    assert (one(bundle, "missing.log").review_mode, one(bundle, "missing.log").limitations) == ("unreadable", fixed.LIMIT_MISSING)


def test_tools_missing(bundle):
    r = one(bundle, "capture.pcapng")
    assert (r.review_mode, r.decoder_status, r.decoder_used) == ("binary-string-scanned", "specialized-tool-unavailable", "tshark") and terms(bundle, "capture.pcapng") == [("dns", None)]
    assert (one(bundle, "bundle.7z").review_mode, one(bundle, "bundle.7z").decoder_used) == ("specialized-tool-unavailable", "7zip")


def test_order_and_ids(bundle):
    hits = bundle[3]
    assert [h.hit_id for h in hits] == [f"H{k + 1:06d}" for k in range(len(hits))]
    assert [(h.artifact_ord, h.pos) for h in hits] == sorted((h.artifact_ord, h.pos) for h in hits)
    paths = [r.artifact_path for r in bundle[4].coverage.orderBy("artifact_ord").collect()]
    assert paths.index(f"{bundle[0]}/zsub/deep.err") > paths.index(f"{bundle[0]}/wide.bin")


def test_findings(bundle):
    frames = bundle[4]
    by_rule = frames.by_rule.collect()
    assert [r.rule_id for r in by_rule][-1] == fixed.GENERIC_RULE and by_rule[0].severity == "High"
    hits = bundle[3]
    for r in by_rule:
        own = [h for h in hits if h.rule_id == r.rule_id]
        assert r.hit_count == len(own) and r.first_seen_file == own[0].artifact_path and r.artifacts_hit == ";".join(sorted({h.artifact_path for h in own}))
        assert r.first_seen_line == str(own[0].line_number if own[0].line_number is not None else own[0].byte_offset)
    files = {r.artifact_path: r for r in frames.by_file.collect()}
    assert files[f"{bundle[0]}/empty.txt"].hit_count == 0 and files[f"{bundle[0]}/same2.zip"].artifact_family == "unknown"
    assert sum(r.hit_count for r in files.values()) == len(hits)
    assert {r.kb_id for r in G.kb_list(frames.hits, frames.pack).collect()} >= {"291435", "288544"}


def test_negative_searches_and_checklist(bundle):
    told = [r.message for r in G.negative_searches(bundle[4].coverage).collect()]
    assert "No SQLTrace found" in told and "No GetSslError found" not in told and "No GetWinHttpError found" in told
    assert "No trace.bt9 found" not in told and "No ReporterLog found" not in told
    items = {(r.family, r.item): r.observed for r in G.checklist(bundle[4].coverage, bundle[4].hits).collect()}
    assert items["Disconnected agent missing evidence", "trace.bt9"] and not items["Disconnected agent missing evidence", "dascli status"]
    assert items["Upgrade missing evidence", "Reporter startup output"]  # a tar was seen


def test_depth_and_budget(spark, tmp_path):
    data = b"error\n"
    for _ in range(4):
        data = make_zip({"n.zip" if data[:2] == b"PK" else "x.log": data})
    (tmp_path / "deep.zip").write_bytes(data)
    frames = api.scan(spark, [str(tmp_path / "deep.zip")], str(tmp_path / "o"), api.Options(limits=Limits(2, 10**6, 10**6), tools=NONE))
    last = frames.coverage.orderBy("artifact_ord").collect()[-1]
    assert (last.identified_by, last.limitations) == ("policy:max_archive_depth", "Maximum archive depth 2 reached.")
    (tmp_path / "sum.zip").write_bytes(make_zip({"a.log": b"a" * 60, "b.log": b"b" * 60, "c.log": b"c" * 30}))
    frames = api.scan(spark, [str(tmp_path / "sum.zip")], str(tmp_path / "o"), api.Options(limits=Limits(5, 100, 100), tools=NONE))
    got = {r.artifact_path.rsplit("/", 1)[-1]: r.decoder_status for r in frames.coverage.collect()}
    assert got["sum.zip!b.log"] == "unsafe-archive-path-refused" and got["c.log"] == "scanned" and got["a.log"] == "scanned"


def test_same_input_twice_and_no_hits(spark, tmp_path):
    (tmp_path / "quiet.log").write_text("nothing here\n")
    frames = api.scan(spark, [str(tmp_path / "quiet.log")] * 2, str(tmp_path / "o"), api.Options(tools=NONE))
    assert frames.coverage.count() == 2 and frames.by_file.count() == 1 and frames.hits.count() == 0
    assert G.scan_summary(frames.hits).first().product == "Unknown"


def test_decoded_capture_is_scanned(spark, tmp_path):
    (tmp_path / "net.pcap").write_bytes(b"\xd4\xc3\xb2\xa1\x00")
    rows = "frame.number,ip.src,dns.qry.name\n1,10.0.0.1,error.example\n"
    frames = api.scan(spark, [str(tmp_path / "net.pcap")], str(tmp_path / "o"), api.Options(tools=Tools("tshark", "", "", "", "", execute=lambda c: (0, rows))))
    parent, child = frames.coverage.orderBy("artifact_ord").collect()
    assert (parent.decoder_status, parent.review_mode, parent.decoded_successfully) == ("decoded", "metadata-only", True)
    assert child.artifact_family == "csv" and child.artifact_path.endswith("decoded/pcap_000001.csv") and child.extracted_from == parent.artifact_path
    assert [h.line_number for h in frames.hits.filter("matched_text = 'error'").collect()] == [2]


@pytest.mark.parametrize(("name", "field", "listing", "status"), [
    ("b.7z", "seven_zip", (1, ""), "decode-failed"), ("b.7z", "seven_zip", (0, "Path = ..\\up.txt\n"), "skipped-by-policy"), ("b.cab", "expand", (1, ""), "decode-failed"),
    ("b.evtx", "wevtutil", (2, ""), "decode-failed"), ("b.etl", "tracerpt", (1, ""), "decode-failed"),
])
def test_tools_that_fail(spark, tmp_path, name, field, listing, status):
    (tmp_path / name).write_bytes(b"\x00\x01 error text \x00")
    tools = Tools(**({k: "" for k in ("tshark", "seven_zip", "expand", "wevtutil", "tracerpt")} | {field: "tool"}), execute=lambda c: listing)
    frames = api.scan(spark, [str(tmp_path / name)], str(tmp_path / "o"), api.Options(tools=tools))
    (row,) = frames.coverage.collect()
    assert row.decoder_status == status and not (row.decoder_status == "decode-failed" and row.decoded_successfully and field != "tracerpt")

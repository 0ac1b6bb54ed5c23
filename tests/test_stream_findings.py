"""Findings kept up over the batches of a drop folder."""

from stratalog.api import scan_frames
from stratalog.functions.rules import built_in
from stratalog.operators import findings as G
from stratalog.sources.artifacts import expanded
from stratalog.streaming import dropfolder

from .test_files import NONE, make_zip


def rows(df):
    return list(map(tuple, df.collect()))


def test_batches_merge_to_one_scan(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    batches = [
        {"c.log": b"error\nExecution Timeout Expired for AntibodiesGUI\n", "a.zip": make_zip({"x.log": b"dns down\n", "../up": b"x"})},
        {"b.log": b"Execution Timeout Expired\nExecution Timeout Expired\n", "q.7z": b"7z\xbc\xaf\x27\x1c\x00"},
        {"quiet.log": b"fine\n", "A.bt9": b"Server Communication\nGetSslError[16]\n"},
    ]
    for files in batches:
        for name, data in files.items():
            (d / name).write_bytes(data)
        dropfolder.watch(spark, str(d), str(tmp_path / "out"), str(tmp_path / "ck"), tools=NONE).awaitTermination(240)
    files = spark.read.format("binaryFile").load(str(d))
    frames = scan_frames(expanded(files, str(d), tools=NONE), built_in())
    found = dropfolder.findings(spark, str(tmp_path / "out"))
    assert rows(found.by_rule) == rows(frames.by_rule) and len(rows(found.by_rule)) >= 3
    assert rows(found.by_file) == rows(frames.by_file)
    assert rows(found.warnings) == rows(G.warnings(frames.coverage)) and rows(found.warnings)


def test_archives_of_earlier_batches_are_remembered(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    data = make_zip({"x.log": b"dns down\n", "in.zip": make_zip({"deep.log": b"error\n"})})
    for files in ({"a.zip": data}, {"b.zip": data, "c.zip": make_zip({"again.zip": make_zip({"deep.log": b"error\n"}), "new.log": b"error\n"})}):
        for name, content in files.items():
            (d / name).write_bytes(content)
        dropfolder.watch(spark, str(d), str(tmp_path / "out"), str(tmp_path / "ck"), tools=NONE, remember=True).awaitTermination(240)
    cover = spark.read.parquet(str(tmp_path / "out/coverage")).filter("decoder_status = 'archive-loop-detected'").orderBy("artifact_ord").collect()
    assert [r.artifact_path.rsplit("/", 1)[-1] for r in cover] == ["b.zip", "again.zip"]
    hits = spark.read.parquet(str(tmp_path / "out/hits")).collect()
    assert sorted(h.matched_text for h in hits) == ["dns", "error", "error"]
    assert spark.read.parquet(str(tmp_path / "out/archives")).count() == 3

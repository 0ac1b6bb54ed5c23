"""Archives expanded in parallel against the walk that opens one after another; budgets by parts against one fold."""

import bisect
import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from stratalog.operators import ordered
from stratalog.sources import bundles
from stratalog.sources.artifacts import Expander, Limits
from stratalog.sources.decoders import Tools

from .test_files import NONE, make_tar, make_zip

SCHEMA = "key string, path string, original string, file_no long, content binary"
FIELDS = ("artifact_path", "original_input_path", "extracted_from", "is_zip", "is_tar", "is_json", "policy", "decoder", "archive_limitations")


def broken(data: bytes) -> bytes:
    """A ZIP file whose first member fails its checksum."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        m = z.infolist()[0]
    at = m.header_offset + 30 + len(m.filename)
    return data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]


def some_file(rnd: random.Random, depth: int, pool: list) -> tuple[str, bytes]:
    """A random file, often an archive, often one that was made before."""
    if pool and rnd.random() < 0.25:
        return rnd.choice(pool)
    kind = rnd.random()
    if depth and kind < 0.55:
        members = {}
        for k in range(rnd.randrange(1, 5)):
            name, data = some_file(rnd, depth - 1, pool)
            members[rnd.choice(("", "d/", "../", "")) + f"{k}{name}"] = data
        if rnd.random() < 0.3:
            out = (f"t{rnd.randrange(99)}.tgz", make_tar(members, "w:gz", links=("ln",)))
        else:
            locked = [n for n in members if rnd.random() < 0.1]
            data = make_zip(members, flag_encrypted=locked, links=[n for n in members if rnd.random() < 0.1])
            out = (f"z{rnd.randrange(99)}{rnd.choice(('.zip', '.bin'))}", broken(data) if rnd.random() < 0.12 and not locked and next(iter(members.values())) else data)
    elif kind < 0.62:
        out = (f"n{rnd.randrange(9)}.zip", b"\xff\x00 no archive" + bytes([rnd.randrange(3)]))
    elif kind < 0.7:
        out = (f"s{rnd.randrange(9)}.7z", b"7z\xbc\xaf\x27\x1c" + bytes([rnd.randrange(3)]))
    else:
        out = (f"l{rnd.randrange(9)}.log", rnd.choice(("error", "fine", "é")).encode() * rnd.randrange(40))
    pool.append(out)
    return out


def unpack(command):
    """Stands for 7-Zip: a listing without bad names, and three files, one of them an archive."""
    if command[1] == "x":
        target = next(c for c in command if c.startswith("-o"))[2:]
        for name, data in (("a.log", b"a" * 30), ("b.zip", make_zip({"in.log": b"b" * 20})), ("c.log", b"c" * 5)):
            with open(os.path.join(target, name), "wb") as f:
                f.write(data)
    return 0, ""


def walked(files, limits, tools):
    walk, out = Expander("/w", limits, tools), []
    for k, (name, data) in enumerate(files):
        walk.prefix, walk.seq, walk.number = f"{k:09d}", 0, k + 1
        out += list(walk.file(name, f"o{k}", "", data, 0))
    return out


def told(row) -> tuple:
    plain = lambda v: tuple(v.values()) if isinstance(v, dict) else tuple(v) if isinstance(v, (list, tuple)) else v
    return tuple(plain(row[f]) for f in FIELDS)


def together(spark, files, limits, tools):
    rows = [(f"{k:09d}", name, f"o{k}", k + 1, data) for k, (name, data) in enumerate(files)]
    found = bundles.expanded_together(spark.createDataFrame(rows, SCHEMA).repartition(3), "/w", limits, tools)
    return found.orderBy("artifact_ord").collect()


@pytest.mark.parametrize("seed", range(3))
def test_random_bundles_expand_like_the_walk(spark, seed):
    rnd = random.Random(seed)
    pool: list = []
    files = [some_file(rnd, 4, pool) for _ in range(14)]
    tools = NONE if seed % 3 else Tools("", "tool", "", "", "", execute=unpack)
    limits = Limits(rnd.choice((2, 3, 5)), (2_000, 10**9, 600, 1_000)[seed], (10**9, 900)[seed % 2])
    want, got = walked(files, limits, tools), together(spark, files, limits, tools)
    assert [told(r.asDict(recursive=True)) for r in got] == [told(r) for r in want]
    for g, w in zip(got, want):
        if w["content"] is not None:
            assert (g.content if not (g.is_zip or g.is_tar) else g.size) == (w["content"] if not (g.is_zip or g.is_tar) else len(w["content"]))
    assert any(r["policy"] for r in want)


def test_copies_of_one_archive_are_opened_once(spark):
    data = b"x" * 50
    for k in range(4):
        data = make_zip({f"{i}.zip" if k else f"{i}.log": data for i in range(6)})
    files = [("a.zip", data), ("b.zip", data)]
    got = together(spark, files, Limits(), NONE)
    assert [told(r.asDict(recursive=True)) for r in got] == [told(r) for r in walked(files, Limits(), NONE)]
    assert sum(r.policy is not None for r in got) == 3 * 5 + 1 and sum(r.artifact_path.endswith(".log") for r in got) == 6


def test_files_on_disk_are_read_by_ranges(spark, tmp_path):
    members = {f"{k:03d}.log": bytes([97 + k % 26]) * (k % 9) for k in range(60)} | {"in.zip": make_zip({"deep.log": b"error"}), "../up": b"x"}
    path = str(tmp_path / "wide.zip")
    (tmp_path / "wide.zip").write_bytes(make_zip(members))
    source = spark.createDataFrame([("000000000", path, "o0", 1, None)], SCHEMA)
    for limits in (Limits(task_bytes=20), Limits(5, 150, 7, task_bytes=50)):
        want = walked([(path, (tmp_path / "wide.zip").read_bytes())], limits, NONE)
        found = bundles.expanded_together(source, "/w", limits, NONE).withColumn("task", F.spark_partition_id())
        got = found.orderBy("artifact_ord").collect()
        assert [told(r.asDict(recursive=True)) for r in got] == [told(r) for r in want] and got[0].size == (tmp_path / "wide.zip").stat().st_size
        assert len(list(bundles._ranges({"kind": "zip", "path": path, "content": None}, limits))) > 4 and len({r.task for r in got}) > 1


def test_no_task_gets_all_archives(spark):
    rows = [(f"{k:09d}", f"{k}.zip", "o", k + 1, make_zip({"a.log": str(k).encode()})) for k in range(40)]
    found = bundles.expanded_together(spark.createDataFrame(rows, SCHEMA).repartition(4), "/w", Limits(), NONE)
    assert found.count() == 80
    assert found.filter("artifact_path like '%.log'").select(F.spark_partition_id()).distinct().count() > 1


def test_nothing_to_expand(spark):
    assert bundles.expanded_together(spark.createDataFrame([], SCHEMA), "/w").count() == 0


def test_transfer_is_the_fold():
    for seed in range(300):
        rnd = random.Random(seed)
        limit, n = rnd.randrange(1, 60), rnd.randrange(12)
        needs = [rnd.randrange(30) for _ in range(n)]
        nets = [x if rnd.random() < 0.8 else 0 for x in needs]
        pieces = ordered.transfer(needs, nets, limit)
        for t in range(limit + 1):
            add = pieces[bisect.bisect_right([a for a, _ in pieces], t) - 1][1]
            assert t + add == ordered.granted(needs, nets, limit, t)[2]


@pytest.mark.parametrize("most", [50_000, 1])
def test_budget_over_parts(spark, most):
    rnd = random.Random(3)
    rows = [(k, n := rnd.randrange(100), n if rnd.random() < 0.9 else 0) for k in range(800)]
    df = spark.createDataFrame(rows, "k long, need long, net long").repartition(5)
    ok, before, _ = ordered.granted([r[1] for r in rows], [r[2] for r in rows], 9_000, 0)
    got = ordered.budgeted(df, ["k"], 9_000, most).orderBy("k").collect()
    assert [r.granted for r in got] == ok and [r.before for r in got] == before and not all(ok)
    assert ordered.budgeted(df.limit(0), ["k"], 10).count() == 0


def test_running_sums(spark):
    df = spark.range(300).repartition(4)
    assert [r.s for r in ordered.running(df, ["id"], {"s": F.col("id")}).orderBy("id").collect()] == [k * (k - 1) // 2 for k in range(300)]


def test_folders_beyond_four_digits_are_named_as_in_sql(spark):
    """From 10,000 archives on the SQL's lpad cuts the number; the queries follow it in both of their path columns."""
    import duckdb

    from stratalog.plans import bundled

    numbers = (1, 9999, 10000, 123456)
    path = lambda n: f"{bundled.ROOT}/extracted/archive-{n:04d}/docs-10000.zip"
    rows = [(path(n), path(n), False, False, None, b"") for n in numbers]
    found = spark.createDataFrame(rows, "artifact_path string, extracted_from string, is_zip boolean, is_tar boolean, policy struct<status:string,limitations:string>, content binary")
    folder = bundled._FOLDER.replace("#n", "n")
    want = sorted(f + "docs-10000.zip" for (f,) in duckdb.sql(f"SELECT {folder} FROM (VALUES {', '.join(f'({n})' for n in numbers)}) t(n)").fetchall())
    got = bundled._rows(found).collect()
    assert sorted(r.artifact_path for r in got) == want == sorted(r.extracted_from for r in got)


def test_contents_are_shuffled_no_more_than_needed(spark, tmp_path):
    """Numbers meet contents where these are, and documents go to their packs in one shuffle."""
    from stratalog.plans import bundled

    def dealt(df):
        return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]

    docs = spark.createDataFrame([(k, f"text {k}") for k in [*range(90), 130, 250]], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    packs = bundled.packs(spark, str(tmp_path))
    assert len(dealt(packs)) == 1 and not dealt(bundles.keyed(packs.localCheckpoint()))
    assert sorted(r.path for r in packs.select("path").collect()) == [f"pack-{k:06d}.zip" for k in (0, 1, 2, 3, 6)]
    names = {r.path: zipfile.ZipFile(io.BytesIO(r.content)).namelist() for r in packs.collect()}
    assert names["pack-000001.zip"] == [f"docs-{k:06d}.{'tgz' if k % 2 else 'zip'}" for k in range(5, 10)] + ["again.zip"]
    assert names["pack-000002.zip"] == ["docs-000010.zip", "docs-000011.tgz", "again.zip"] and names["pack-000003.zip"] == ["docs-000016.zip", "again.zip"] and names["pack-000006.zip"] == ["docs-000031.tgz"]


def test_contents_meet_many_rows(spark, monkeypatch, tmp_path):
    """Where rows are too many to be told to all tasks, contents are dealt, with the same result."""
    from stratalog.plans import bundled

    docs = spark.createDataFrame([(k, f"text {k}") for k in range(100)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted(map(tuple, bundled.archive_members(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(bundles, "TOLD", 0)
    assert sorted(map(tuple, bundled.archive_members(spark, str(tmp_path)).collect())) == want and len(want) > 100

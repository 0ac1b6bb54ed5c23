"""Archives expanded in parallel under one byte budget, as a walk through them one after another would.

The walk is depth first; what it does with a file depends on all before it: the bytes taken from the budget, the
archives seen, the number of archives opened. Here tasks first read every archive and list what is in it (``catalogue``):
a row per member with its size, and the contents of members that are archives themselves, level by level, each content once
however often it occurs. Then the walk is folded over the small rows of the catalogue (``fold``): which occurrence of
an archive comes first, what fits the budget, how many archives were opened before. Last, tasks read the archives once
more and give the artifacts, each knowing what the walk would have known there (``emitted``). Large ZIP files on disk
are read by ranges of members, so one file spreads over many tasks.

The fold is repeated until nothing changes. Whatever happens to a member follows from what happens before it in the
order of the walk, so every round settles at least the first member that was not settled, and in practice nearly all.

A member's place in the walk is its key: the number of the input, then the number of the member in each archive on the way
down, in fixed width; keys sort as the walk goes.
"""

from __future__ import annotations

import hashlib
import io
import os
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..lineage import cut_lineage, release
from ..operators.ordered import budgeted, running
from ..schema import ARTIFACT_SCHEMA
from . import decoders
from .artifacts import BROKEN, PROBE, Limits, Locked, Member, budget_refusal, decodable, directory, named_archive, policy_row, probe, row_of

SOURCE = "key string, path string, original string, file_no long, content binary"
_NODE = "node string, kind string, path string, content binary"
_CHUNK = f"{_NODE}, first long, last long"
_MEMBER = "node string, no long, chunk long, upto long, need long, net long, fault string, said string, child string, child_kind string, shown string, content binary"
_WIDTH = 9
#: Rows without content that are told to all tasks at most.
TOLD = 200_000


def _opened(path: str, content: bytes | None):
    return io.BytesIO(content) if content is not None else open(path, "rb")


def _head(path: str, content: bytes | None, limits: Limits) -> tuple[bytes | None, int]:
    """(content as far as it is kept, size): whole up to ``limits.task_bytes``, else the head; None if the file can't be read."""
    if content is not None:
        return content, len(content)
    try:
        size = os.path.getsize(path)
        with open(path, "rb") as f:
            return f.read() if size <= limits.task_bytes else f.read(PROBE), size
    except OSError:
        return None, 0


def _digest(path: str, content: bytes | None) -> str:
    out = hashlib.sha256()
    with _opened(path, content) as f:
        while part := f.read(1 << 20):
            out.update(part)
    return out.hexdigest()


def node_of(path: str, content: bytes | None, limits: Limits, tools: decoders.Tools) -> tuple[str, str] | None:
    """(node, kind) of a file out of which more may come: zip, tar, named (an archive by name alone) or tool; None for others.

    Archives are known by their content, files for a tool by name and content.
    """
    head, size = _head(path, content, limits)
    if head is None:
        return None
    row = _probed(path, head, size)
    kind = "zip" if row["is_zip"] else "tar" if row["is_tar"] else "named" if named_archive(path, row) else None
    if kind:
        return _digest(path, content), kind
    tool = decodable(path, row)
    if tool and decoders.available(tool, tools):
        return f"{tool}:{os.path.basename(path)}:{_digest(path, content)}", "tool"
    return None


def _probed(path: str, head: bytes, size: int) -> dict:
    """The probe of a file whose content is whole, or of a larger one by its head and what its archive format tells."""
    row = probe(head) | {"content": head}
    if size > len(head):
        try:
            row["is_zip"] = zipfile.is_zipfile(path)
            row["is_tar"] = not row["is_zip"] and tarfile.is_tarfile(path)
        except BROKEN:
            row["is_tar"] = False
    return row


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some megabytes of content."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r.get("content") or b"") + 200
        if size > most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt over all tasks: its rows are small, what is read for each is not, so their number must not be adapted to their size."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism), *by)


def _told(df: DataFrame) -> DataFrame:
    """Small rows for a join with contents: told to all tasks as long as they are few, so that contents are not shuffled."""
    return F.broadcast(df) if df.count() <= TOLD else df


def _map(df: DataFrame, f, schema: str) -> DataFrame:
    """``f`` of each row as a dict gives rows of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        yield from _batches((out for b in batches for i in range(b.num_rows) for out in f(b.slice(i, 1).to_pylist()[0])), arrow)

    return df.mapInArrow(run, schema)


def _ranges(node: dict, limits: Limits) -> Iterator[dict]:
    """One row for each range of members of a ZIP file on disk, one for anything else."""
    cuts = [0]
    if node["kind"] == "zip" and node["content"] is None:
        try:
            with open(node["path"], "rb") as f:
                held = 0
                for m in directory(f, True):
                    if held and held + m.size > limits.task_bytes:
                        cuts.append(m.no)
                        held = 0
                    held += m.size
        except BROKEN:
            cuts = [0]
    for a, b in zip(cuts, [*cuts[1:], None]):
        yield node | {"first": a, "last": (1 << 62) if b is None else b - 1}


def _listed(chunk: dict, limits: Limits, tools: decoders.Tools) -> Iterator[dict]:
    """The members of a range that ask for bytes of the budget, with the contents of those out of which more may come."""
    base = {"node": chunk["node"], "chunk": chunk["first"], "upto": chunk["last"], "fault": None, "said": None, "child": None, "child_kind": None, "shown": None, "content": None}

    def child(path: str, shown: str, data: bytes) -> dict:
        found = node_of(path, data, limits, tools)
        return {"child": found[0], "child_kind": found[1], "shown": shown, "content": data} if found else {}

    if chunk["kind"] == "tool":
        sizes: list[int] = []
        _, found = decoders.decode(chunk["node"].split(":", 1)[0], chunk["path"], chunk["content"] if chunk["content"] is not None else _head(chunk["path"], None, limits)[0], "\0", "\1", tools, lambda size: sizes.append(size))
        for k, (shown, data) in enumerate(found):
            size = sizes[k] if sizes else 0
            if size <= limits.max_single_file_bytes:
                yield base | {"no": k, "need": size, "net": size} | child(shown, shown, data)
        return
    if chunk["kind"] == "named":
        return
    m = None
    try:
        with _opened(chunk["path"], chunk["content"]) as f:
            for m in directory(f, chunk["kind"] == "zip"):
                if m.no < chunk["first"] or m.refusal or m.locked or m.size > limits.max_single_file_bytes:
                    continue
                if m.no > chunk["last"]:
                    break
                row = base | {"no": m.no, "need": m.size, "net": m.size}
                try:
                    data = m.read()
                except Locked:
                    yield row | {"net": 0, "fault": "locked"}
                except BROKEN as e:
                    yield row | {"fault": "broken", "said": str(e)}
                else:
                    yield row | ({"fault": "unread"} if data is None else child(m.target, m.target, data))
    except BROKEN as e:
        if chunk["first"] == 0 and (m is None or chunk["kind"] == "tar"):
            yield base | {"no": -1, "need": 0, "net": 0, "fault": "broken", "said": str(e)}


def catalogue(sources: DataFrame, limits: Limits, tools: decoders.Tools) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(tops, members, contents): the sources that are nodes, the members of all nodes, and once for every node its content or the path it is ``at``.

    Every node is read once, at the level where it is first met. Archives no deeper than the depth limit are listed; what is at
    the limit is known by its node and not opened. None if no source is a node.
    """

    def top(r):
        if found := node_of(r["path"], r["content"], limits, tools):
            yield {k: r[k] for k in ("key", "path", "original", "file_no")} | {"node": found[0], "kind": found[1]}

    tops = cut_lineage(_map(sources, top, "key string, path string, original string, file_no long, node string, kind string"))
    if tops.isEmpty():
        return None
    first = cut_lineage(tops.groupBy("node").agg(F.min(F.struct("key", "kind", "path")).alias("x")).select("node", "x.kind", "x.path", "x.key"))
    frontier = sources.select("key", "content").join(_told(first), "key").select("node", "kind", "path", "content")
    release(sources.sparkSession)  # of what made the sources
    known, members, depth = None, [], 0
    contents = [frontier.select("node", "content", F.col("path").alias("at"))]
    while True:
        chunks = _map(frontier, lambda n: _ranges(n, limits), _CHUNK)
        found = cut_lineage(_map(_dealt(chunks, "node", "first"), lambda c: _listed(c, limits, tools), _MEMBER))
        members.append(cut_lineage(found.drop("content")))  # else the contents of all levels stay stored beside the frontiers
        nodes = frontier.select("node")
        known = cut_lineage(nodes if known is None else known.unionByName(nodes))
        chunks = nodes = frontier = None
        release(sources.sparkSession)
        kids = found.filter("child is not null")
        chosen = members[-1].filter("child is not null").groupBy("child").agg(F.min(F.struct("node", "no")).alias("x")).join(known.withColumnRenamed("node", "child"), "child", "left_anti").select("x.node", "x.no")
        frontier = cut_lineage(kids.join(_told(cut_lineage(chosen)), ["node", "no"], "left_semi").select(F.col("child").alias("node"), F.col("child_kind").alias("kind"), F.col("shown").alias("path"), "content"))
        found = kids = chosen = None
        release(sources.sparkSession)
        depth += 1
        contents.append(frontier.select("node", "content", F.lit(None).cast("string").alias("at")))
        if depth >= limits.max_archive_depth:
            frontier = frontier.filter("kind = 'tool'")  # tools know no depth
        if frontier.isEmpty():
            break
    every, held = members[0], contents[0]
    for m, c in zip(members[1:], contents[1:]):
        every, held = every.unionByName(m), held.unionByName(c)
    return tops, cut_lineage(every), held


def _below(key: Column, no: Column) -> Column:
    return F.concat(key, F.lit("-"), F.lpad(no.cast("string"), _WIDTH, "0"))


def _mark(df: DataFrame) -> tuple:
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def _tree(tops: DataFrame, members: DataFrame, limits: Limits, refused: DataFrame | None, first: DataFrame | None, seen: DataFrame | None = None) -> DataFrame:
    """Every node that is reached (key, node, kind, depth, parent, no, shown, opened, end) when ``refused`` members and all but
    the ``first`` occurrences of archives, or all of those ``seen`` before (node), are left out; ``end`` is the number of the member at which an archive breaks off, if it does."""
    own = ("key", "node", "kind", "depth", "parent", "no", "shown")
    level = tops.select("key", "node", "kind", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("no"), F.col("path").alias("shown"))
    broken = members.filter("fault = 'broken'").select("node", F.col("no").alias("at"))
    levels = []
    while True:
        least = level.filter("kind <> 'tool'").groupBy("node").agg(F.min("key").alias("least"))
        level = level.join(least, "node", "left")
        fits = F.col("key") == F.col("least")
        if first is not None:
            level = level.join(first.select("node", F.col("key").alias("first")), "node", "left")
            fits = fits & (F.col("first").isNull() | (F.col("key") <= F.col("first")))
        if seen is not None:
            level = level.join(seen.select("node", F.lit(True).alias("seen")).distinct(), "node", "left")
            fits = fits & F.col("seen").isNull()
        opened = (F.col("kind") == "tool") | (fits & (F.col("depth") < limits.max_archive_depth))
        level = level.select(*own, F.coalesce(opened, F.lit(False)).alias("opened"))
        ends = level.filter("opened").join(broken, "node").select("key", "at")
        if refused is not None:
            ends = ends.join(refused.select("key", F.col("no").alias("at")), ["key", "at"], "left_anti")
        level = cut_lineage(level.join(ends.groupBy("key").agg(F.min("at").alias("end")), "key", "left"))
        levels.append(level)
        kids = level.filter("opened and end is null").select(F.col("key").alias("parent"), "node", "depth").join(members.filter("child is not null"), "node")
        if refused is not None:
            kids = kids.join(refused.select(F.col("key").alias("parent"), "no"), ["parent", "no"], "left_anti")
        level = cut_lineage(kids.select(_below(F.col("parent"), F.col("no")).alias("key"), F.col("child").alias("node"), F.col("child_kind").alias("kind"), (F.col("depth") + 1).alias("depth"), "parent", "no", "shown"))
        if level.isEmpty():
            break
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def fold(tops: DataFrame, members: DataFrame, limits: Limits, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(reached, opened keys, requests): what the walk comes to.

    ``reached`` are all nodes it meets, ``opened`` is true for those that it opens; requests are the members that ask for bytes, with
    ``granted`` and the total ``before`` each, or None where the budget holds for all together.
    """
    refused = first = mark = None
    while True:
        reached = cut_lineage(_tree(tops, members, limits, refused, first, seen))
        deep_enough = reached.filter(F.col("depth") < limits.max_archive_depth).filter("kind <> 'tool'")
        now = cut_lineage(deep_enough.groupBy("node").agg(F.min("key").alias("key"), F.count("*").alias("n")))
        really = reached.filter("kind = 'tool'").select("key", "node", "end").unionByName(reached.filter("opened").join(now.select("node", "key"), ["node", "key"]).select("key", "node", "end"))
        asked = really.join(members, "node").filter("end is null or no <= end").select("key", "no", "chunk", "need", "net")
        total = asked.agg(F.sum(F.col("need").cast("decimal(38,0)")).alias("n")).first().n or 0
        requests = budgeted(asked, ["key", "no"], limits.max_total_extracted_bytes) if total > limits.max_total_extracted_bytes else None
        out = requests.filter("not granted").select("key", "no") if requests is not None else None
        told = _mark(now.select("node", "key")), None if out is None else _mark(out)
        once = first is None and out is None and now.filter("n > 1").isEmpty()
        if once or told == mark:
            return reached.drop("opened").join(really.select("key", F.lit(True).alias("opened")), "key", "left").na.fill(False, ["opened"]), really, requests
        refused, first, mark = out, now, told


def _placed(reached: DataFrame, tops: DataFrame, root: str, tag: str) -> DataFrame:
    """The opened nodes with the path of each, the path and input of what it came out of, and its number."""
    archives = running(reached.filter("opened and kind <> 'tool'").select("key"), ["key"], {"n": F.lit(1).cast("long")}).select("key", (F.col("n") + 1).alias("number"))
    opened = reached.filter("opened").join(archives, "key", "left")
    opened = opened.join(tops.select(F.substring("key", 1, _WIDTH).alias("input"), "original", "file_no"), F.substring(opened.key, 1, _WIDTH) == F.col("input")).drop("input")
    folders = opened.select(F.col("key").alias("parent"), F.col("kind").alias("parent_kind"), F.col("number").alias("parent_number"))
    padded = F.when(F.length(F.col("parent_number").cast("string")) >= 4, F.col("parent_number").cast("string")).otherwise(F.lpad(F.col("parent_number").cast("string"), 4, "0"))
    inside = F.concat(F.lit(os.path.join(root, "extracted", f"archive-{tag}")), padded, F.lit("/"), "shown")
    x = opened.join(folders, "parent", "left")
    x = x.withColumn("path", F.when(F.col("parent").isNull(), F.col("shown")).when(F.col("parent_kind") == "tool", F.col("shown")).otherwise(inside))
    return cut_lineage(x.drop("parent_kind", "parent_number"))


def _say(key: str, k: int) -> str:
    """Sorts behind the file at ``key`` and before what came out of it."""
    return f"{key}+{k:0{_WIDTH}d}"


def _leaf(key: str, path: str, original: str, parent: str, data: bytes | None, depth: int, number: str, root: str, limits: Limits, tools: decoders.Tools) -> Iterator[dict]:
    """The rows of a file out of which nothing comes: archives at the depth limit or seen before say so, files for a missing tool too."""
    head, size = _head(path, data, limits)
    row = row_of(key, path, original, parent, head, size=size, known=head is not None and _probed(path, head, size))
    archive = row["is_zip"] or row["is_tar"]
    if archive:
        row["content"] = head[:PROBE]
    elif head is not None and size > len(head):  # a large file for a tool that is not there is scanned whole
        with open(path, "rb") as f:
            head = f.read()
        row = row_of(key, path, original, parent, head)
    named = head is not None and named_archive(path, row)
    if head is not None and not archive and not named and (tool := decodable(path, row)):
        row["decoder"], _ = decoders.decode(tool, path, head, number, root, tools, lambda size: None)
    yield row
    if archive or named:
        if depth >= limits.max_archive_depth:
            yield policy_row(_say(key, 1), path, original, path, "policy:max_archive_depth", "skipped-by-policy", f"Maximum archive depth {limits.max_archive_depth} reached.")
        else:
            yield policy_row(_say(key, 1), path, original, path, "hash:sha256", "archive-loop-detected", fixed.LIMIT_LOOP)


def _judged(f, r: dict, limits: Limits) -> Iterator[tuple[Member, str, str | None]]:
    """(member, verdict, why) of an archive from its first member on, as the walk decides with the total it has there."""
    total, faults = r["total"], {x["no"]: (x["fault"], x["said"]) for x in r["faults"]}
    for m in directory(f, r["kind"] == "zip"):
        if m.no < r["first"]:
            continue
        if m.no > r["last"]:
            return
        if m.refusal:
            yield m, "refused", m.refusal
        elif m.locked:
            yield m, "locked", None
        elif why := budget_refusal(m.size, total, limits):
            yield m, "refused", why
        else:
            fault, said = faults.get(m.no, (None, None))
            total += 0 if fault == "locked" else m.size
            yield m, {"locked": "locked", "unread": "refused", "broken": "broken", None: "taken"}[fault], fixed.LIMIT_TAR_UNREADABLE if fault == "unread" else said
            if fault == "broken":
                return


def _emit(r: dict, root: str, limits: Limits, tools: decoders.Tools, tag: str) -> Iterator[dict]:
    """The artifacts of one range of an opened node: with the first range the node's own row and what was refused, then what came out."""
    key, path, original, up, depth = r["key"], r["path"], r["original"], r["extracted_from"], r["depth"]
    opened, at = set(r["kids"]), r["at"]
    head, size = _head(at, r["content"], limits)
    if r["kind"] == "tool":
        left = [r["total"]]

        def budget(n):
            why = budget_refusal(n, left[0], limits)
            left[0] += 0 if why else n
            return why

        row = row_of(key, path, original, up, head, size=size, known=_probed(at, head, size))
        sizes, found = [], []
        row["decoder"], found = decoders.decode(r["node"].split(":", 1)[0], path, head, f"{r['file']:06d}", root, tools, budget)
        _, every = decoders.decode(r["node"].split(":", 1)[0], path, head, f"{r['file']:06d}", root, tools, lambda n: sizes.append(n))
        numbers = {shown: k for k, (shown, _) in enumerate(every)}
        yield row
        for shown, data in found:
            if numbers[shown] not in opened:
                yield from _leaf(f"{key}-{numbers[shown]:0{_WIDTH}d}", shown, original, path, data, depth + 1, f"{r['file']:06d}", root, limits, tools)
        return
    if r["first"] == 0:
        row = row_of(key, path, original, up, head, size=size, known=_probed(at, head, size))
        if r["kind"] != "named":
            row["content"] = head[:PROBE]
        said, limitations, error = [], [], None
        opening = next((x["said"] for x in r["faults"] if x["no"] < 0), None)
        if opening is not None:
            error = opening
        elif r["kind"] != "named":
            with _opened(at, r["content"]) as f:
                for m, verdict, why in _judged(f, r | {"last": 1 << 62}, limits):
                    where = (f"{path}!{m.name}", original, path)
                    if verdict == "refused":
                        said.append((*where, "archive-member:safety-check", "unsafe-archive-path-refused", why))
                    elif verdict == "locked":
                        limitations.append(fixed.LIMIT_PASSWORD)
                        said.append((*where, "archive-member:zip-encrypted", "password-required", fixed.LIMIT_PASSWORD, "skipped-password-required"))
                    elif verdict == "broken":
                        error = why
        if error is not None:
            said.append((path, original, path, "extract:error", "unreadable", f"Archive extraction failed: {error}", "unreadable"))
        else:
            row["archive_limitations"] = list(dict.fromkeys(limitations))
        yield row
        for k, x in enumerate(said):
            yield policy_row(_say(key, k), *x)
    if r["end"] is not None or r["kind"] == "named":
        return
    folder = os.path.join(root, "extracted", f"archive-{tag}{r['number']:04d}")
    with _opened(at, r["content"]) as f:
        for m, verdict, _ in _judged(f, r, limits):
            if verdict == "taken" and m.no not in opened:
                yield from _leaf(f"{key}-{m.no:0{_WIDTH}d}", os.path.join(folder, m.target), original, path, m.read(), depth + 1, "", root, limits, tools)


def emitted(sources: DataFrame, tops: DataFrame, members: DataFrame, contents: DataFrame, folded, root: str, limits: Limits, tools: decoders.Tools, tag: str = "") -> DataFrame:
    """The artifacts of all sources in ARTIFACT_SCHEMA."""
    reached, _, requests = folded
    opened = _placed(reached, tops, root, tag)
    tooled = not opened.filter("kind = 'tool'").isEmpty()
    if tooled:
        opened = _tool_paths(opened, reached, members, requests, root)
    paths = opened.select(F.col("key").alias("parent"), F.col("path").alias("extracted_from"))
    opened = opened.join(paths, "parent", "left").na.fill("", ["extracted_from"])
    faults = members.filter("fault is not null").groupBy("node").agg(F.collect_list(F.struct("no", "fault", "said")).alias("faults"))
    kids = opened.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.collect_list("no").alias("kids"))
    ranges = members.filter("no >= 0").select("node", F.col("chunk").alias("first"), F.col("upto").alias("last")).distinct()
    start = F.array(F.lit(0).cast("long"))
    ranges = ranges.groupBy("node").agg(F.array_sort(F.array_distinct(F.concat(start, F.collect_set("first")))).alias("firsts"))
    x = opened.join(ranges, "node", "left").withColumn("firsts", F.coalesce("firsts", start))
    x = x.join(faults, "node", "left").join(kids, "key", "left")
    x = x.withColumns({"faults": F.coalesce("faults", F.array().cast("array<struct<no:long,fault:string,said:string>>")), "kids": F.coalesce("kids", F.array().cast("array<long>"))})
    x = x.select("*", F.posexplode("firsts").alias("__k", "first"))
    x = x.withColumn("last", F.coalesce(F.try_element_at("firsts", F.col("__k") + 2) - 1, F.lit(1 << 62))).drop("firsts", "__k")
    if requests is None:
        x = x.withColumn("total", F.lit(0).cast("long"))  # all fits, from any total on
    else:
        totals = requests.groupBy("key", F.col("chunk").alias("first")).agg(F.min("before").alias("total"))
        later = requests.groupBy("key").agg(F.min("before").alias("lowest"))
        x = x.join(totals, ["key", "first"], "left").join(later, "key", "left").withColumn("total", F.coalesce("total", "lowest", F.lit(0).cast("long"))).drop("lowest")
    if not tooled:
        x = x.withColumn("file", F.lit(0).cast("long"))
    fields = ["key", "node", "kind", "depth", "path", "original", "extracted_from", "number", "file", "first", "last", "total", "end", "faults", "kids", "content", "at"]
    x = cut_lineage(x)
    # contents go to tasks once and meet their rows there; of files on disk the ranges are dealt
    held = _dealt(contents.filter("content is not null"), "node").join(x, "node").select(*fields)
    kept = _dealt(x.join(contents.filter("content is null"), "node").select(*fields), "key", "first")
    out = _map(held, lambda r: _emit(r, root, limits, tools, tag), ARTIFACT_SCHEMA).unionByName(_map(kept, lambda r: _emit(r, root, limits, tools, tag), ARTIFACT_SCHEMA))
    return out.unionByName(_leaves(sources.join(opened.filter("parent is null").select("key"), "key", "left_anti"), root, limits, tools))


def _leaves(sources: DataFrame, root: str, limits: Limits, tools: decoders.Tools) -> DataFrame:
    return _map(sources, lambda r: _leaf(r["key"], r["path"], r["original"], "", r["content"], 0, f"{r['file_no']:06d}", root, limits, tools), ARTIFACT_SCHEMA)


def _tool_paths(opened: DataFrame, reached: DataFrame, members: DataFrame, requests: DataFrame | None, root: str) -> DataFrame:
    """``opened`` with the number ``file`` that a tool's files are named by: files met before, inputs and members alike."""
    files = reached.filter("opened and end is null").select("key", "node").join(members.filter("fault is null").select("node", "no"), "node")
    if requests is not None:
        files = files.join(requests.filter("granted").select("key", "no"), ["key", "no"])
    met = files.select(_below(F.col("key"), F.col("no")).alias("key"), F.lit(1).cast("long").alias("one"))
    tools = opened.filter("kind = 'tool'").select("key")
    marks = met.join(tools, "key", "left_anti").withColumn("tool", F.lit(False)).unionByName(tools.withColumn("one", F.when(F.col("key").contains("-"), 1).otherwise(0).cast("long")).withColumn("tool", F.lit(True)))
    told = running(marks, ["key"], {"n": F.col("one")}).filter("tool").select("key", (F.col("n") + F.col("one")).alias("extra"))
    out = opened.join(told, "key", "left").withColumn("file", F.coalesce(F.col("extra") + F.col("file_no"), F.lit(0).cast("long"))).drop("extra")
    above = out.select(F.col("key").alias("parent"), F.lpad(F.col("file").cast("string"), 6, "0").alias("made"))
    named = F.replace(F.replace("path", F.lit("\0"), F.col("made")), F.lit("\1"), F.lit(root))
    return cut_lineage(out.join(above, "parent", "left").withColumn("path", F.when(F.col("made").isNotNull() & F.contains("path", F.lit("\0")), named).otherwise(F.col("path"))).drop("made"))


def expanded_together(sources: DataFrame, root: str, limits: Limits | None = None, tools: decoders.Tools | None = None, tag: str = "") -> DataFrame:
    """Artifacts of the sources (SOURCE), archives expanded in parallel under one budget and one set of archives seen, in the order of the keys.

    Rows with content need no file; without, the path is opened by the task. Keys have nine digits and are the order of the
    walk. The same rows as ``Expander`` gives one source after another. No sources give no rows.
    """
    return expanded_and_opened(sources, root, limits, tools, tag)[0]


def expanded_and_opened(sources: DataFrame, root: str, limits: Limits | None = None, tools: decoders.Tools | None = None, tag: str = "", seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(artifacts, opened (node)) as ``expanded_together``, where archives ``seen`` (node) in earlier scans count as seen."""
    limits, tools = limits or Limits(), tools or decoders.Tools()
    found = catalogue(sources, limits, tools)
    if found is None:
        return _leaves(sources, root, limits, tools), sources.select(F.col("key").alias("node")).limit(0)
    tops, members, contents = found
    folded = fold(tops, members, limits, seen)
    opened = folded[0].filter("opened and kind <> 'tool'").select("node")
    out = emitted(sources, tops, members, contents, folded, root, limits, tools, tag)
    release(sources.sparkSession)
    return out, opened


def keyed(files: DataFrame) -> DataFrame:
    """SOURCE rows of (path, content), in the order of their paths."""
    n = cut_lineage(running(files.select("path"), ["path"], {"n": F.lit(1).cast("long")}))
    return files.join(_told(n), "path").select(F.lpad(F.col("n").cast("string"), _WIDTH, "0").alias("key"), "path", F.col("path").alias("original"), (F.col("n") + 1).alias("file_no"), "content")

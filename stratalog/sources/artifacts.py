"""Artifacts as rows: plain files in parallel, archives and tool formats expanded in scan order."""

from __future__ import annotations

import hashlib
import io
import json
import os
import stat
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path, PurePosixPath
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..lineage import cut_lineage
from ..schema import ARTIFACT_SCHEMA
from . import decoders
from .manifest import Entry

PROBE = 4096


@dataclass(frozen=True)
class Limits:
    """``task_bytes`` of a file on disk are looked at whole, and so many bytes of a ZIP file's members are read by one task. ``per_input`` gives every top-level input its own budget and seen archives, else all share one, in scan order."""

    max_archive_depth: int = 5
    max_total_extracted_bytes: int = 1_073_741_824
    max_single_file_bytes: int = 268_435_456
    per_input: bool = False
    task_bytes: int = 268_435_456


def _is_tar(content: bytes) -> bool:
    try:
        with tarfile.open(fileobj=io.BytesIO(content)):
            return True
    except (tarfile.TarError, OSError, EOFError, zlib.error):
        return False


def probe(content: bytes) -> dict:
    """What only Python can tell of an artifact: archive formats, JSON, and strict decodings that expressions would fail on."""
    sample = content[:PROBE]
    out = {"is_zip": zipfile.is_zipfile(io.BytesIO(content)), "is_tar": False, "is_json": False, "marker_text": None, "utf16_text": None, "utf16_error": None}
    out["is_tar"] = not out["is_zip"] and _is_tar(content)
    wide = sample.startswith((b"\xff\xfe", b"\xfe\xff"))
    if wide or b"\x00" not in sample:
        for name in ("utf-8-sig", "utf-16", "utf-8", "cp1252", "latin-1"):
            try:
                out["marker_text"] = sample.decode(name).encode("utf-8", "replace").decode()
                break
            except UnicodeError:
                continue
    stripped = sample.lstrip()
    if stripped.startswith((b"{", b"[")):
        try:
            json.loads(stripped.decode("utf-8"))
            out["is_json"] = True
        except (ValueError, RecursionError):
            pass
    name = "utf-16" if wide else "utf-8-sig" if sample.startswith(b"\xef\xbb\xbf") else None
    if name:
        try:
            text = content.decode(name)
            out["utf16_text"] = text.encode("utf-8", "replace").decode() if wide else None
        except UnicodeError as e:
            out["utf16_error"] = f"Text decode failed with {name}: {e}"
    return out


def row_of(ord_: str, path: str, original: str, parent: str, content: bytes | None, policy: tuple | None = None, size: int | None = None, known: dict | None = None) -> dict:
    """A row of ARTIFACT_SCHEMA. policy: (family, identified_by, review_mode, status, limitations); known: what ``probe`` told of the content."""
    named = policy and dict(zip(("family", "identified_by", "review_mode", "status", "limitations"), policy))
    row = {"artifact_ord": ord_, "artifact_path": path, "original_input_path": original, "extracted_from": parent, "content": content, "policy": named, "decoder": None, "archive_limitations": [], "size": size}
    told = known or (probe(content) if content is not None else {})
    return row | {k: told.get(k) for k in ("is_zip", "is_tar", "is_json", "marker_text", "utf16_text", "utf16_error")}


def policy_row(ord_: str, path: str, original: str, parent: str, by: str, status: str, limits: str, mode: str = "skipped-by-policy") -> dict:
    return row_of(ord_, path, original, parent, None, ("unknown", by, mode, status, limits))


def _specialised(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1].lower()
    suffix = Path(name).suffix
    if suffix == ".pdf":
        return "pdf"
    return fixed.TOOL_ARCHIVE_SUFFIXES.get(suffix) or fixed.DECODER_SUFFIXES.get(suffix)


def _content_decides(row: dict) -> bool:
    """Whether markers, XML or HTML decide the family before the name does."""
    low = (row["marker_text"] or "").lower()
    counts = [sum(m.lower() in low for m in ms) for ms in fixed.MARKERS.values()]
    if max(counts) >= 2 or max(counts) == 1 and any(m.lower() in low for m in fixed.STRONG_MARKERS):
        return True
    head = row["content"][:PROBE].lstrip()
    return head.startswith((b"<?xml", b"<Event")) or b"<html" in head[:512].lower() or b"<!doctype html" in head[:512].lower()


def named_archive(path: str, row: dict) -> bool:
    """An archive by name alone: it takes a number and a hash although nothing comes out of it."""
    return path.lower().endswith((".zip", *fixed.TAR_SUFFIXES)) and not row["is_json"] and not _content_decides(row)


def decodable(path: str, row: dict) -> str | None:
    """The format by name of a file that a tool may open."""
    return None if row["is_json"] or _content_decides(row) else _specialised(path)


def _needs_expanding(path: str) -> bool:
    """Whether more artifacts may come out of this file: archives by content or name, and formats with tools. Reads no more than it has to."""
    if path.lower().endswith((".zip", *fixed.TAR_SUFFIXES)) or _specialised(path):
        return True
    try:
        return zipfile.is_zipfile(path) or tarfile.is_tarfile(path)
    except (OSError, EOFError, zlib.error, tarfile.TarError):
        return False


class Expander:
    """Walks archives depth first, with the byte budget, seen hashes and counters that the walk shares."""

    def __init__(self, workspace: str, limits: Limits, tools: decoders.Tools, tag: str = ""):
        self.root, self.limits, self.tools, self.tag = workspace, limits, tools, tag
        self.seen: set[str] = set()
        self.total = self.archives = self.extra = self.seq = 0

    def top(self, entry: dict) -> Iterator[dict]:
        self.prefix, self.seq, self.number = f"{entry['ord']:09d}", 0, entry["file_no"]
        try:
            with open(entry["path"], "rb") as f:
                content = f.read()
        except OSError:
            content = None
        yield from self.file(entry["path"], entry["original"], "", content, 0)

    def next_ord(self) -> str:
        self.seq += 1
        return f"{self.prefix}-{self.seq:09d}"

    def file(self, path: str, original: str, parent: str, content: bytes | None, depth: int) -> Iterator[dict]:
        if depth:
            self.extra += 1
        artifact_no = self.number + self.extra
        row = row_of(self.next_ord(), path, original, parent, content)
        children: list[tuple[str, bytes]] = []
        is_archive = row["is_zip"] or row["is_tar"]
        named = content is not None and named_archive(path, row)
        if content is not None and not is_archive and not named and (kind := decodable(path, row)):
            row["decoder"], children = decoders.decode(kind, path, content, f"{artifact_no:06d}", self.root, self.tools, self._budget)
        later: list[dict] = []
        members: list[tuple[str, bytes]] = []
        if content is not None and (is_archive or named):
            members = self._extract(path, original, content, depth, row, later)
        yield row
        yield from later
        for child, data in members or children:
            yield from self.file(child, original, path, data, depth + 1)

    def _budget(self, size: int) -> str | None:
        """Takes ``size`` from the budget; why it can't, if so."""
        why = budget_refusal(size, self.total, self.limits)
        self.total += 0 if why else size
        return why

    def _policy(self, path, original, parent, by, status, limits, mode="skipped-by-policy") -> dict:
        return policy_row(self.next_ord(), path, original, parent, by, status, limits, mode)

    def _extract(self, path: str, original: str, content: bytes, depth: int, row: dict, later: list[dict]) -> list[tuple[str, bytes]]:
        if depth >= self.limits.max_archive_depth:
            later.append(self._policy(path, original, path, "policy:max_archive_depth", "skipped-by-policy", f"Maximum archive depth {self.limits.max_archive_depth} reached."))
            return []
        digest = hashlib.sha256(content).hexdigest()
        if digest in self.seen:
            later.append(self._policy(path, original, path, "hash:sha256", "archive-loop-detected", fixed.LIMIT_LOOP))
            return []
        self.seen.add(digest)
        self.archives += 1
        folder = os.path.join(self.root, "extracted", f"archive-{self.tag}{self.archives:04d}")
        refused, members, limitations = [], [], []

        def refuse(name, why):
            refused.append(self._policy(f"{path}!{name}", original, path, "archive-member:safety-check", "unsafe-archive-path-refused", why))

        def locked(name):
            limitations.append(fixed.LIMIT_PASSWORD)
            refused.append(self._policy(f"{path}!{name}", original, path, "archive-member:zip-encrypted", "password-required", fixed.LIMIT_PASSWORD, "skipped-password-required"))

        try:
            for m in directory(io.BytesIO(content), row["is_zip"]) if row["is_zip"] or row["is_tar"] else ():
                if m.refusal:
                    refuse(m.name, m.refusal)
                elif m.locked:
                    locked(m.name)
                elif why := self._budget(m.size):
                    refuse(m.name, why)
                else:
                    try:
                        data = m.read()
                    except Locked:
                        self.total -= m.size
                        locked(m.name)
                        continue
                    if data is None:
                        refuse(m.name, fixed.LIMIT_TAR_UNREADABLE)
                    else:
                        members.append((os.path.join(folder, m.target), data))
        except BROKEN as e:
            later += [*refused, self._policy(path, original, path, "extract:error", "unreadable", f"Archive extraction failed: {e}", "unreadable")]
            return []
        later += refused
        row["archive_limitations"] = list(dict.fromkeys(limitations))
        return members


@dataclass(frozen=True)
class Member:
    """A file of an archive as its directory tells it: ``target`` is its path below the folder it goes to; ``refusal`` says why it may not."""

    no: int
    name: str
    size: int
    target: str | None
    refusal: str | None
    locked: bool
    read: Callable[[], bytes | None]


class Locked(Exception):
    """A member turned out to need a password."""


#: What an archive that can't be read raises.
BROKEN = (OSError, EOFError, tarfile.TarError, zipfile.BadZipFile, NotImplementedError, zlib.error)


def _zip_reader(archive: zipfile.ZipFile, m: zipfile.ZipInfo):
    def read():
        try:
            return archive.read(m)
        except NotImplementedError:
            raise
        except RuntimeError as e:
            if "password required" in str(e).lower():
                raise Locked from e
            raise OSError(str(e)) from e

    return read


def _tar_reader(archive: tarfile.TarFile, m: tarfile.TarInfo):
    return lambda: source.read() if (source := archive.extractfile(m)) is not None else None


def directory(f: BinaryIO, is_zip: bool) -> Iterator[Member]:
    """The files of an archive in order, links and special files too; folders are left out. Contents are read on demand."""
    if is_zip:
        with zipfile.ZipFile(f) as archive:
            files = [m for m in archive.infolist() if not m.is_dir()]
            for k, m in enumerate(files):
                target = safe_target(m.filename)
                refusal = fixed.LIMIT_UNSAFE_PATH if target is None else fixed.LIMIT_ZIP_LINK if stat.S_ISLNK(m.external_attr >> 16) else None
                yield Member(k, m.filename, m.file_size, target, refusal, bool(m.flag_bits & 1), _zip_reader(archive, m))
        return
    with tarfile.open(fileobj=f) as archive:
        for k, m in enumerate(m for m in archive.getmembers() if not m.isdir()):
            target = safe_target(m.name)
            refusal = fixed.LIMIT_UNSAFE_PATH if target is None else fixed.LIMIT_TAR_LINK if m.issym() or m.islnk() else None if m.isfile() else fixed.LIMIT_TAR_KIND
            yield Member(k, m.name, m.size, target, refusal, False, _tar_reader(archive, m))


def budget_refusal(size: int, total: int, limits: Limits) -> str | None:
    """Why a file of this size may not be added to the total; None if it may."""
    if size > limits.max_single_file_bytes:
        return f"File exceeds max_single_file_bytes ({limits.max_single_file_bytes})."
    if total + size > limits.max_total_extracted_bytes:
        return f"Extraction exceeds max_total_extracted_bytes ({limits.max_total_extracted_bytes})."
    return None


def safe_target(name: str) -> str | None:
    """Where a member goes below its folder; None if its path is absolute, empty, begins with a drive or climbs."""
    parts = PurePosixPath(name.replace("\\", "/")).parts
    if not parts or parts[0].startswith("/") or parts[0].endswith(":") or ".." in parts:
        return None
    return os.path.join(*parts)


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def artifacts(spark: SparkSession, entries: list[Entry], workspace: str, limits: Limits | None = None, tools: decoders.Tools | None = None, files_per_task: int = 64) -> DataFrame:
    """All artifacts of the entries, in ARTIFACT_SCHEMA.

    All files are read in parallel. Those out of which more may come share a byte budget and the archives seen, in scan
    order; ``bundles`` gives what one walk after another would. With ``limits.per_input`` each has its own. What is
    expanded is stored in the shared folder; plain files are read again by whoever needs their bytes again.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    limits, tools = limits or Limits(), tools or decoders.Tools()
    schema = spark.createDataFrame([], ARTIFACT_SCHEMA).schema
    arrow = to_arrow_schema(schema)
    rows = [(e.ord, e.path, e.original, e.file_no, *(e.policy or (None,) * 4)) for e in entries]
    manifest = spark.createDataFrame(rows, "ord long, path string, original string, file_no long, by string, mode string, status string, limits string")
    manifest = manifest.repartition(max(1, -(-len(rows) // files_per_task)), "ord")

    def plain(batches):
        for b in batches:
            for e in b.to_pylist():
                ord_ = f"{e['ord']:09d}"
                if e["by"]:
                    yield _arrow([policy_row(ord_, e["path"], e["original"], "", e["by"], e["status"], e["limits"], e["mode"])], arrow)
                    continue
                if _needs_expanding(e["path"]):
                    continue
                try:
                    with open(e["path"], "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
                yield _arrow([row_of(ord_, e["path"], e["original"], "", content)], arrow)

    def which(batches):
        for b in batches:
            keep = [not e["by"] and _needs_expanding(e["path"]) for e in b.to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    def expand(batches):
        for b in batches:
            for e in b.to_pylist():
                for row in Expander(workspace, limits, tools, f"{e['ord']:06d}-").top(e):
                    yield _arrow([row], arrow)

    nested = manifest.mapInArrow(which, manifest.schema)
    if limits.per_input:
        found = nested.mapInArrow(expand, schema)
    else:
        from .bundles import expanded_together

        sources = nested.select(F.lpad(F.col("ord").cast("string"), 9, "0").alias("key"), "path", "original", "file_no", F.lit(None).cast("binary").alias("content"))
        found = expanded_together(cut_lineage(sources), workspace, limits, tools)
    return manifest.mapInArrow(plain, schema).unionByName(cut_lineage(found))


def from_contents(files: DataFrame, root: str = "") -> DataFrame:
    """Artifacts from rows (path, content), probed but not expanded; they keep their order by path."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = files.sparkSession.createDataFrame([], ARTIFACT_SCHEMA).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield _arrow([row_of(path, path, root or path, "", content)], arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def expanded(files: DataFrame, root: str = "", limits: Limits | None = None, tools: decoders.Tools | None = None) -> DataFrame:
    """Artifacts from rows (path, content), archives and tool formats expanded; every file has its own limits, so all expand in parallel.

    Members stay in the rows, so files may come from any store; formats that need a program use the task's scratch folder.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    limits, tools = limits or Limits(), tools or decoders.Tools()
    schema = files.sparkSession.createDataFrame([], ARTIFACT_SCHEMA).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                walk = Expander(root or "expanded", limits, tools, hashlib.sha256(path.encode()).hexdigest()[:12] + "-")
                walk.prefix, walk.seq, walk.number = path, 0, 1
                for row in walk.file(path, root or path, "", content, 0):
                    yield _arrow([row], arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def from_binary_files(spark: SparkSession, path: str, limits: Limits | None = None, tools: decoders.Tools | None = None) -> DataFrame:
    """Artifacts from any store that Spark reads, in path order, archives expanded; files of up to 2 GB."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return expanded(found, path, limits, tools)


def from_table(df: DataFrame, path: F.Column, text: F.Column) -> DataFrame:
    """Artifacts from rows that hold texts; only for text that is known not to be an archive."""
    none = lambda kind: F.lit(None).cast(kind)
    fields = {"is_zip": F.lit(False), "is_tar": F.lit(False), "is_json": F.lit(False)}
    out = df.select(path.alias("artifact_path"), text.cast("binary").alias("content")).withColumns(fields)
    out = out.withColumns({"artifact_ord": F.col("artifact_path"), "original_input_path": F.col("artifact_path"), "extracted_from": F.lit(""), "marker_text": F.substring("content", 1, PROBE).cast("string"), "utf16_text": none("string"), "utf16_error": none("string"), "size": none("long")})
    schema = ARTIFACT_SCHEMA.split("policy ", 1)[1]
    policy, rest = schema.split(", decoder ", 1)
    decoder, limits = rest.removesuffix(", size long").split(", archive_limitations ", 1)
    return out.withColumns({"policy": none(policy), "decoder": none(decoder), "archive_limitations": F.array().cast(limits)})

"""Formats that need a program or a library: what comes out of them, or why nothing does."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable
from dataclasses import dataclass
from importlib import util
from io import BytesIO
from pathlib import Path, PureWindowsPath

from .. import fixed

TIMEOUT = 120


def _execute(command: list[str]) -> tuple[int, str]:
    try:
        done = subprocess.run(command, check=False, capture_output=True, text=True, timeout=TIMEOUT)
        return done.returncode, done.stdout
    except (OSError, subprocess.SubprocessError):
        return 1, ""


@dataclass(frozen=True)
class Tools:
    """Programs by name, None to look in ``folder`` and on the path of the machine that runs the task; "" for none."""

    tshark: str | None = None
    seven_zip: str | None = None
    expand: str | None = None
    wevtutil: str | None = None
    tracerpt: str | None = None
    folder: str = "tools"
    execute: Callable[[list[str]], tuple[int, str]] = _execute

    def find(self, name: str) -> str | None:
        given = getattr(self, name)
        if given is not None:
            return given or None
        bundled, on_path = {
            "tshark": (["tshark/tshark.exe"], ["tshark", "tshark.exe"]),
            "seven_zip": (["7zip/7z.exe", "7zip/7zz.exe"], ["7z", "7z.exe", "7zz", "7zz.exe"]),
            "expand": ([], ["expand.exe"]),
            "wevtutil": ([], ["wevtutil.exe", "wevtutil"]),
            "tracerpt": ([], ["tracerpt.exe", "tracerpt"]),
        }[name]
        return next((p for b in bundled if os.path.isfile(p := os.path.join(self.folder, b))), None) or next((p for n in on_path if (p := shutil.which(n))), None)


def available(kind: str, tools: Tools) -> bool:
    """Whether this machine has what opens the format."""
    if kind == "pdf":
        return any(util.find_spec(m) is not None for m in ("pypdf", "PyPDF2"))
    return tools.find({"pcap": "tshark", "pcapng": "tshark", "evtx": "wevtutil", "etl": "tracerpt", "seven_zip": "seven_zip"}.get(kind, "expand")) is not None


def _told(used: str, status: str, limitations: str = "", fallback: bool = False) -> dict:
    return {"used": used, "status": status, "limitations": limitations, "fallback": fallback}


def unsafe_listed(listing: str) -> list[str]:
    """Member paths of a 7-Zip listing that are absolute or climb."""
    out = []
    for line in listing.splitlines():
        name = line[len("Path = ") :].strip() if line.startswith("Path = ") else ""
        if name and not name.endswith(":") and (PureWindowsPath(name).is_absolute() or ".." in name.replace("\\", "/").split("/")):
            out.append(name)
    return out


def decode(kind: str, path: str, content: bytes, number: str, root: str, tools: Tools, budget: Callable[[int], str | None]) -> tuple[dict, list[tuple[str, bytes]]]:
    """(used, status, limitations, fallback) and the decoded files; with ``fallback`` the artifact is scanned for strings instead."""
    if kind == "pdf":
        return _pdf(content, os.path.join(root, "decoded", f"pdf_{number}.txt"))
    with tempfile.TemporaryDirectory() as scratch:
        source = os.path.join(scratch, os.path.basename(path))
        with open(source, "wb") as f:
            f.write(content)
        target = os.path.join(scratch, "out")
        os.mkdir(target)
        if kind in ("pcap", "pcapng"):
            return _text_tool("tshark", "tshark", tools, lambda t: [t, "-r", source, "-T", "fields", "-E", "header=y", "-E", "separator=,", "-E", "quote=d", *(x for f in fixed.PACKET_FIELDS for x in ("-e", f))],
                              os.path.join(root, "decoded", f"pcap_{number}.csv"), fixed.LIMIT_NO_TSHARK, fixed.SAY_TSHARK_FAILED, True)
        if kind == "evtx":
            return _text_tool("wevtutil", "wevtutil.exe", tools, lambda t: [t, "qe", source, "/lf:true", "/f:xml"], os.path.join(root, "decoded", f"evtx_{number}.xml"),
                              fixed.SAY_NO_WEVTUTIL, fixed.SAY_WEVTUTIL_FAILED, False)
        if kind == "etl":
            return _etl(source, target, tools, os.path.join(root, "decoded", f"etl_{number}.csv"))
        if kind == "seven_zip":
            return _unpacked("seven_zip", "7zip", tools, source, target, os.path.join(root, "extracted", f"7z_{number}"), budget)
        return _unpacked("expand", "expand.exe", tools, source, target, os.path.join(root, "extracted", f"cab_{number}"), budget)


def _text_tool(name, used, tools, command, out, missing, failed, fallback):
    tool = tools.find(name)
    if tool is None:
        return _told(used, "specialized-tool-unavailable", missing, fallback), []
    code, text = tools.execute(command(tool))
    if code:
        return _told(used, "decode-failed", failed.format(code), fallback), []
    return _told(used, "decoded"), [(out, text.encode())]


def _etl(source, target, tools, out):
    tool = tools.find("tracerpt")
    if tool is None:
        return _told("tracerpt.exe", "specialized-tool-unavailable", fixed.LIMIT_ETL, True), []
    made = os.path.join(target, "out.csv")
    code, _ = tools.execute([tool, source, "-o", made, "-of", "CSV"])
    if code or not os.path.exists(made):
        return _told("tracerpt.exe", "decode-failed", fixed.LIMIT_ETL, True), []
    return _told("tracerpt.exe", "decoded-with-limitation", fixed.LIMIT_ETL), [(out, Path(made).read_bytes())]


def _unpacked(name, used, tools, source, target, shown, budget):
    """Unpacked files under the same byte limits as other archives; what exceeds them is left out and told."""
    tool = tools.find(name)
    if tool is None:
        return _told(used, "specialized-tool-unavailable", fixed.LIMIT_NO_7Z if used == "7zip" else fixed.SAY_NO_EXPAND), []
    if used == "7zip":
        code, listing = tools.execute([tool, "l", "-slt", source])
        if code:
            return _told(used, "decode-failed", fixed.SAY_7Z_LISTING_FAILED.format(code)), []
        if bad := [b for b in unsafe_listed(listing) if b != source]:
            return _told(used, "skipped-by-policy", fixed.SAY_7Z_UNSAFE.format(bad[0])), []
        code, _ = tools.execute([tool, "x", "-y", f"-o{target}", source])
        failed = fixed.SAY_7Z_FAILED.format(code)
    else:
        code, _ = tools.execute([tool, "-F:*", source, target])
        failed = fixed.SAY_EXPAND_FAILED.format(code)
    if code:
        return _told(used, "decode-failed", failed), []
    found, refused = [], []
    for p in sorted(p for p in Path(target).rglob("*") if p.is_file() and not p.is_symlink()):
        if why := budget(p.stat().st_size):
            refused.append(f"{p.relative_to(target)}: {why}")
        else:
            found.append((os.path.join(shown, str(p.relative_to(target))), p.read_bytes()))
    return _told(used, "decoded", " ".join(refused)), found


def _pdf(content: bytes, out: str):
    for module in ("pypdf", "PyPDF2"):
        if util.find_spec(module) is None:
            continue
        try:
            return _told(module, "decoded"), [(out, pdf_text(module, content).encode())]
        except Exception as e:  # these libraries raise anything on broken files
            return _told(module, "decode-failed", fixed.SAY_PDF_FAILED.format(e)), []
    return _told("pdf-basic", "specialized-tool-unavailable", fixed.LIMIT_NO_PDF), []


def pdf_text(module: str, content: bytes) -> str:
    import importlib

    reader = importlib.import_module(module).PdfReader(BytesIO(content))
    return "\n".join(page.extract_text() or "" for page in reader.pages)

"""Input files in scan order, found on the driver; nothing is read here."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from .. import fixed


@dataclass(frozen=True)
class Entry:
    """``policy`` is None for a file to read, else (identified_by, review_mode, status, limitations)."""

    ord: int
    path: str
    original: str
    file_no: int
    policy: tuple[str, str, str, str] | None = None


def discover(inputs: list[str]) -> list[Entry]:
    """Files of the inputs, as given and not deduplicated; folders by name, a folder's files before its subfolders.

    Linked folders are left out, linked files and missing inputs become policy entries.
    """
    out: list[Entry] = []
    files = 0

    def add(path, original, policy=None):
        nonlocal files
        files += policy is None
        out.append(Entry(len(out), str(path), str(original), files, policy))

    def one(path: Path, original: Path):
        if path.is_file():
            add(path, original)
        else:
            add(path, original, ("filesystem:missing-or-not-file", "unreadable", "unreadable", fixed.LIMIT_MISSING))

    def folder(top: Path, original: Path):
        entries = sorted(os.scandir(top), key=lambda e: e.name)
        subfolders = []
        for e in entries:
            if e.is_dir():
                if not e.is_symlink():
                    subfolders.append(Path(e.path))
            elif e.is_symlink():
                add(e.path, original, ("filesystem:symlink", "skipped-by-policy", "skipped-symlink-input", fixed.LIMIT_SYMLINK_INPUT))
            else:
                one(Path(e.path), original)
        for s in subfolders:
            try:
                folder(s, original)
            except OSError:
                continue

    for given in inputs:
        top = Path(given).expanduser().resolve()
        if top.is_dir():
            folder(top, top)
        else:
            one(top, top)
    return out

"""A user's saved screens and pinned companies: one small JSON file, written whole or not at all."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

VERSION, LONGEST = 1, 100


def load(path: str) -> dict:
    """The workspace of a file; a file that is missing, broken or of another version gives an empty one."""
    empty = {"schema_version": VERSION, "pins": [], "history": []}
    try:
        found = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError):
        return empty
    return found if isinstance(found, dict) and found.get("schema_version") == VERSION else empty


def save(path: str, workspace: dict) -> None:
    folder = Path(path).resolve().parent
    folder.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder, suffix=".tmp")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(workspace, f, ensure_ascii=False, sort_keys=True, indent=1)
    os.replace(name, path)


def record(workspace: dict, query: str, found: list[str], pin: bool = False) -> dict:
    """The workspace with a screen in its history, of which the last hundred stay, and its companies pinned if asked."""
    history = [*workspace["history"], {"query": query, "found": found}][-LONGEST:]
    pins = sorted({*workspace["pins"], *found}) if pin else workspace["pins"]
    return {**workspace, "history": history, "pins": pins}

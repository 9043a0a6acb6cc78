"""Frozen settings: read from TOML or JSON, checked, and identified by a content hash."""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import fields
from pathlib import Path


def content_hash(values: dict) -> str:
    """SHA-256 of the values as JSON with sorted keys; the order in the file plays no part."""
    return hashlib.sha256(json.dumps(values, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def load(path: str | Path, kind: type, section: str | None = None):
    """(settings, hash): ``kind`` is a dataclass; unknown or missing names are errors."""
    text = Path(path).read_text()
    values = json.loads(text) if str(path).endswith(".json") else tomllib.loads(text)
    values = values[section] if section else values
    names = {f.name for f in fields(kind)}
    if extra := set(values) - names:
        raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
    return kind(**values), content_hash(values)

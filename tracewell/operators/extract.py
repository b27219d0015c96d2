"""Extractors: table functions that claim parts of a state by their key path and say which assets they are."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

#: (key path, value) -> assets as (role, kind, content, placeholder), or None if the value isn't this extractor's.
Extractor = Callable[[tuple[str, ...], Any], "list[tuple[str, str, str | None, str]] | None"]


def at_state(path: tuple[str, ...], key: str) -> bool:
    """Whether a key is at the top of a state, or right under an update."""
    return path in ((key,), ("update", key))


def digest_of(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()


def file_content(entry: Any) -> str | None:
    """A file entry's text: a string, or lines."""
    entry = entry.get("content") if isinstance(entry, dict) else entry
    if isinstance(entry, list) and all(isinstance(x, str) for x in entry):
        return "\n".join(entry)
    return entry if isinstance(entry, str) else None


def virtual_files(path: tuple[str, ...], value: Any):
    if not at_state(path, "files") or not isinstance(value, dict):
        return None
    found = []
    for name, entry in sorted(value.items()):
        content = file_content(entry)
        place = "<deleted>" if entry is None else "<unreadable>" if content is None else digest_of(content)
        found.append(("carried", f"file:{name}", content, place))
    return found


def todo_list(path: tuple[str, ...], value: Any):
    if not at_state(path, "todos") or not isinstance(value, list):
        return None
    text = json.dumps(value, sort_keys=True)
    return [("created", f"plan:{sum(not (isinstance(x, dict) and x.get('status') == 'completed') for x in value)} open", text, digest_of(text))]


def skills(path: tuple[str, ...], value: Any):
    if not at_state(path, "skills_metadata") or not isinstance(value, list) or not all(isinstance(x, dict) and x.get("name") for x in value):
        return None
    rows = sorted((x["name"], json.dumps(x, sort_keys=True)) for x in value)
    return [("carried", f"skill:{name}", text, digest_of(text)) for name, text in rows]


BUILT_IN: tuple[Extractor, ...] = (virtual_files, todo_list, skills)


def walk(value: Any, extractors: tuple[Extractor, ...], path: tuple[str, ...] = ()) -> tuple[Any, list[tuple]]:
    """(the value with claimed parts replaced by placeholders, the assets): the extractor registered last is asked first; one that fails is skipped."""
    for extractor in reversed(extractors):
        try:
            claimed = extractor(path, value)
        except Exception:  # noqa: BLE001  an extractor's fault costs its claim only
            continue
        if claimed is not None:
            return [x[3] for x in claimed], [(".".join(path), *x) for x in claimed]
    if isinstance(value, dict):
        parts = {k: walk(v, extractors, (*path, str(k))) for k, v in value.items()}
        return {k: v for k, (v, _) in parts.items()}, [a for _, found in parts.values() for a in found]
    return value, []


SCHEMA = "run_id string, key_path string, role string, kind string, content string, cid string"


def extract(states: DataFrame, extractors: tuple[Extractor, ...] = BUILT_IN) -> DataFrame:
    """Assets of states (run_id, state as JSON), first claim wins within a state."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for run_id, state in zip(frame["run_id"], frame["state"], strict=True):
                seen = set()
                for row in walk(json.loads(state), extractors)[1] if state else []:
                    if row[4] not in seen:
                        seen.add(row[4])
                        out.append((run_id, *row))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return states.select("run_id", "state").mapInPandas(run, SCHEMA)

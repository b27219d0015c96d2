"""File versions: what is new at a path, what it replaced, and how edits are replayed in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import digest
from ..functions.policy import Policy, content_key, content_state


def version_chain(observations: DataFrame, keys: list[str], path: str, cid: str, seq: str) -> DataFrame:
    """New (path, cid) pairs with dense version numbers and the version that each replaced.

    The pairs are aggregated before the window, so a path is sorted by its versions and not by its observations.
    """
    firsts = observations.groupBy(*keys, path, cid).agg(F.min(seq).alias("first_seq"), F.count("*").alias("n_seen"))
    w = Window.partitionBy(*keys, path).orderBy("first_seq")
    return firsts.withColumn("file_version", F.row_number().over(w)).withColumn("replaced", F.lag(cid).over(w))


def supersessions(observations: DataFrame, keys: list[str], path: str, cid: str, seq: str) -> DataFrame:
    """Each observation that changes what is current at a path: (…, created, replaced). A revert creates nothing but replaces."""
    w = Window.partitionBy(*keys, path).orderBy(seq)
    rows = observations.withColumn("replaced", F.lag(cid).over(w)).filter(~F.col("replaced").eqNullSafe(F.col(cid)))
    return rows.withColumn("created", F.row_number().over(Window.partitionBy(*keys, path, cid).orderBy(seq)) == 1)


def file_versions(documents: DataFrame, policy: Policy) -> DataFrame:
    """Documents as observations of the file ``source`` in the order of doc_id -> a row for each version."""
    seen = documents.select(
        F.col("source").alias("file_path"), F.col("doc_id"), digest(F.coalesce("text", F.lit(""))).alias("content_cid"), F.octet_length("text").cast("bigint").alias("content_bytes"), "text"
    )
    first = seen.groupBy("file_path", "content_cid").agg(F.min("doc_id").alias("first_seq"), F.any_value("content_bytes").alias("content_bytes"), F.any_value(F.col("text").isNull()).alias("unknown"))
    w = Window.partitionBy("file_path").orderBy("first_seq")
    disposition = policy.decide(F.col("file_path"), F.col("content_bytes"))
    state = content_state(F.when(~F.col("unknown"), F.lit("")), F.lit("Wrote"), disposition)
    return first.select(
        "file_path", F.row_number().over(w).alias("file_version"), content_key(F.col("file_path"), F.col("content_cid"), state).alias("cid"),
        F.lag("content_cid").over(w).alias("replaced"), state.alias("content_state"),
        F.when(state == "withheld", disposition).alias("withheld_because"), "content_bytes", "first_seq",
    )


class LineEdit:
    """Replay of edits on held content, as one ordered fold per session."""

    @staticmethod
    def lines(text: str) -> list[str]:
        return [x for x in text.replace("\n", "\n\0").split("\0") if x]

    @classmethod
    def apply(cls, held: str, old: str, new: str) -> tuple[str | None, str | None]:
        rows = cls.lines(held)
        bare = [r[:-2] if r.endswith("\r\n") else r.removesuffix("\n") for r in rows]
        gone, added = ([x[:-1] if x.endswith("\n") else x for x in cls.lines(t)] for t in (old, new))
        places = [i for i in range(len(bare) - len(gone) + 1) if gone and bare[i : i + len(gone)] == gone]
        if len(places) != 1:
            return None, "Ambiguous" if places else "NotFound"
        end = places[0] + len(gone)
        if end == len(rows) and not rows[-1].endswith("\n"):
            return None, "UnterminatedAtEof"
        if added and any(r.endswith("\r\n") for r in rows):
            return None, "TerminatorsNotEstablished"
        return "".join(rows[: places[0]] + [f"{x}\n" for x in added] + rows[end:]), None


FOLDED = "session_id string, seq bigint, path string, mode string, content string, refusal string, recovered boolean"


def replay(observations: DataFrame) -> DataFrame:
    """Observations of files (session_id, seq, path, mode, content, old, new, replace_all, line_oriented, replay_from), folded in order.

    Content that is given is held; an edit is applied to what is held of its path (or of the path it moves from), and when that
    can't be proved the path's content becomes unknown; a deletion forgets it.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, str | None] = {}
        out = []
        for r in rows.sort_values("seq").itertuples(index=False):
            content, refusal, recovered = r.content, None, False
            if content is None and r.old is not None and r.mode != "Deleted":
                base = held.get(r.replay_from or r.path)
                if base is None:
                    refusal = "NotHeld"
                elif r.line_oriented:
                    content, refusal = LineEdit.apply(base, r.old, r.new or "")
                elif r.old in base:
                    content = base.replace(r.old, r.new or "", -1 if r.replace_all else 1)
                else:
                    refusal = "NotFound"
                recovered = content is not None
            if r.replay_from and r.replay_from != r.path:
                held.pop(r.replay_from, None)
            held[r.path] = None if r.mode == "Deleted" else content
            out.append((r.session_id, r.seq, r.path, r.mode, content, refusal, recovered))
        return pd.DataFrame(out, columns=[c.split()[0] for c in FOLDED.split(", ")])

    return observations.groupBy("session_id").applyInPandas(fold, FOLDED)


def patch_observations(patch: str | None) -> Iterator[dict]:
    """What a patch document says about files, block by block; a block whose place can't be known names the path only."""
    block: dict | None = None

    def close():
        if block is None:
            return
        if block["kind"] == "add":
            yield {"path": block["path"], "mode": "Wrote", "content": "\n".join(block["lines"]) + "\n", "hunks": []}
        else:
            end_hunk()
            known = block["hunks"] and not block["loose"]
            to = block["to"] or block["path"]
            yield {"path": to, "mode": "Wrote", "content": None, "hunks": block["hunks"] if known else [], "replay_from": block["path"] if block["to"] and known else None, "vacated": block["path"] if block["to"] else None}

    def end_hunk():
        before, after = block["before"], block["after"]
        block["before"], block["after"] = [], []
        if not before:
            block["loose"] |= bool(after)
        elif before != after:
            block["hunks"].append(tuple("".join(f"{x}\n" for x in side) for side in (before, after)))

    for line in (patch or "").splitlines():
        verb, _, rest = line.partition(": ")
        if verb in ("*** Add File", "*** Update File", "*** Delete File"):
            yield from close()
            block = None
            if verb == "*** Delete File":
                yield {"path": rest.strip(), "mode": "Deleted", "content": None, "hunks": []}
            elif verb == "*** Add File":
                block = {"kind": "add", "path": rest.strip(), "lines": []}
            else:
                block = {"kind": "update", "path": rest.strip(), "to": None, "hunks": [], "loose": False, "before": [], "after": []}
        elif line.startswith("*** End Patch"):
            yield from close()
            block = None
        elif block is None:
            continue
        elif block["kind"] == "add":
            if line.startswith("+"):
                block["lines"].append(line[1:])
        elif verb == "*** Move to":
            block["to"] = rest.strip()
        elif line.startswith("@@"):
            end_hunk()
        elif line[:1] in ("-", "+", " "):
            if line[0] != "+":
                block["before"].append(line[1:])
            if line[0] != "-":
                block["after"].append(line[1:])
    yield from close()


def result_observations(result) -> list[dict]:
    """What a tool result says about files, by its shape and never by the tool's name."""
    if not isinstance(result, dict):
        return []
    file = result.get("file")
    if isinstance(file, dict) and isinstance(file.get("filePath"), str):
        n, total = file.get("numLines"), file.get("totalLines")
        part = file.get("startLine", 1) != 1 or (n is not None and total is not None and n < total) or bool(file.get("truncatedByTokenCap"))
        content = file.get("content") if isinstance(file.get("content"), str) else None
        return [{"path": file["filePath"], "mode": "Read", "content": None if part else content}]
    path = result.get("filePath")
    if not isinstance(path, str):
        return []
    old, new, original = (result.get(k) if isinstance(result.get(k), str) else None for k in ("oldString", "newString", "originalFile"))
    if old is not None and new is not None:
        seen = [{"path": path, "mode": "Read", "content": original}] if original is not None else []
        after = original.replace(old, new, -1 if result.get("replaceAll") else 1) if original is not None and old in original else None
        return [*seen, {"path": path, "mode": "Wrote", "content": after, "old": old, "new": new, "replace_all": bool(result.get("replaceAll"))}]
    if isinstance(result.get("content"), str):
        return [{"path": path, "mode": "Wrote", "content": result["content"]}]
    return []

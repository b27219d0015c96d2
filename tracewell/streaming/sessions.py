"""Sessions as keyed state: events in order are folded, a session's row is emitted as it ends or as input does."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SUMMARY = "session_id string, incarnation int, n_events bigint, n_prompts bigint, n_tools bigint, n_failed bigint, n_unknown bigint, ended boolean"
STATE = "incarnation int, n_events bigint, n_prompts bigint, n_tools bigint, n_failed bigint, n_unknown bigint"
EMPTY = (0, 0, 0, 0, 0)


def fold(key: str, rows: pd.DataFrame, state: tuple) -> tuple[list[tuple], tuple]:
    """(rows of sessions that ended, state after) of a session's events in order (seq, event, is_error)."""
    incarnation, *n = state
    out = []
    for r in rows.sort_values("seq").itertuples(index=False):
        n[0] += 1
        n[1] += r.event == "PromptSubmitted"
        if r.event == "ToolCallEnded":
            n[2] += 1
            n[3] += r.is_error is True or r.is_error == True and not pd.isna(r.is_error)  # noqa: E712
            n[4] += bool(pd.isna(r.is_error))
        if r.event == "SessionEnded":
            out.append((key, incarnation, *n, True))
            incarnation, n = incarnation + 1, list(EMPTY)
    return out, (incarnation, *n)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SUMMARY.split(", ")])


def summarise_batch(events: DataFrame) -> DataFrame:
    """Of all lineage events (session_id, seq, event, is_error): a row for each incarnation of each session.

    The rows of ``summarise_stream`` as plain aggregations: an incarnation is numbered by the ends before it.
    """
    ends = lambda: F.col("event") == "SessionEnded"
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    tool = F.col("event") == "ToolCallEnded"
    numbered = events.withColumn("incarnation", F.coalesce(F.sum(ends().cast("int")).over(w), F.lit(0)).cast("int"))
    return numbered.groupBy("session_id", "incarnation").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("event") == "PromptSubmitted").alias("n_prompts"), F.count_if(tool).alias("n_tools"),
        F.count_if(tool & F.coalesce(F.col("is_error"), F.lit(False))).alias("n_failed"), F.count_if(tool & F.col("is_error").isNull()).alias("n_unknown"),
        F.coalesce(F.bool_or(ends()), F.lit(False)).alias("ended"),
    )


def summarise_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The same over a stream: a row as a session ends, and as it has been idle so long; later events open it anew."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else (0, *EMPTY)
        if state.hasTimedOut:
            state.remove()
            if held[1]:
                yield _frame([(key[0], *held, False)])
            return
        frames = list(batches)
        done, held = fold(key[0], pd.concat(frames), held) if frames else ([], held)
        state.update(held)
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        if done:
            yield _frame(done)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return events.groupBy("session_id").applyInPandasWithState(run, SUMMARY, STATE, "append", timeout)


def attribute(events: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with their session, orphans): an event's own session, else that of its scope's nearest known ancestor; never guessed.

    ``scopes`` has (node, parent, session_id).
    """
    from ..operators.hierarchy import inherit

    known = inherit(scopes, "session_id").select(F.col("node").alias("parent_uuid"), F.col("session_id").alias("inherited"))
    found = events.join(known, "parent_uuid", "left").withColumn("session_id", F.coalesce("own_session", "inherited")).drop("inherited")
    return found.filter(F.col("session_id").isNotNull()), found.filter(F.col("session_id").isNull())

"""Starts meet ends, calls meet what surrounds them: equi-joins, and as-of joins by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_calls(starts: DataFrame, ends: DataFrame, key: str, keep_lone_ends: bool) -> DataFrame:
    """One row for each call that ended; repeated ends count once. A tool's end without a start is kept, a model call's isn't."""
    once = ends.dropDuplicates([key])
    return once.join(starts.dropDuplicates([key]), key, "left" if keep_lone_ends else "inner")


def next_end(events: DataFrame, session: str, seq: str, is_start: Column, is_end: Column, value: Column) -> DataFrame:
    """Each start with the first end after it in its session, if there is one."""
    # From the session's end backwards the frame only grows, so each row is visited once.
    w = Window.partitionBy(session).orderBy(F.col(seq).desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = F.last(F.when(is_end, F.struct(F.col(seq).alias("seq"), value.alias("value"))), ignorenulls=True).over(w)
    return events.withColumn("end", found).filter(is_start).select(session, F.col(seq).alias("start_seq"), F.col("end.seq").alias("end_seq"), F.col("end.value").alias("end_value"))


def carried(value: Column, session: str, seq: str, before: bool = False) -> Column:
    """The latest non-null value so far in the session."""
    w = Window.partitionBy(session).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return F.last(value, ignorenulls=True).over(w)


def running(delta: Column, session: str, seq: str) -> Column:
    """A running count per session."""
    return F.sum(delta).over(Window.partitionBy(session).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))


def performer(turn_agent: Column, live: Column, sole: Column) -> Column:
    """Who performs an act: the delegated turn's agent, the sole live subagent, or the root; several live ones are ambiguous."""
    return F.when(turn_agent.isNotNull(), "delegated-turn").when(live == 1, "sole-live-subagent").when(live > 1, "ambiguous-parallel-subagents").otherwise("root-agent")


def first_match(rows: DataFrame, key: str, globs: list[tuple[int, str]], value: Column) -> DataFrame:
    """Rows with the number of the first block whose glob fits; null if none does."""
    from ..functions.text import glob_match

    chain = F.lit(None).cast("int")
    for number, glob in sorted(globs, reverse=True):
        chain = F.when(glob_match(value, [glob]), F.lit(number)).otherwise(chain)
    return rows.withColumn(key, chain)

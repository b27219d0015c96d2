"""Runs from callbacks: starts meet their ends, suspended runs are no failures, and runs worth recording are told from a framework's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metadata import names_framework
from ..sources.callbacks import ENDS, ERRORS, STARTS
from .hierarchy import inherited

#: Fixed value: an error of this class, or one that inherits from it, only steers a graph.
CONTROL_FLOW = "GraphBubbleUp"


def steers(error_mro: Column) -> Column:
    """Whether an error is control flow: a suspended run, no failure."""
    return F.coalesce(F.array_contains(error_mro, CONTROL_FLOW), F.lit(False))


def pair_runs(callbacks: DataFrame) -> DataFrame:
    """(run_id, parent_run_id, kind, name, metadata, start_seq, end_seq, outcome) of every run that started.

    The outcome is ended, failed, suspended (it met only control flow) or open. A run's first end counts, ends of runs that never started don't.
    """
    said = F.col("callback")
    starts = callbacks.filter(said.isin(*STARTS))
    first = starts.groupBy("run_id").agg(F.min_by(F.struct("seq", "parent_run_id", "name", "metadata", "callback"), "seq").alias("s"))
    ends = callbacks.filter(said.isin(*ENDS, *ERRORS)).withColumn("steers", said.isin(*ERRORS) & steers(F.col("error_mro")))
    last = ends.groupBy("run_id").agg(
        F.min(F.when(~F.col("steers"), F.struct("seq", "callback"))).alias("e"), F.min(F.when(F.col("steers"), F.col("seq"))).alias("suspended_at")
    )
    outcome = F.when(F.col("e.callback").isin(*ERRORS), "failed").when(F.col("e").isNotNull(), "ended").when(F.col("suspended_at").isNotNull(), "suspended").otherwise("open")
    kind = F.regexp_extract("s.callback", "^on_(.*)_start$", 1)
    return first.join(last, "run_id", "left").select(
        "run_id", "s.parent_run_id", kind.alias("kind"), "s.name", "s.metadata", F.col("s.seq").alias("start_seq"), F.coalesce("e.seq", "suspended_at").alias("end_seq"), outcome.alias("outcome")
    )


def boundaries(nodes: DataFrame, value: str) -> DataFrame:
    """The rows of (node, parent, value) whose own value differs from what they would inherit."""
    above = inherited(nodes, value).withColumnsRenamed({"node": "__of", value: "__above"})
    found = nodes.join(above, F.col("node") == F.col("__of"), "left").filter(F.col(value).isNotNull() & ~F.col(value).eqNullSafe(F.col("__above")))
    return found.drop("__of", "__above")


def tracked(runs: DataFrame, agent: str = "lc_agent_name") -> DataFrame:
    """The runs that are a graph (no parent), a node of it or the start of another agent, with a label: the agent's name, the node's, else the run's."""
    meta = lambda key: F.get(F.map_values(F.map_filter("metadata", lambda k, v: k == key)), F.lit(0))
    nodes = runs.select(F.col("run_id").alias("node"), F.col("parent_run_id").alias("parent"), meta(agent).alias("agent"))
    new = boundaries(nodes, "agent").filter("parent IS NOT NULL").select(F.col("node").alias("run_id"), F.col("agent").alias("subagent"))
    graph, node = F.col("parent_run_id").isNull(), meta("langgraph_node")
    is_node = F.coalesce(F.col("name") == node, F.lit(False))
    label = F.when(F.col("subagent").isNotNull(), F.col("subagent")).when(is_node, node).otherwise(F.coalesce(meta(agent), "name", F.lit("graph")))
    found = runs.join(new, "run_id", "left").withColumns({"is_graph": graph, "is_node": is_node, "label": label})
    return found.filter(F.col("is_graph") | F.col("is_node") | F.col("subagent").isNotNull())


def concurrent_roots(callbacks: DataFrame, handler: str) -> DataFrame:
    """(handler, run_id, seq, n_open) of root runs that started while another of their handler was open."""
    said = F.col("callback")
    roots = callbacks.filter(said.isin(*STARTS) & F.col("parent_run_id").isNull()).select("run_id").distinct()
    step = F.when(said.isin(*STARTS), 1).otherwise(-1)
    rows = callbacks.join(roots, "run_id", "left_semi").withColumn("step", step)
    w = Window.partitionBy(handler).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("n_open", F.sum("step").over(w)).filter((F.col("step") == 1) & (F.col("n_open") > 1)).select(handler, "run_id", "seq", "n_open")


def frameworks(callbacks: DataFrame, handler: str) -> DataFrame:
    """(handler, framework): what the first run that says so names, else langchain."""
    named = callbacks.withColumn("__named", names_framework("metadata"))
    found = named.groupBy(handler).agg(F.min(F.when(F.col("__named").isNotNull(), F.struct("seq", "__named"))).alias("f"))
    return found.select(handler, F.coalesce("f.__named", F.lit("langchain")).alias("framework"))


def renderings(reads: DataFrame, versions: DataFrame) -> DataFrame:
    """Reads (run_id, path, content, window map) of paths that no version is known of, each distinct rendering once a run: inputs only, never the file itself."""
    unseen = reads.filter(F.length("content") > 0).join(versions.select("path").distinct(), "path", "left_anti")
    window = F.map_from_entries(F.array_sort(F.map_entries("window")))
    payload = F.to_json(F.struct("path", F.col("content").alias("read"), F.when(F.size("window") > 0, window).alias("window")))
    return unseen.select("run_id", "path", F.sha2(payload, 256).alias("rendering_id"), payload.alias("payload")).distinct()


def consumes_current(uses: DataFrame, versions: DataFrame) -> DataFrame:
    """Uses (path, cid, …) with ``current``: whether the bytes are those of the path's latest version (path, cid, seq)."""
    latest = versions.groupBy(F.col("path").alias("__path")).agg(F.max_by("cid", "seq").alias("__cid"))
    return uses.join(latest, F.col("path") == F.col("__path"), "left").withColumn("current", F.coalesce(F.col("cid") == F.col("__cid"), F.lit(False))).drop("__path", "__cid")


def shed_stale(losses: DataFrame, bound: int = 1024) -> DataFrame:
    """Losses (session_id, n_lost, is_open, seq) of at most ``bound`` sessions: those that are open stay before those that ended, later ones before earlier ones."""
    return losses.orderBy(F.col("is_open").desc(), F.col("seq").desc(), "session_id").limit(bound)

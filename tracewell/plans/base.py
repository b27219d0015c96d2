"""The registry of queries, and the driver tables in the roles they play."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a table reader; ``sql`` is the same in DuckDB."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Events stand for a host stream: user_id is the session, event_id the order.
HOST = """host AS (SELECT user_id AS session_id, event_id AS seq, ts,
  CASE WHEN event_type = 'signup' THEN 'mark' ELSE 'scope' END AS kind,
  CASE event_type WHEN 'view' THEN 'custom' WHEN 'signup' THEN NULL ELSE 'tool' END AS category,
  CASE WHEN event_type IN ('purchase', 'error') THEN 'end' WHEN event_type = 'signup' THEN NULL ELSE 'start' END AS scope_category,
  CASE WHEN event_type = 'signup' THEN 'session.start' ELSE event_type END AS name,
  CASE event_type WHEN 'purchase' THEN CASE WHEN value < 20 THEN NULL ELSE 'ok' END WHEN 'error' THEN 'failed' END AS status,
  value, props FROM events)"""


def host(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), "ts", F.when(kind == "signup", "mark").otherwise("scope").alias("kind"),
        F.when(kind == "view", "custom").when(kind != "signup", "tool").alias("category"),
        F.when(kind.isin("purchase", "error"), "end").when(kind != "signup", "start").alias("scope_category"),
        F.when(kind == "signup", "session.start").otherwise(kind).alias("name"),
        F.when((kind == "purchase") & (F.col("value") >= 20), "ok").when(kind == "error", "failed").alias("status"), "value", "props",
    )


def lineage(events: DataFrame) -> DataFrame:
    """Host events with the lineage event they stand for, and the outcome."""
    from ..operators.classify import event_name, outcome

    none = F.lit(None).cast("string")
    turn = F.when(F.col("name") == "view", "turn")
    name = event_name(F.col("kind"), F.col("name"), none, F.col("category"), F.col("scope_category"), turn, F.when(F.col("name") == "view", F.col("props")), F.lit(False))
    return host(events).withColumn("event", name).withColumn("is_error", outcome(F.col("status")))


LINEAGE = f"""{HOST}, lineage AS (SELECT *, CASE WHEN kind = 'mark' THEN 'SessionStarted' WHEN category = 'custom' THEN 'PromptSubmitted'
  WHEN scope_category = 'end' THEN 'ToolCallEnded' ELSE 'ToolCallStarted' END AS event,
  CASE WHEN status = 'failed' THEN true WHEN status = 'ok' THEN false END AS is_error FROM host)"""


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")

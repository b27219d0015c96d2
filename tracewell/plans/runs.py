"""Queries over callbacks: the events of a user are a handler's callbacks, two of them a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metadata
from ..operators import runs
from .base import big, query

CALLBACKS = """cb AS (SELECT event_id AS seq, user_id AS handler, CAST(event_id // 2 AS VARCHAR) AS run_id, event_type, value,
  CASE WHEN event_id % 2 = 0 THEN CASE event_type WHEN 'view' THEN 'on_chain_start' WHEN 'click' THEN 'on_tool_start' ELSE 'on_chat_model_start' END
       WHEN event_type = 'error' THEN 'on_chain_error' ELSE 'on_tool_end' END AS callback FROM events)"""


def callbacks(t):
    """Events as callbacks; every other event ends the run that the one before started."""
    kind, start = F.col("event_type"), F.col("event_id") % 2 == 0
    name = F.when(start, F.when(kind == "view", "on_chain_start").when(kind == "click", "on_tool_start").otherwise("on_chat_model_start")).when(kind == "error", "on_chain_error").otherwise("on_tool_end")
    mro = F.when(F.col("value") < 50, F.array(F.lit("Interrupt"), F.lit("GraphBubbleUp"))).otherwise(F.array(F.lit("ValueError")))
    meta = F.when(F.col("event_id") % 7 == 0, F.create_map(F.lit("ls_integration"), kind)).when(F.col("event_id") % 11 == 0, F.create_map(F.lit("langgraph_step"), F.lit("1")))
    return t("events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("handler"), F.expr("CAST(event_id div 2 AS STRING)").alias("run_id"), F.lit(None).cast("string").alias("parent_run_id"),
        name.alias("callback"), kind.alias("name"), meta.alias("metadata"), mro.alias("error_mro"),
    )


@query(f"""WITH {CALLBACKS} SELECT s.run_id, regexp_extract(s.callback, '^on_(.*)_start$', 1) AS kind, s.seq AS start_seq, e.seq AS end_seq,
  CASE WHEN e.seq IS NULL THEN 'open' WHEN e.callback = 'on_tool_end' THEN 'ended' WHEN e.value < 50 THEN 'suspended' ELSE 'failed' END AS outcome
FROM cb s LEFT JOIN cb e ON e.run_id = s.run_id AND e.seq % 2 = 1 WHERE s.seq % 2 = 0""")
def paired_runs(t):
    """Runs with their ends: control flow suspends a run, other errors fail it."""
    return runs.pair_runs(callbacks(t)).select("run_id", "kind", "start_seq", "end_seq", "outcome")


@query(f"""WITH {CALLBACKS}, steps AS (SELECT *, sum(CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END) OVER (PARTITION BY handler ORDER BY seq ROWS UNBOUNDED PRECEDING) AS n_open
  FROM cb WHERE run_id IN (SELECT run_id FROM cb WHERE seq % 2 = 0)) SELECT handler, run_id, seq, CAST(n_open AS BIGINT) AS n_open FROM steps WHERE seq % 2 = 0 AND n_open > 1""")
def concurrent_runs(t):
    """Root runs that started while another of their handler was open."""
    return runs.concurrent_roots(callbacks(t), "handler")


@query("""WITH named AS (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN event_type WHEN event_id % 11 = 0 THEN 'langgraph' END AS f FROM events)
SELECT user_id AS handler, coalesce(arg_min(f, event_id) FILTER (f IS NOT NULL), 'langchain') AS framework FROM named GROUP BY 1""")
def run_frameworks(t):
    """The framework of each handler: what its first run that says so names."""
    return runs.frameworks(callbacks(t), "handler")


@query("""SELECT event_id, '{"a":{"api_key":"[redacted]","n":[{"token":"[redacted]","tokens":' || CAST(event_id AS VARCHAR) || '}]},"author":"' || event_type || '","authorization":"[redacted]"}' AS params FROM events""")
def nested_params(t):
    """Nested parameters with secrets replaced at any depth."""
    raw = F.concat(F.lit('{"a":{"api_key":{"x":1},"n":[{"token":"'), "event_type", F.lit('","tokens":'), F.col("event_id").cast("string"), F.lit('}]},"author":"'), "event_type", F.lit('","authorization":["'), "event_type", F.lit('"]}'))
    return t("events").select("event_id", metadata.redact_json(raw).alias("params"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '{"retriever":"r"}' WHEN page_id % 3 = 1 THEN '{"retriever":"r","class":"C","config":{"index":"' || CAST(page_id AS VARCHAR) || '","token":"[redacted]"}}'
ELSE '{"retriever":"r","tags":["a","b"]}' END AS identity FROM pages""")
def retriever_identities(t):
    """What identifies retrievers beside their name."""
    k = F.col("page_id") % 3
    none = F.lit(None).cast("map<string,string>")
    meta = F.when(k == 1, F.create_map(F.lit("token"), F.lit("x"), F.lit("index"), F.col("page_id").cast("string"), F.lit("ls_retriever_name"), F.lit("C"))).otherwise(F.coalesce(none, F.create_map().cast("map<string,string>")))
    tags = F.when(k == 2, F.array(F.lit("b"), F.lit("seq:step:1"), F.lit("a"))).otherwise(F.array().cast("array<string>"))
    return t("pages").select("page_id", metadata.retriever_identity(F.lit("r"), meta, tags).alias("identity"))


@query("SELECT event_id, event_type = 'error' OR event_id % 5 = 0 AS failed FROM events")
def tool_errors(t):
    """Tool results that report a failure, by status or by text."""
    status = F.when(F.col("event_type") == "error", "error")
    text = F.when(F.col("event_id") % 5 == 0, "  Error: no file").otherwise("An Error")
    return t("events").select("event_id", metadata.is_tool_error(status, text).alias("failed"))


@query("""WITH u AS (SELECT doc_id, source AS path, sha256(coalesce(text, '')) AS cid FROM documents), latest AS (SELECT path, arg_max(cid, doc_id) AS cid FROM u GROUP BY 1)
SELECT doc_id, coalesce(u.cid = latest.cid, false) AS current FROM u LEFT JOIN latest USING (path)""")
def current_uses(t):
    """Whether a computation consumed the current bytes of a path."""
    used = t("documents").select("doc_id", F.col("source").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("cid"))
    return runs.consumes_current(used, used.withColumnRenamed("doc_id", "seq")).select("doc_id", "current")


@query("""SELECT DISTINCT page_id AS run_id, url AS path FROM pages WHERE length(html) > 0 AND page_id % 4 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 0 AND url IS NOT NULL)""")
def read_renderings(t):
    """Reads of paths that were never written: renderings that a run consumed."""
    p = t("pages")
    window = F.create_map(F.lit("offset"), F.col("page_id").cast("string"))
    reads = p.filter(F.col("page_id") % 4 != 0).select(F.col("page_id").alias("run_id"), F.col("url").alias("path"), F.col("html").alias("content"), window.alias("window"))
    return runs.renderings(reads, p.filter(F.col("page_id") % 4 == 0).select(F.col("url").alias("path"))).select("run_id", "path")


@query("SELECT l_orderkey, count(*) AS n_calls, count(DISTINCT l_linenumber) AS n_subjects, count(*) = count(DISTINCT l_linenumber) AS all_distinct FROM lineitem GROUP BY 1")
def distinct_descriptions(t):
    """Whether the descriptions of a run's calls are about a subject each."""
    found = t("lineitem").groupBy("l_orderkey").agg(big(F.count("*")).alias("n_calls"), big(F.count_distinct("l_linenumber")).alias("n_subjects"))
    return found.withColumn("all_distinct", F.col("n_calls") == F.col("n_subjects"))

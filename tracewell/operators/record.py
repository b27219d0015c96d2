"""From lineage events to the graph's tables: actors, calls, tool runs, their assets and computations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import actor_descriptor, digest
from ..functions.policy import Policy
from .classify import turn_author
from .pairing import carried, pair_calls


def payload(kind: str, text: Column, policy: Policy, quotes: Column | None = None) -> Column:
    """A struct for a non-file asset: its id (of the content, or of the descriptor if it is withheld), kind and state.

    A payload that quotes a denied path is withheld too; ``quotes`` is an array of the paths that it touches.
    """
    cid, size = digest(text), F.octet_length(text)
    denied = F.filter(quotes, lambda p: policy.denies(p)) if quotes is not None else F.array().cast("array<string>")
    why = F.when(F.size(denied) > 0, "Denied").when(size > policy.max_bytes, "TooLarge")
    key = F.when(why.isNull(), cid).otherwise(digest(F.concat(F.lit('{"content-cid":"'), cid, F.lit('","withheld":true}'))))
    return F.when(text.isNotNull(), F.struct(key.alias("cid"), F.lit(kind).alias("kind"), size.cast("bigint").alias("content_bytes"), why.alias("withheld_because"), F.try_element_at(denied, F.lit(1)).alias("withheld_for")))


def actors(events: DataFrame) -> DataFrame:
    """(session_id, kind, name, cid, first_seq): agents, models and tools, once each. Events carry session_id, seq, event, name."""
    kind = F.when(F.col("event").startswith("ModelCall"), "model").when(F.col("event").startswith("ToolCall"), "tool").when(F.col("event").isin("SessionStarted", "SubagentStarted"), "agent")
    named = events.withColumn("kind", kind).filter(F.col("kind").isNotNull() & F.col("name").isNotNull())
    return named.groupBy("session_id", "kind", "name").agg(F.min("seq").alias("first_seq")).withColumn("cid", digest(actor_descriptor("kind", "name")))


def tool_runs(events: DataFrame, policy: Policy) -> DataFrame:
    """Tool calls as computations: [prompt, tool, input] -> [result]; a run without outputs is marked as refused.

    ``events``: session_id, seq, event, call_id, name, text (arguments of a start, result of an end, prompt of a turn), is_error.
    A failed call keeps what it said; an end without a start keeps its own name.
    """
    prompt = carried(F.when(F.col("event") == "PromptSubmitted", F.col("text")), "session_id", "seq")
    seen = events.withColumn("prompt", prompt)
    key = F.concat_ws("/", F.col("session_id").cast("string"), "call_id")
    starts = seen.filter(F.col("event") == "ToolCallStarted").select(key.alias("call"), F.col("name").alias("started_name"), F.col("text").alias("arguments"))
    ends = seen.filter(F.col("event") == "ToolCallEnded").select(key.alias("call"), "session_id", "seq", "name", "prompt", F.col("text").alias("result"), "is_error")
    runs = pair_calls(starts, ends, "call", keep_lone_ends=True)
    name = F.coalesce("started_name", "name")
    tool = digest(actor_descriptor(F.lit("tool"), name))
    assets = [payload(k, F.col(k), policy) for k in ("prompt", "arguments", "result")]
    inputs = F.array_distinct(F.array_compact(F.array(assets[0]["cid"], tool, assets[1]["cid"])))
    outputs = F.array_except(F.array_compact(F.array(assets[2]["cid"])), inputs)
    return runs.select(
        "session_id", "seq", F.concat_ws(":", "call", "seq").alias("comp_id"), name.alias("name"), inputs.alias("inputs"), outputs.alias("outputs"), "is_error",
        F.array_compact(F.array(*assets)).alias("assets"), (F.size(outputs) == 0).alias("refused"),
    )


def model_calls(messages: DataFrame, policy: Policy) -> DataFrame:
    """Answered model calls of (session_id, seq, role, text): [first system message, prompt] -> [completion].

    The turn's prompt is an input of its first answered call only.
    """
    w = Window.partitionBy("session_id").orderBy("seq")
    system = F.first(F.when(F.col("role") == "system", F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    turn = F.last(F.when(F.col("role") == "user", F.col("seq")), ignorenulls=True).over(w)
    prompt = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    answered = messages.withColumn("system", system).withColumn("turn", turn).withColumn("prompt", prompt).filter(F.col("role") == "assistant")
    nth = F.row_number().over(Window.partitionBy("session_id", "turn").orderBy("seq"))
    answered = answered.withColumn("prompt", F.when(nth == 1, F.col("prompt")))
    parts = [payload("system-prompt", F.col("system"), policy), payload("prompt", F.col("prompt"), policy), payload("completion", F.col("text"), policy)]
    inputs = F.array_distinct(F.array_compact(F.array(parts[0]["cid"], parts[1]["cid"])))
    return answered.select(
        "session_id", "seq", F.concat_ws(":", "session_id", "seq").alias("comp_id"), inputs.alias("inputs"), F.array_except(F.array(parts[2]["cid"]), inputs).alias("outputs"), F.array_compact(F.array(*parts)).alias("assets"),
    )


def turns(events: DataFrame) -> DataFrame:
    """Prompts with their author and the counter that a turn of that author adds to."""
    author = turn_author(F.col("text"), F.col("source"), F.col("agent_id"))
    prompts = events.filter(F.col("event") == "PromptSubmitted").withColumn("author", author)
    counter = F.when(F.col("author") == "agent", "TurnDelegatedToAgent").when(F.col("author") == "system", "TurnOpenedByNotification").when(F.col("author") != "user", "TurnOpenedByGateway")
    return prompts.select("session_id", "seq", "author", counter.alias("counter"))


def assets_of(computations: DataFrame) -> DataFrame:
    """Distinct assets (session_id, cid, kind, …) of computations with an array ``assets``, with their first place."""
    each = computations.select("session_id", "seq", F.inline("assets"))
    return each.groupBy("session_id", "cid", "kind").agg(F.min("seq").alias("first_seq"), F.any_value("content_bytes").alias("content_bytes"), F.any_value("withheld_because").alias("withheld_because"))

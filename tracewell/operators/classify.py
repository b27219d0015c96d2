"""From host events to lineage events: pure projections, never looking into payloads to decide what an event is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What statuses mean, which correlations were seen rather than inferred, what hosts inject into prompts, which tools write.
FAILED = ("error", "failed", "failure", "denied")
SUCCEEDED = ("ok", "success", "allow", "allowed")
OBSERVED = ("explicit", "single_hint", "matched_hint", "active_subagent")
INJECTED = ("<task-notification>", "<local-command-caveat>", "<command-name>", "<system-reminder>")
WRITING_TOOLS = ("Write", "Edit", "MultiEdit", "NotebookEdit", "apply_patch")
WORK = ("ToolCallEnded", "ModelCallEnded", "PromptSubmitted", "Compacted")


def outcome(status: Column) -> Column:
    """True if a call failed, false if it succeeded, null if nobody knows: unknown is not false."""
    return F.when(status.isin(*FAILED), True).when(status.isin(*SUCCEEDED), False)


def observed(tool_status: Column, model_status: Column) -> Column:
    """Whether a correlation was observed; anything else, and nothing, is inferred."""
    return F.coalesce(F.coalesce(tool_status, model_status).isin(*OBSERVED), F.lit(False))


def is_subagent_scope(role: Column, uuid: Column, parent: Column) -> Column:
    return F.coalesce(role == "subagent", F.lit(False)) | (parent.isNotNull() & (parent != uuid))


def event_name(kind: Column, name: Column, hook: Column, category: Column, scope: Column, role: Column, prompt: Column, subagent: Column) -> Column:
    """The lineage event that a host event stands for, or null."""
    mark = (
        F.when(name == "session.start", "SessionStarted").when(hook.isin("PreCompact", "PostCompact"), "Compacted")
        .when(hook == "SubagentStart", "SubagentStarted").when(hook == "SubagentStop", "SubagentEnded")
    )
    end = scope == "end"
    span = (
        F.when(category == "llm", F.when(end, "ModelCallEnded").otherwise("ModelCallStarted"))
        .when(category == "tool", F.when(end, "ToolCallEnded").otherwise("ToolCallStarted"))
        .when((category == "custom") & ~end & (role == "turn") & prompt.isNotNull(), "PromptSubmitted")
        .when((category == "agent") & subagent, F.when(end, "SubagentEnded").otherwise("SubagentStarted"))
        .when((category == "agent") & end, "SessionEnded")
    )
    return F.when(kind == "mark", mark).when(kind == "scope", span)


def may_carry_lineage(kind: Column, name: Column, hook: Column) -> Column:
    """Whether a lost event could have mattered; over-counts on purpose."""
    return ~kind.eqNullSafe("mark") | name.eqNullSafe("session.start") | hook.isNotNull()


def completes_work(event: Column) -> Column:
    return event.isin(*WORK)


def turn_author(text: Column, source: Column, agent_id: Column) -> Column:
    """Who opened a turn: an agent, the gateway, a notification of the host (its tag leads the text), or the user."""
    tag = f"^({'|'.join(INJECTED)})"
    return (
        F.when(agent_id.isNotNull(), "agent").when(source.isNotNull() & (source != "user_prompt"), source)
        .when(F.ltrim(text).rlike(tag), "system").otherwise("user")
    )


def file_mode(tool: Column) -> Column:
    return F.when(tool.isin(*WRITING_TOOLS), "Wrote").otherwise("Read")


def argument_path(file_path: Column, camel_path: Column, path: Column, notebook_path: Column) -> Column:
    """The first path argument that is there, unless it is empty."""
    return F.nullif(F.coalesce(file_path, camel_path, path, notebook_path), F.lit(""))


def is_fragment(start_line: Column, n_lines: Column, total_lines: Column, truncated: Column) -> Column:
    """Whether a read saw only part of a file."""
    return F.coalesce(start_line != 1, F.lit(False)) | F.coalesce(n_lines < total_lines, F.lit(False)) | F.coalesce(truncated, F.lit(False))


def _text(variant: str, path: str) -> Column:
    """A string at a path of a variant, null if it isn't a string there."""
    value = F.expr(f"try_variant_get({variant}, '{path}')")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(F.col(variant), path, "string"))


def classify(events: DataFrame, role_key: str = "scope_role") -> DataFrame:
    """Decoded host events (schemas.EVENT) -> lineage events; events without one are dropped.

    ``role_key`` is the metadata key under which the host states a scope's role (turn, subagent).
    """
    meta = lambda k: _text("metadata", f"$.{k}")
    hook, role = meta("hook_event_name"), meta(role_key)
    prompt = _text("data", "$.prompt")
    end = F.col("scope_category") == "end"
    named = F.coalesce(meta("agent_type"), meta("subagent_type"), F.nullif("name", F.lit("")))
    out = events.select(
        "*",
        event_name(F.col("kind"), F.col("name"), hook, F.col("category"), F.col("scope_category"), role, prompt, is_subagent_scope(role, F.col("uuid"), F.col("parent_uuid"))).alias("event"),
        meta("session_id").alias("own_session"), outcome(meta("status")).alias("is_error"),
        observed(meta("tool_correlation_status"), meta("llm_correlation_status")).alias("observed"),
        prompt.alias("text"), meta("turn_source").alias("source"), meta("agent_id").alias("agent_id"),
        F.when(F.col("category") == "agent", named).otherwise(meta("agent_type")).alias("agent_kind"),
        F.coalesce(meta("subagent_id"), meta("agent_id"), F.col("uuid")).alias("subagent_id"),
        F.coalesce(_text("category_profile", "$.tool_call_id"), F.col("uuid")).alias("call_id"),
        F.when(hook == "PreCompact", "Before").when(hook == "PostCompact", "After").alias("phase"), end.alias("is_end"),
    )
    return out.filter(F.col("event").isNotNull())

"""Queries of event streams: classification, pairing, hierarchy and coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import classify, graph, hierarchy, pairing, runs
from .base import HOST, LINEAGE, big, host, lineage, query


@query(f"WITH {LINEAGE} SELECT session_id, seq, event, is_error FROM lineage")
def classified_events(t):
    """Host events as lineage events with a three-valued outcome."""
    return lineage(t("events")).select("session_id", "seq", "event", "is_error")


@query(f"""WITH {HOST} SELECT seq, NOT (kind = 'mark') OR name = 'session.start' AS may_carry, coalesce(coalesce(status, name) IN ('explicit', 'single_hint', 'matched_hint', 'active_subagent'), false) AS observed,
coalesce(scope_category = 'end', false) AS is_end FROM host""")
def event_predicates(t):
    """Whether a lost event could have mattered, and pessimistic correlation."""
    none = F.lit(None).cast("string")
    return host(t("events")).select(
        "seq", classify.may_carry_lineage(F.col("kind"), F.col("name"), none).alias("may_carry"), classify.observed(F.col("status"), F.col("name")).alias("observed"), F.coalesce(F.col("scope_category") == "end", F.lit(False)).alias("is_end")
    )


@query(f"WITH {LINEAGE} SELECT session_id, event, count(*) AS n, count(*) FILTER (is_error) AS n_failed, count(*) FILTER (event = 'ToolCallEnded' AND is_error IS NULL) AS n_unknown FROM lineage GROUP BY 1, 2")
def event_counters(t):
    """Counters of each session."""
    e = lineage(t("events"))
    return e.groupBy("session_id", "event").agg(F.count("*").alias("n"), F.count_if("is_error").alias("n_failed"), F.count_if((F.col("event") == "ToolCallEnded") & F.col("is_error").isNull()).alias("n_unknown"))


@query(f"""WITH {LINEAGE}, n AS (SELECT session_id, event, count(*) AS n FROM lineage GROUP BY 1, 2)
SELECT session_id, '{{' || string_agg('"' || event || '":' || CAST(n AS VARCHAR), ',' ORDER BY event) || '}}' AS coverage FROM n GROUP BY 1""")
def coverage_maps(t):
    """The counter map of each session as JSON with sorted names."""
    return graph.coverage(lineage(t("events")), ["session_id"], "event")


@query(f"WITH {LINEAGE} SELECT count(*) AS seen, count(*) FILTER (event IS NOT NULL) AS classified, count(*) FILTER (json_extract_string(props, '$.k') = '1') AS undecodable, count(DISTINCT session_id) AS sessions FROM lineage")
def process_tally(t):
    """What the process saw."""
    k = F.get_json_object("props", "$.k")
    return lineage(t("events")).agg(F.count("*").alias("seen"), F.count_if(F.col("event").isNotNull()).alias("classified"), F.count_if(k == "1").alias("undecodable"), F.count_distinct("session_id").alias("sessions"))


@query("SELECT user_id AS session_id, count(*) FILTER (TRY_CAST(json_extract_string(props, '$.k') AS INT) % 7 = 0 AND event_type <> 'signup') AS lost FROM events GROUP BY 1")
def losses(t):
    """Undecodable events that may have carried lineage, charged to their session."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return t("events").groupBy(F.col("user_id").alias("session_id")).agg(F.count_if((k % 7 == 0) & (F.col("event_type") != "signup")).alias("lost"))


@query("""WITH s AS (SELECT user_id, event_id FROM events WHERE event_type = 'click'), e AS (SELECT user_id, event_id, event_type FROM events WHERE event_type IN ('purchase', 'error')),
p AS (SELECT s.user_id, s.event_id AS start_seq, min(e.event_id) AS end_seq FROM s LEFT JOIN e ON e.user_id = s.user_id AND e.event_id > s.event_id GROUP BY 1, 2)
SELECT p.user_id AS session_id, start_seq, end_seq, event_type AS end_value FROM p LEFT JOIN e ON e.event_id = end_seq""")
def tool_calls(t):
    """Each tool start with the first end after it."""
    kind = F.col("event_type")
    found = pairing.next_end(t("events"), "user_id", "event_id", kind == "click", kind.isin("purchase", "error"), kind)
    return found.withColumnRenamed("user_id", "session_id")


@query("""SELECT u.conv_id, u.turn, a.turn AS answered_at, length(a.text) AS n_chars FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")
def model_calls(t):
    """Model calls: a user's turn and the answer to it; starts without ends are no calls."""
    c = t("conversations")
    starts = c.filter(F.col("role") == "user").select("conv_id", "turn", F.concat_ws(":", "conv_id", F.col("turn") + 1).alias("call"))
    ends = c.filter(F.col("role") == "assistant").select(F.col("turn").alias("answered_at"), big(F.length("text")).alias("n_chars"), F.concat_ws(":", "conv_id", "turn").alias("call"))
    return pairing.pair_calls(starts, ends, "call", keep_lone_ends=False).drop("call")


@query("""SELECT e.event_id AS end_seq, s.event_id AS start_seq, coalesce(s.event_type, e.event_type) AS name FROM events e LEFT JOIN events s ON s.event_id = e.event_id - 1 AND s.event_type = 'click' AND s.user_id = e.user_id WHERE e.event_type = 'purchase'""")
def lone_tool_ends(t):
    """Tool ends are kept without a start, under their own name."""
    e = t("events")
    key = lambda shift: F.concat_ws(":", "user_id", F.col("event_id") + shift)
    starts = e.filter("event_type = 'click'").select(key(0).alias("call"), F.col("event_id").alias("start_seq"), F.col("event_type").alias("started"))
    ends = e.filter("event_type = 'purchase'").select(key(-1).alias("call"), F.col("event_id").alias("end_seq"), "event_type")
    return pairing.pair_calls(starts, ends, "call", keep_lone_ends=True).select("end_seq", "start_seq", F.coalesce("started", "event_type").alias("name"))


@query("""WITH u AS (SELECT u.conv_id, u.turn FROM conversations u WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'))
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal FROM u""")
def unanswered_calls(t):
    """Calls without a response, numbered so that equal ones stay apart."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t("conversations").withColumn("next", F.lead("role").over(w)).filter((F.col("role") == "user") & ~F.col("next").eqNullSafe("assistant"))
    return c.select("conv_id", "turn", big(F.row_number().over(w)).alias("ordinal"))


@query("""SELECT conv_id, role, sha256(text) AS cid, lpad(CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY min(turn)) - 1 AS VARCHAR), 4, '0') AS ordinal, min(turn) AS first_seq FROM conversations GROUP BY conv_id, role, text""")
def sealed_conversations(t):
    """Collections of what was said, by kind, with padded ordinals in first-seen order."""
    said = t("conversations").select("conv_id", "role", F.sha2("text", 256).alias("cid"), "turn")
    return graph.seal(said, ["conv_id", "role"], "cid", "turn").drop("withheld")


@query("""WITH m AS (SELECT conv_id, role, sha256(text) AS cid, lpad(CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY min(turn)) - 1 AS VARCHAR), 4, '0') AS o, bool_or(contains(text, '@')) AS w FROM conversations GROUP BY conv_id, role, text)
SELECT conv_id, role, sha256(string_agg(o || ':' || cid, ',' ORDER BY o)) AS cid, count(*) AS n_members, count(*) FILTER (w) AS n_withheld FROM m GROUP BY 1, 2""")
def collections(t):
    """One id for each sealed collection, over its members in order."""
    said = t("conversations").select("conv_id", "role", F.sha2("text", 256).alias("cid"), "turn", F.contains("text", F.lit("@")).alias("withheld"))
    return graph.collections(graph.seal(said, ["conv_id", "role"], "cid", "turn", "withheld").withColumnRenamed("cid", "member"), ["conv_id", "role"], "member")


@query("""SELECT c.conv_id, c.turn, c.role, (SELECT max(u.turn) FROM conversations u WHERE u.conv_id = c.conv_id AND u.turn <= c.turn AND u.role = 'user') AS prompt_turn FROM conversations c""")
def turn_prompts(t):
    """The prompt of the turn that each message belongs to."""
    return t("conversations").select("conv_id", "turn", "role", pairing.carried(F.when(F.col("role") == "user", F.col("turn")), "conv_id", "turn").alias("prompt_turn"))


@query("SELECT conv_id, min(turn) AS turn, arg_min(sha256(text), turn) AS cid FROM conversations WHERE role = 'assistant' GROUP BY 1")
def first_answers(t):
    """The first answered call of each conversation."""
    first = graph.first_in(t("conversations"), ["conv_id"], "turn", F.col("role") == "assistant")
    return first.select("conv_id", "turn", F.sha2("text", 256).alias("cid"))


@query("""SELECT c.conv_id, c.turn, (SELECT list(DISTINCT sha256(p.text) ORDER BY sha256(p.text)) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn // 2 = c.turn // 2 - 1) AS inputs FROM conversations c""")
def superstep_inputs(t):
    """Inputs gain all outputs of the latest earlier step among siblings: an as-of join over dense steps."""
    c = t("conversations").withColumn("step", F.floor(F.col("turn") / 2))
    outputs = c.groupBy("conv_id", "step").agg(F.array_sort(F.collect_set(F.sha2("text", 256))).alias("inputs"))
    w = Window.partitionBy("conv_id").orderBy("step")
    before = outputs.select("conv_id", "step", F.lag("inputs").over(w).alias("inputs"))
    return c.join(before, ["conv_id", "step"]).select("conv_id", "turn", "inputs")


@query("""SELECT event_id, CAST(coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 10 END, count(*) FILTER (event_id % 4 = 0) OVER (PARTITION BY user_id ORDER BY event_id)) AS BIGINT) AS step FROM events""")
def fallback_steps(t):
    """A step counter for runs that carry no step."""
    step = F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 10)
    counted = F.count(F.when(F.col("event_id") % 4 == 0, 1)).over(Window.partitionBy("user_id").orderBy("event_id"))
    return t("events").select("event_id", big(F.coalesce(step, counted)).alias("step"))


@query("""SELECT event_id, CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS live FROM events""")
def live_subagents(t):
    """How many subagents are live at each event."""
    delta = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    return t("events").select("event_id", pairing.running(delta, "user_id", "event_id").alias("live"))


@query("""WITH l AS (SELECT event_id, event_type, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS live FROM events)
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'delegated-turn' WHEN live = 1 THEN 'sole-live-subagent' WHEN live > 1 THEN 'ambiguous-parallel-subagents' ELSE 'root-agent' END AS basis FROM l WHERE event_type = 'click'""")
def performers(t):
    """On what basis an act is attributed to who performed it."""
    delta = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    e = t("events").withColumn("live", pairing.running(delta, "user_id", "event_id")).filter("event_type = 'click'")
    return e.select("event_id", pairing.performer(F.when(F.col("event_id") % 11 == 0, "a"), F.col("live"), F.lit(None)).alias("basis"))


@query("SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL AS is_last FROM events")
def last_chunks(t):
    """The last chunk of each stream, which is held back to be enriched."""
    return t("events").select("event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).isNull().alias("is_last"))


@query("""WITH h AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE event_type IN ('view', 'click'))
SELECT user_id, event_id, sum(CASE WHEN event_type = 'view' OR before IS DISTINCT FROM 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS ordinal FROM h""")
def compaction_ordinals(t):
    """Compactions: a Before opens one, an After only if none is pending."""
    h = t("events").filter(F.col("event_type").isin("view", "click"))
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    fresh = ((F.col("event_type") == "view") | ~before.eqNullSafe("view")).cast("int")
    h = h.withColumn("fresh", fresh)
    return h.select("user_id", "event_id", pairing.running(F.col("fresh"), "user_id", "event_id").alias("ordinal"))


@query("""WITH e AS (SELECT user_id, event_id, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS incarnation FROM events)
SELECT user_id AS session_id, incarnation, count(*) AS n_events, min(event_id) AS first_seq FROM e GROUP BY 1, 2""")
def incarnations(t):
    """A session that goes on after its end is opened anew."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = t("events").withColumn("incarnation", F.count(F.when(F.col("event_type") == "signup", 1)).over(w))
    return e.groupBy(F.col("user_id").alias("session_id"), "incarnation").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_seq"))


@query("""WITH e AS (SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM events)
SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, epoch ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS held FROM e""")
def held_versions(t):
    """The current version before each call; a shell command or a deletion starts an epoch in which nothing is held."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = t("events").withColumn("epoch", F.count(F.when(F.col("event_type") == "error", 1)).over(w))
    w = Window.partitionBy("user_id", "epoch").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("event_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w).alias("held"))


@query("""SELECT DISTINCT conv_id AS root, turn // 3 AS thread, 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn // 3 AS VARCHAR) AS context_id FROM conversations""")
def thread_contexts(t):
    """One context for each root and thread."""
    c = t("conversations").select(F.col("conv_id").alias("root"), big(F.floor(F.col("turn") / 3)).alias("thread")).dropDuplicates()
    return c.withColumn("context_id", F.concat(F.lit("c"), "root", F.lit("-"), "thread"))


TREE = """tree AS (SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation
UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR) FROM customer),
up AS (SELECT node, node AS ancestor, 0 AS depth FROM tree UNION ALL SELECT u.node, t.parent, u.depth + 1 FROM up u JOIN tree t ON t.node = u.ancestor WHERE t.parent IS NOT NULL)"""


def tree(t):
    """Regions, nations and customers as scopes."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    r = t("region").select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    n = t("nation").select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent"))
    return r.unionByName(n).unionByName(t("customer").select(name("c", "c_custkey").alias("node"), name("n", "c_nationkey").alias("parent")))


@query(f"WITH RECURSIVE {TREE} SELECT node, ancestor, CAST(depth AS BIGINT) AS depth FROM up")
def scope_closure(t):
    """All ancestors of every scope."""
    return hierarchy.ancestors(tree(t)).withColumn("depth", big("depth"))


@query(f"WITH RECURSIVE {TREE} SELECT node, arg_min(ancestor, depth) FILTER (ancestor LIKE 'r%' OR ancestor IN ('n3', 'n7', 'n11')) AS session FROM up GROUP BY 1")
def scope_sessions(t):
    """The session of each scope: its own, else that of the nearest scope that has one."""
    nodes = tree(t)
    own = F.when(F.col("node").startswith("r") | F.col("node").isin("n3", "n7", "n11"), F.col("node"))
    return hierarchy.inherit(nodes.withColumn("session", own), "session")


@query(f"WITH RECURSIVE {TREE} SELECT node, arg_max(ancestor, depth) AS root, arg_min(ancestor, depth) FILTER (depth > 0 AND ancestor LIKE 'n%') AS enclosing FROM up GROUP BY 1")
def root_runs(t):
    """The root of each run, and the nearest tracked run that encloses it."""
    nodes = tree(t)
    near = hierarchy.inherited(nodes.withColumn("enclosing", F.when(F.col("node").startswith("n"), F.col("node"))), "enclosing")
    return hierarchy.roots(nodes).join(near, "node", "left")


@query("""SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS node, 'a' || CAST(n_nationkey % 3 AS VARCHAR) AS agent FROM nation WHERE n_nationkey % 3 <> n_regionkey""")
def agent_boundaries(t):
    """Runs whose own agent differs from the inherited one."""
    n = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("a"), F.col("n_nationkey") % 3).alias("agent"))
    r = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.concat(F.lit("a"), "r_regionkey").alias("agent"))
    return runs.boundaries(n.unionByName(r), "agent").filter(F.col("node").startswith("n")).select("node", "agent")


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'agent' WHEN turn % 5 = 3 THEN 'gateway_request' WHEN regexp_matches(ltrim(t), '^(<task-notification>|<local-command-caveat>|<command-name>|<system-reminder>)') THEN 'system' ELSE 'user' END AS author
FROM (SELECT conv_id, turn, CASE WHEN turn % 5 = 1 THEN '  <system-reminder>' || text WHEN turn % 5 = 2 THEN text || '<system-reminder>' ELSE text END AS t FROM conversations)""")
def turn_authors(t):
    """Who opened a turn; an injected tag counts only where it leads."""
    k = F.col("turn") % 5
    text = F.when(k == 1, F.concat(F.lit("  <system-reminder>"), "text")).when(k == 2, F.concat("text", F.lit("<system-reminder>"))).otherwise(F.col("text"))
    source = F.when(k == 3, "gateway_request").otherwise("user_prompt")
    return t("conversations").select("conv_id", "turn", classify.turn_author(text, source, F.when(k == 4, "sub")).alias("author"))


@query("SELECT event_id, date_trunc('second', ts) AS at, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS name FROM events")
def timestamps(t):
    """Host time, and the name of a context by it."""
    return t("events").select("event_id", F.date_trunc("second", "ts").alias("at"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("name"))


@query(f"""WITH {LINEAGE}, n AS (SELECT *, coalesce(sum(CASE WHEN event = 'SessionEnded' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM lineage)
SELECT CAST(session_id AS VARCHAR) AS session_id, CAST(i AS INT) AS incarnation, count(*) AS n_events, count(*) FILTER (event = 'PromptSubmitted') AS n_prompts, count(*) FILTER (event = 'ToolCallEnded') AS n_tools,
  count(*) FILTER (event = 'ToolCallEnded' AND is_error) AS n_failed, count(*) FILTER (event = 'ToolCallEnded' AND is_error IS NULL) AS n_unknown, bool_or(event = 'SessionEnded') AS ended FROM n GROUP BY session_id, i""")
def session_summaries(t):
    """Sessions folded in order; the streaming form gives the same rows (tests)."""
    from ..streaming.sessions import summarise_batch

    e = lineage(t("events")).select(F.col("session_id").cast("string").alias("session_id"), "seq", "event", "is_error")
    return summarise_batch(e)

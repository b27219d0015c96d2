import json

from pyspark.sql import functions as F

from tracewell.functions import metadata
from tracewell.operators import hierarchy, pairing, runs
from tracewell.sources import callbacks, events, manifest

LINES = [
    {"callback": "on_chain_start", "run_id": "g", "name": "agent", "seq": 1, "metadata": {"lc_agent_name": "main", "ls_integration": "deepagents"}},
    {"callback": "on_chain_start", "run_id": "n", "parent_run_id": "g", "name": "plan", "seq": 2, "metadata": {"langgraph_node": "plan", "lc_agent_name": "main"}},
    {"callback": "on_chain_start", "run_id": "w", "parent_run_id": "n", "name": "channel", "seq": 3, "metadata": {"langgraph_node": "plan"}},
    {"callback": "on_chain_start", "run_id": "s", "parent_run_id": "w", "name": "sub", "seq": 4, "metadata": {"lc_agent_name": "helper"}},
    {"callback": "on_tool_start", "run_id": "t", "parent_run_id": "s", "name": "read", "seq": 5},
    {"callback": "on_tool_error", "run_id": "t", "seq": 6, "error_mro": ["GraphInterrupt", "GraphBubbleUp", "Exception"]},
    {"callback": "on_chain_error", "run_id": "s", "seq": 7, "error_mro": ["ValueError", "Exception"]},
    {"callback": "on_chain_end", "run_id": "w", "seq": 8}, {"callback": "on_chain_end", "run_id": "w", "seq": 9},
    {"callback": "on_llm_end", "run_id": "never-started", "seq": 10}, {"callback": "on_text", "run_id": "g", "seq": 11},
    {"callback": "on_chain_start", "run_id": "g2", "name": None, "seq": 12}, {"callback": "on_chain_end", "run_id": "g", "seq": 13},
]


def capture(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, LINES)))
    return callbacks.read_callbacks(spark, str(tmp_path / "c.jsonl"))


def test_runs_meet_their_ends(spark, tmp_path):
    read = capture(spark, tmp_path)
    got = {r.run_id: (r.kind, r.start_seq, r.end_seq, r.outcome) for r in runs.pair_runs(read).collect()}
    assert got == {
        "g": ("chain", 1, 13, "ended"), "n": ("chain", 2, None, "open"), "w": ("chain", 3, 8, "ended"), "s": ("chain", 4, 7, "failed"), "t": ("tool", 5, 6, "suspended"), "g2": ("chain", 12, None, "open"),
    }
    kept = {r.run_id: r.label for r in runs.tracked(runs.pair_runs(read)).collect()}
    assert kept == {"g": "main", "n": "plan", "s": "helper", "g2": "graph"}
    both = read.withColumn("handler", F.lit("h"))
    assert [(r.run_id, r.n_open) for r in runs.concurrent_roots(both, "handler").collect()] == [("g2", 2)]
    assert [r.framework for r in runs.frameworks(both, "handler").collect()] == ["deepagents"]


def test_callbacks_as_they_arrive(spark, tmp_path):
    capture(spark, tmp_path)
    q = callbacks.stream_callbacks(spark, str(tmp_path)).select("run_id").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("arrived").count() == 12


def test_deep_chains_and_cycles(spark):
    n = 3000
    rows = [(i, i - 1 if i else None, "top" if i == 0 else "mid" if i == 1500 else None) for i in range(n)] + [(n + 1, n + 2, None), (n + 2, n + 1, None), (n + 3, n + 2, None), (n + 4, 99_999, None)]
    nodes = spark.createDataFrame(rows, "node int, parent int, v string")
    top = {r.node: r.root for r in hierarchy.roots(nodes).collect()}
    assert all(top[i] == 0 for i in range(n)) and top[n + 4] == 99_999 and top[n + 1] is top[n + 2] is top[n + 3] is None and len(top) == len(rows)
    got = {r.node: r.v for r in hierarchy.inherit(nodes, "v").collect()}
    assert all(got[i] == ("top" if i < 1500 else "mid") for i in range(n)) and got[n + 3] is None
    above = {r.node: r.v for r in hierarchy.inherited(nodes, "v").collect()}
    assert above[0] is None and above[1500] == "top" and above[1501] == "mid"
    short = spark.createDataFrame([(i, i - 1 if i else None) for i in range(150)], "node int, parent int")
    closure = hierarchy.ancestors(short)
    assert closure.count() == 150 * 151 // 2 and closure.filter("node = 149 AND ancestor = 0").first().depth == 149


def test_next_end_looks_forward(spark):
    rows = [("s", i, "start" if i % 3 else "end") for i in range(8)]
    e = spark.createDataFrame(rows, "session string, seq int, k string")
    got = {r.start_seq: (r.end_seq, r.end_value) for r in pairing.next_end(e, "session", "seq", F.col("k") == "start", F.col("k") == "end", F.col("k")).collect()}
    assert got == {1: (3, "end"), 2: (3, "end"), 4: (6, "end"), 5: (6, "end"), 7: (None, None)}


def test_secrets_go_at_any_depth(spark):
    deep = json.loads("[" * 200 + '{"author": "a", "password": 1}' + "]" * 200)
    raw = [{"extra_body": {"api_key": "S", "n": [{"token": "T", "max_tokens": 5}]}, "authorization": {"x": 1}}, deep]
    frame = spark.createDataFrame([(json.dumps(x),) for x in raw] + [(None,), ("no json",)], "j string")
    got = [r.j for r in frame.select(metadata.redact_json("j").alias("j")).collect()]
    assert json.loads(got[0]) == {"extra_body": {"api_key": "[redacted]", "n": [{"token": "[redacted]", "max_tokens": 5}]}, "authorization": "[redacted]"}
    assert '"password":"[redacted]"' in got[1] and got[2:] == [None, "no json"]


def test_metadata_is_flat_and_names_are_free(spark):
    row = spark.range(1).select(
        metadata.verbose_metadata(F.create_map(F.lit("name"), F.lit("n"), F.lit("LC-name"), F.lit("m"), F.lit("token"), F.lit("t"), F.lit("x"), F.lit(None).cast("string"))).alias("v"),
        metadata.flatten_nested(F.from_json(F.lit('{"a":{"b":1},"c":[1],"d":"s","e":null,"f":2}'), "map<string,variant>")).alias("f"),
        metadata.is_tool_error(F.lit(None).cast("string"), F.lit("  Error: x")).alias("e"), metadata.is_tool_error(F.lit("error"), F.lit("fine")).alias("e2"), metadata.is_tool_error(F.lit("ok"), F.lit(None).cast("string")).alias("e3"),
    ).first()
    assert row.v == {"LC-LC-name": "n", "LC-name": "m", "token": "[redacted]", "x": "null"}
    assert row.f == {"a": '{"b":1}', "c": "[1]", "d": "s", "e": None, "f": "2"} and (row.e, row.e2, row.e3) == (True, True, False)


def test_undecodable_lines_are_kept(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"kind":"mark","uuid":"u","name":"n"}\n{broken\n')
    got = events.read_capture(spark, str(tmp_path / "x.jsonl")).orderBy("seq").collect()
    assert [r.line for r in got] == [None, "{broken"]


def test_documents_are_written_read_and_never_replaced(spark, tmp_path):
    folder = str(tmp_path / "out")
    said = spark.createDataFrame([("s/1", "a", '{"@type":"X"}'), ("s/1", "b", '{"@type":"Y"}'), ("s2", "c", "{}")], "session_id string, id string, body string")
    blobs = spark.createDataFrame([("s/1", "k", b"\x00\xff")], "session_id string, cid string, bytes binary")
    documents = manifest.as_documents(said, blobs)
    manifest.write_documents(documents, folder)
    back = manifest.read_documents(spark, folder)
    assert sorted(r.id for r in manifest.statements(back).collect()) == ["a", "b", "c"] and [bytes(r.bytes) for r in manifest.blobs(back).collect()] == [b"\x00\xff"]
    manifest.write_documents(documents.filter("session_id = 's2'"), folder)
    assert manifest.read_documents(spark, folder).count() == 3
    more = spark.createDataFrame([("s2", "d$1", '{"x":"\\\\1"}'), ("s2", "c", '{"other":1}'), ("s3", "e", "{}")], "session_id string, id string, body string")
    merged = {r.session_id: json.loads(r.body) for r in manifest.merge_into(documents, more).collect()}
    assert merged["s2"]["statements"] == {"c": {}, "d$1": {"x": "\\1"}} and set(merged["s/1"]["statements"]) == {"a", "b"} and set(merged) == {"s/1", "s2"}


def test_losses_of_open_sessions_stay(spark):
    rows = [("a", 1, True, 1), ("b", 1, False, 9), ("c", 1, True, 2), ("d", 1, False, 8)]
    got = runs.shed_stale(spark.createDataFrame(rows, "session_id string, n_lost int, is_open boolean, seq int"), 3).collect()
    assert sorted(r.session_id for r in got) == ["a", "b", "c"]

import json

from pyspark.sql import functions as F

from tracewell import plans
from tracewell.operators import classify, graph, hierarchy, versions
from tracewell.sources import events, manifest
from tracewell.streaming import sessions


def line(kind="scope", uuid="u", parent="p", **more):
    return json.dumps({"atof_version": "0.1", "kind": kind, "uuid": uuid, "parent_uuid": parent, "timestamp": "2025-01-01T00:00:00Z", **more})


CAPTURE = [
    line("mark", name="session.start", metadata={"session_id": "s", "agent_kind": "root"}),
    line("mark", name="x", metadata={"hook_event_name": "PreCompact"}),
    line("mark", name="llm.chunk"),
    line(category="custom", scope_category="start", name="turn", metadata={"scope_role": "turn"}, data={"prompt": "hi"}),
    line(category="custom", scope_category="start", name="turn", metadata={"scope_role": "turn"}, data={"prompt": 5}),
    line(category="tool", scope_category="start", name="Read", category_profile={"tool_call_id": "c1"}),
    line(category="tool", scope_category="end", name="Read", category_profile={"tool_call_id": "c1"}, metadata={"status": "denied", "tool_correlation_status": "explicit"}),
    line(category="llm", scope_category="end", name="m", metadata={"status": "maybe"}),
    line(category="agent", scope_category="start", name="a", uuid="a1", parent="a0"),
    line(category="agent", scope_category="end", name="a", uuid="a0", parent="a0"),
    line("other", name="x"),
    "",
    "not json",
    json.dumps({"kind": "mark", "name": "session.start"}),
]


def test_capture_is_decoded_and_classified(spark, tmp_path):
    path = tmp_path / "capture.jsonl"
    path.write_text("\n".join(CAPTURE))
    got = events.read_capture(spark, str(path))
    assert got.count() == 13 and got.filter("undecodable").count() == 2 and got.filter("charged").count() == 2
    rows = classify.classify(got.filter("NOT undecodable")).orderBy("seq").collect()
    assert [r.event for r in rows] == ["SessionStarted", "Compacted", "PromptSubmitted", "ToolCallStarted", "ToolCallEnded", "ModelCallEnded", "SubagentStarted", "SessionEnded"]
    assert [r.is_error for r in rows] == [None, None, None, None, True, None, None, None]
    assert rows[4].observed and not rows[5].observed and rows[4].call_id == "c1" and rows[0].own_session == "s"


def test_hierarchy_with_a_cycle(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("r", "r")], "node string, parent string")
    closure = {(r.node, r.ancestor): r.depth for r in hierarchy.ancestors(nodes).collect()}
    assert closure["d", "a"] == 3 and closure["d", "b"] == 2 and closure["r", "r"] == 0 and closure["x", "y"] == 1
    known = nodes.withColumn("s", F.when(F.col("node") == "b", "B"))
    assert {r.node: r.s for r in hierarchy.inherit(known, "s").collect()} == {"a": None, "b": "B", "c": "B", "d": "B", "x": None, "y": None, "r": None}


def test_attribution_never_guesses(spark):
    scopes = spark.createDataFrame([("r", None, "s1"), ("k", "r", None), ("o", None, None)], "node string, parent string, session_id string")
    rows = spark.createDataFrame([(1, "k", None), (2, "o", None), (3, "k", "s9")], "seq int, parent_uuid string, own_session string")
    known, orphans = sessions.attribute(rows, scopes)
    assert {r.seq: r.session_id for r in known.collect()} == {1: "s1", 3: "s9"} and [r.seq for r in orphans.collect()] == [2]


def test_replay_folds_in_order(spark):
    rows = [
        ("s", 1, "a", "Wrote", "x\ny\n", None, None, False, True, None), ("s", 2, "a", "Wrote", None, "x\n", "z\n", False, True, None), ("s", 3, "b", "Wrote", None, "y\n", "w\n", False, True, "a"),
        ("s", 4, "a", "Wrote", None, "z\n", "q\n", False, True, None), ("s", 5, "b", "Deleted", None, None, None, False, False, None), ("s", 6, "b", "Wrote", None, "w", "v", True, False, None),
    ]
    frame = spark.createDataFrame(rows, "session_id string, seq bigint, path string, mode string, content string, old string, new string, replace_all boolean, line_oriented boolean, replay_from string")
    got = {r.seq: (r.content, r.refusal, r.recovered) for r in versions.replay(frame).collect()}
    assert got == {1: ("x\ny\n", None, False), 2: ("z\ny\n", None, True), 3: ("z\nw\n", None, True), 4: (None, "NotHeld", False), 5: (None, None, False), 6: (None, "NotHeld", False)}


def test_manifest_round_trip_and_merge(spark, tmp_path):
    s = spark.createDataFrame([("s/1", "st1", '{"@type":"DataRegistration","data":"c1"}'), ("s/1", "st2", '{"@type":"MetadataRegistration"}'), ("t", "st3", '{"@type":"DataRegistration"}')], "session_id string, id string, body string")
    b = spark.createDataFrame([("s/1", "c1", bytearray(b"\xff\x00")), ("s/1", "c1", bytearray(b"\xff\x00"))], "session_id string, cid string, bytes binary")
    docs = manifest.as_documents(s, b)
    for r in docs.collect():
        (tmp_path / r.file_name).write_text(r.body)
    (tmp_path / "bad.json").write_text('{"version":"2","statements":{},"blobs":{}}')
    (tmp_path / "x.unattributed.json").write_text("{}")
    assert manifest.list_documents(spark, str(tmp_path)).count() == 3
    back = manifest.read_documents(spark, str(tmp_path))
    assert {(r.id, r.type) for r in manifest.statements(back).collect()} == {("st1", "DataRegistration"), ("st2", "MetadataRegistration"), ("st3", "DataRegistration")}
    assert [(r.cid, bytes(r.bytes)) for r in manifest.blobs(back).collect()] == [("c1", b"\xff\x00")]


def test_sealing_counts_distinct_members(spark):
    said = spark.createDataFrame([("k", "b", 2, False), ("k", "a", 1, False), ("k", "b", 5, True)], "kind string, member string, seq int, w boolean")
    sealed = graph.seal(said, ["kind"], "member", "seq", "w")
    assert {r.member: r.ordinal for r in sealed.collect()} == {"a": "0000", "b": "0001"}
    row = graph.collections(sealed, ["kind"], "member").first()
    assert (row.n_members, row.n_withheld) == (2, 1)


def test_stream_and_batch_give_the_same_sessions(spark, tmp_path):
    rows = [(f"s{i % 3}", i, e, err) for i, (e, err) in enumerate([("PromptSubmitted", None), ("ToolCallEnded", True), ("ToolCallEnded", None), ("SessionEnded", None)] * 6)]
    schema = "session_id string, seq bigint, event string, is_error boolean"
    frame = spark.createDataFrame(rows, schema)
    frame.orderBy("seq").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = sessions.summarise_stream(stream).writeStream.format("memory").queryName("summaries").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("summaries").collect()}
    assert got == {tuple(r) for r in sessions.summarise_batch(frame).filter("ended").collect()} and got


def test_flagship_has_no_python(spark, sf):
    plan = plans.QUERIES["file_versions"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_every_query_matches_its_sql(spark, sf):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    plain = lambda v: v.tolist() if hasattr(v, "tolist") else sorted(v) if isinstance(v, set) else v
    for name, sql in plans.ORACLES.items():
        got = plans.QUERIES[name](spark, sf)
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns), name
        key = lambda row: tuple(str(plain(v)) for v in row)
        assert sorted(map(key, got.select(*names).collect())) == sorted(map(key, want.fetchall())), name


def test_tool_runs_and_model_calls(spark):
    from tracewell.functions.policy import Policy
    from tracewell.operators import record

    rows = [
        ("s", 1, "PromptSubmitted", None, None, "do it", None), ("s", 2, "ToolCallStarted", "c", "Read", "args", None), ("s", 3, "ToolCallEnded", "c", "Read", "result", False),
        ("s", 4, "ToolCallEnded", "c", "Read", "result", False), ("s", 5, "ToolCallEnded", "x", "Lone", None, None), ("s", 6, "ToolCallStarted", "o", "Open", "a", None),
    ]
    events_ = spark.createDataFrame(rows, "session_id string, seq bigint, event string, call_id string, name string, text string, is_error boolean")
    runs = {r.name: r for r in record.tool_runs(events_, Policy((), 4)).collect()}
    assert set(runs) == {"Read", "Lone"} and runs["Lone"].refused and len(runs["Read"].inputs) == 3 and len(runs["Read"].outputs) == 1
    assert [a.withheld_because for a in runs["Read"].assets] == ["TooLarge", None, "TooLarge"]
    assert {(r.kind, r.name) for r in record.actors(events_).collect()} == {("tool", "Read"), ("tool", "Lone"), ("tool", "Open")}
    said = spark.createDataFrame([("s", 0, "system", "sys"), ("s", 1, "user", "q"), ("s", 2, "assistant", "a"), ("s", 3, "assistant", "b")], "session_id string, seq bigint, role string, text string")
    calls = record.model_calls(said, Policy()).orderBy("seq").collect()
    assert [len(c.inputs) for c in calls] == [2, 1]
    assert record.assets_of(record.model_calls(said, Policy())).count() == 4


def test_extractors(spark):
    from tracewell.operators import extract

    state = {"files": {"b": {"content": ["x", "y"]}, "a": "t", "c": None, "d": 5}, "update": {"todos": [{"status": "completed"}, {"status": "open"}]}, "other": {"files": {"no": "x"}}, "skills_metadata": [{"name": "k"}, 3]}
    rows = extract.extract(spark.createDataFrame([("r", json.dumps(state)), ("n", None)], "run_id string, state string")).collect()
    assert sorted((r.kind, r.cid if r.cid.startswith("<") else "") for r in rows) == [("file:a", ""), ("file:b", ""), ("file:c", "<deleted>"), ("file:d", "<unreadable>"), ("plan:1 open", "")]

    def broken(path, value):
        raise ValueError

    def claims_all(path, value):
        return [("created", "mine", None, "m")] if path == ("files",) else None

    assert extract.walk(state, (*extract.BUILT_IN, claims_all, broken))[1][0][2] == "mine"


def test_names_snapshots_and_verdicts(spark):
    from tracewell.sources import gateway, sinks

    rows = [("s/1", 0, True), ("s/1", 1, True), ("s/1", 0, False)]
    got = {r.file_name for r in sinks.file_names(spark.createDataFrame(rows, "session_id string, incarnation int, attributed boolean")).collect()}
    assert got == {"s_00002f1.json", "s_00002f1.1.json", "s_00002f1.unattributed.json"}
    due = spark.createDataFrame([(1, 0, True), (23, 0, False), (24, 0, False), (24, 65_536 * 30, False)], "n int, b bigint, f boolean")
    assert [r[0] for r in due.select(sinks.snapshot_due(F.col("n"), F.col("b"), F.col("f"))).collect()] == [True, False, True, False]
    tries = spark.createDataFrame([(200, "ready", 0), (200, "failed", 0), (200, "pending", 1), (404, None, 1), (404, None, 3), (503, None, 2), (403, None, 0), (503, None, 11)], "h int, s string, w int")
    assert [r[0] for r in tries.select(gateway.verdict(F.col("h"), F.col("s"), F.col("w"))).collect()] == ["ready", "failed", "retry", "retry", "missing", "retry", "missing", "missing"]
    ids_ = spark.createDataFrame([({"X-Request-ID": "01234567-89ab-cdef-0123-456789abcdef"},), ({"x-request-id": "no"},)], "h map<string,string>")
    assert [r[0] is None for r in ids_.select(gateway.request_id(F.col("h"), "x-request-id")).collect()] == [False, True]


def test_last_child_of_large_part_keys_ties_and_nulls(spark, tmp_path):
    import duckdb

    rows = [(1, 1, 1_150_000), (1, 2, 100_000), (2, 1, 1_150_000), (2, 2, 150_000), (3, 2, 150_000), (3, 1, 1_150_000), (4, 1, None), (4, None, 7), (4, 1, 5), (4, 2, 3), (5, None, 4), (5, 1, None), (None, 1, 9), (None, None, 8)]
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_linenumber INTEGER, l_partkey BIGINT)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?)", rows)
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    want = {k: (kids, last) for k, kids, last in con.execute(plans.ORACLES["child_outputs"]).fetchall()}
    got = {r.comp_id: (r.child_outputs, r.last_child) for r in plans.QUERIES["child_outputs"](spark, str(tmp_path)).collect()}
    assert got == want and {k: v[1] for k, v in got.items()} == {1: 1_150_000, 2: 1_150_000, 3: 150_000, 4: 3, 5: None, None: 9} and got[4][0] == [5, None, 3, 7]

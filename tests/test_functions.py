import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions import ids, policy
from tracewell.functions import text as X
from tracewell.operators.versions import LineEdit, patch_observations, result_observations

#: Content ids of known bytes.
GOLDEN = {
    b"": "bafkr4ifpcne3t5pzugtkaqcn5i3nzskjtpfslsnnyejlpte2spfoihzsmi",
    b"# Report\n": "bafkr4ifmhsxkrj53tt3bthx2nrbeprrgjdgvbqnxooi4yanpzdoqsxm2ee",
    bytes.fromhex("68c3a96c6c6f2077c3b6726c640a"): "bafkr4ia3dbdqle4gxrxecuskqvfgbbtuigx43dzqvclmm3p4et3timp5nu",
    bytes.fromhex("fffe0001"): "bafkr4ihmkerdrzrkni7wyltaqgzvhkk54va43rduz3ku7uvzqu74fejkre",
    bytes.fromhex("fffd0001"): "bafkr4iejqwyj52iwp3qonkhbtlksway5un5apqloahyq7qppsyha4x3f6a",
    b"x" * 100_000: "bafkr4ietzhf22xzaamg2o53wrocukkdt2ws2uqe3s2rcnb2fspk5yjaliy",
}
#: previous, removed lines, added lines, text after or None, refusal
LINE_EDITS = [
    ("a\nb\nc\n", ["b"], [], "a\nc\n", None),
    ("b\nb", ["b"], ["c"], None, "Ambiguous"),
    ("one\ntwo\nthree\n", ["one", "two", "three"], ["one", "TWO", "three"], "one\nTWO\nthree\n", None),
    ("a\nb", ["b"], [], None, "UnterminatedAtEof"),
    ("a\nb\nc", ["b"], [], "a\nc", None),
    ("only\n", ["only"], [], "", None),
    ("a\r\nb\r\nc\r\n", ["b"], ["B"], None, "TerminatorsNotEstablished"),
    ("a\r\nb\r\nc\r\n", ["b"], [], "a\r\nc\r\n", None),
    ("a\r\nb\nc\r\nd\n", ["b"], [], "a\r\nc\r\nd\n", None),
    ("a\nb\n", ["zzz"], ["q"], None, "NotFound"),
]


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_content_ids():
    assert {data: ids.content_id_of(data) for data in GOLDEN} == GOLDEN


def test_line_edits(spark):
    rows = [(i, *r[:3]) for i, r in enumerate(LINE_EDITS)]
    frame = spark.createDataFrame(rows, "i int, p string, r array<string>, a array<string>")
    got = {r.i: (r.e.text, r.e.refusal) for r in frame.select("i", X.line_edit("p", "r", "a").alias("e")).collect()}
    assert [got[i] for i in range(len(rows))] == [r[3:] for r in LINE_EDITS]
    for previous, removed, added, text, refusal in LINE_EDITS:
        join = lambda x: "".join(f"{y}\n" for y in x)
        assert LineEdit.apply(previous, join(removed), join(added)) == (text, refusal)


def test_native_and_folded_line_edits_agree(spark):
    alphabet = ["a", "b", "a\n", "b\n", "c\r\n", "\n"]
    found = []

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.sampled_from(alphabet), max_size=6), st.lists(st.sampled_from("abc"), min_size=1, max_size=2), st.lists(st.sampled_from("xy"), max_size=2))
    def collect(parts, removed, added):
        found.append((len(found), "".join(parts), removed, added))

    collect()
    frame = spark.createDataFrame(found, "i int, p string, r array<string>, a array<string>")
    got = {r.i: (r.e.text, r.e.refusal) for r in frame.select("i", X.line_edit("p", "r", "a").alias("e")).collect()}
    for i, previous, removed, added in found:
        assert got[i] == LineEdit.apply(previous, "".join(f"{x}\n" for x in removed), "".join(f"{x}\n" for x in added)), (previous, removed, added)


@pytest.mark.parametrize(
    ("glob", "value", "want"),
    [(".env*", ".env.local", True), ("*.pem", "a/b/c.pem", True), ("a?c", "abc", True), ("a?c", "ac", False), ("a.c", "abc", False), ("[ab]", "a", False), ("*", "a\nb", True), ("a%_b", "a%_b", True)],
)
def test_globs(spark, glob, value, want):
    assert column(spark, [(value,)], "v string", X.glob_match("v", [glob])) == [want]


def test_policy_and_states(spark):
    p = policy.Policy((".env*",), 8)
    rows = [("a/.env", 7), ("b", 8), ("b", 9), ("b", None), (".env", None)]
    assert column(spark, rows, "p string, n int", p.decide(F.col("p"), F.col("n"))) == ["Denied", "Store", "TooLarge", None, "Denied"]


def test_secret_keys(spark):
    kept = ["top_k", "top_p", "max_tokens", "max_completion_tokens", "max_output_tokens", "author", "authoring_model", "keyword_boost"]
    gone = ["api_key", "openai_api_key", "auth_token", "bearer_token", "some_secret", "authorization"]
    assert column(spark, [(k,) for k in kept + gone], "k string", X.is_secret_key("k")) == [False] * len(kept) + [True] * len(gone)


def test_paths(spark):
    rows = {"a": "/a", "/a": "/a", "//a": "//a", "///a": "/a", "./a": "/a", "a/./b/": "/a/b", "/": "/", ".": "/.", "..": None, "a/../b": None, "~/a": None, "C:/a": None, "a\\b": "/a/b"}
    assert column(spark, [(k,) for k in rows], "p string", X.normal_path("p")) == list(rows.values())
    safe = column(spark, [("a-B9",), ("a/b",), ("a_b",), ("é",)], "p string", X.path_safe("p"))
    assert safe == ["a-B9", "a_00002fb", "a_00005fb", "_0000e9"]


def test_literal_and_strict_edits(spark):
    edit = lambda f, *row: column(spark, [row], "o string, x string, n string, every boolean", f(F.col("o"), F.col("x"), F.col("n"), F.col("every")))[0]
    assert edit(X.literal_edit, "aXbX", "X", "y", False) == "ayb" + "X" and edit(X.literal_edit, "aXbX", "X", "y", True) == "ayby"
    assert edit(X.literal_edit, "a", "X", "y", False) is None and edit(X.literal_edit, None, "X", "y", False) is None
    assert edit(X.strict_edit, "aXbX", "X", "y", False) is None and edit(X.strict_edit, "aXb", "X", "y", False) == "ayb" and edit(X.strict_edit, "ab", "", "y", True) is None


def test_patches():
    patch = "\n".join([
        "*** Begin Patch", "*** Add File: n.txt", "+one", "+two", "*** Update File: u.txt", "*** Move to: v.txt", "@@", " a", "-b", "+c", "@@", "-d", "*** Update File: r.txt", "*** Move to: s.txt",
        "*** Update File: loose.txt", "+x", "*** Delete File: gone.txt", "*** End Patch",
    ])
    got = list(patch_observations(patch))
    assert [(o["path"], o["mode"], o["content"]) for o in got] == [("n.txt", "Wrote", "one\ntwo\n"), ("v.txt", "Wrote", None), ("s.txt", "Wrote", None), ("loose.txt", "Wrote", None), ("gone.txt", "Deleted", None)]
    assert got[1]["hunks"] == [("a\nb\n", "a\nc\n"), ("d\n", "")] and got[1]["replay_from"] == "u.txt" and got[2]["vacated"] == "r.txt" and got[3]["hunks"] == []
    assert list(patch_observations("no patch")) == [] == list(patch_observations(None))


def test_results_by_shape():
    read = {"file": {"filePath": "p", "content": "x", "startLine": 1, "numLines": 1, "totalLines": 1}}
    assert result_observations(read) == [{"path": "p", "mode": "Read", "content": "x"}]
    assert result_observations({"file": {**read["file"], "numLines": 1, "totalLines": 2}})[0]["content"] is None
    assert [o["content"] for o in result_observations({"filePath": "p", "originalFile": "a b", "oldString": "a", "newString": "c"})] == ["a b", "c b"]
    assert result_observations({"filePath": "p", "oldString": "a", "newString": "c"})[0]["content"] is None
    assert result_observations({"filePath": "p", "content": "w"})[0]["mode"] == "Wrote" and result_observations("text") == []


def test_config():
    c = policy.Config.parse({"deny_globs": [".env*"], "max_content_bytes": 0, "manifest_dir": "", "unknown": 1, "provider_manifests": [{"base_url": "https://x", "models": ["m"]}, {"base_url": "ftp://x"}, {"base_url": "https://y", "more": 1}]})
    assert c.deny == (".env*",) and c.max_bytes == policy.MAX_CONTENT_BYTES and len(c.problems) == 4 and len(c.providers) == 1
    assert policy.Config.parse({}).deny == policy.DENY_GLOBS and "*.pem" in policy.Config().policy.deny
    refused = [{"base_url": "http://x", "models": ["m"]}, {"base_url": "https://x"}, {"base_url": "https://x", "models": "m"}, {"base_url": "https://x", "models": [1]}, "x"]
    assert len(policy.Config.parse({"provider_manifests": refused}).problems) == len(refused)


def test_canonical_json():
    assert ids.canonical_json_of(json.dumps({"b": [1, {"d": 1, "c": None}], "a": "é"})) == '{"a":"é","b":[1,{"c":null,"d":1}]}'

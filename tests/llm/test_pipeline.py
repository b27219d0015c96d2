import re

from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm.test_suffixdedup import brute_force


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_stages_one_by_one(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in C.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        steps[name] = ({r.doc_id: r.text for r in docs.collect()}, after.collect())
        if name != "packing":
            assert after.columns == columns
        docs = after
    before, after = steps["toxicity"]
    assert {r.doc_id: r.text for r in after}.items() <= before.items()
    assert 0.8 * len(before) <= len(after) <= len(before)
    before, after = steps["near_duplicates"]
    assert len({r.text for r in after}) == len(after) and {r.text for r in after} <= set(before.values())
    before, after = steps["repeats"]
    plain, got = brute_force(before, C.LEAST_REPEAT), {r.doc_id: r.text for r in after}
    for k, (_, removed, _, kept) in plain.items():
        if k in got:
            # Characters of which only some bytes repeat stay, so a text may keep a few bytes more than the plain rule.
            assert got[k] == before[k] if not removed else len(kept) <= len(got[k].encode()) <= len(kept) + 6 * plain[k][2]
        else:
            assert removed and not kept.decode("utf-8", "ignore").strip()
    before, after = steps["decontamination"]
    grams = {tuple(w[i : i + 10]) for w in (words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()) for i in range(max(1, len(w) - 9)) if w}
    hit = lambda t: any(tuple(t[i : i + n]) in grams for n in {len(g) for g in grams} for i in range(len(t) - n + 1))
    got = {r.doc_id: r.text for r in after}
    for k, text in before.items():
        if not hit(words(text)):
            assert got[k] == text
    before, after = steps["packing"]
    assert {r.doc_id for r in after} == before.keys()


def test_run_is_registered(spark, sf):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is C.run
    assert [name for name, _ in C.STAGES] == ["toxicity", "near_duplicates", "repeats", "decontamination", "packing"]


def test_odd_rows_and_columns_go_through_every_stage(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    more = {"rest": F.lit("r"), "n_removed": F.col("doc_id") * 2, "a.b": F.timestamp_micros(F.col("doc_id") + 1), "key": F.array(F.lit(1), F.lit(None)), "dropped_id": F.lit(None).cast("int")}
    docs = docs.withColumns(more)
    odd = [(10_001, None), (None, "one two"), (None, None), (10_002, ""), (10_003, " .. "), (10_004, "word " * 30_000), (10_005, "twice, the same"), (10_005, "twice, the same")]
    odd = spark.createDataFrame(odd, "doc_id bigint, text string")
    rows = docs.unionByName(odd.withColumns({k: v for k, v in more.items()}), allowMissingColumns=True)
    rows.write.parquet(f"{tmp_path}/in")
    rows = spark.read.parquet(f"{tmp_path}/in")
    before = {r.doc_id: r for r in rows.collect()}
    for name, stage in C.STAGES:
        assert stage(spark, rows.limit(0), sf).count() == 0
        found = stage(spark, rows, sf)
        got = found.collect()
        if name == "packing":
            assert {r.doc_id for r in got} == set(before)
            continue
        assert found.columns == rows.columns
        for r in got:
            was = before[r.doc_id]
            assert all(r[c] == was[c] for c in ("rest", "n_removed", "a.b", "key", "dropped_id", "lang", "source")) or r.doc_id is None
            assert r.text is None or len(r.text) <= len(before[r.doc_id].text or "") or r.doc_id is None
        ids = [r.doc_id for r in got]
        assert ids.count(None) == 2 and (name == "near_duplicates" or {10_001, 10_002, 10_003} <= set(ids))

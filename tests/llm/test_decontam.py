import hashlib
import random
import re

import duckdb
import pytest

from tracewell.llm import decontam as D
from tracewell.llm.oracles import OP6
from tracewell.llm.queries import op6_decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(text, items, n):
    """(words, hit positions, ids of found items) of one text."""
    ws, hit, found = WORD.findall(low(text)), set(), set()
    for item_id, body in items:
        of = WORD.findall(low(body))
        k = min(n, len(of))
        for s in range(len(of) - k + 1 if k else 0):
            for p in range(len(ws) - k + 1):
                if ws[p : p + k] == of[s : s + k]:
                    hit.update(range(p + 1, p + k + 1))
                    found.add(item_id)
    return ws, sorted(hit), found


def tables(spark, seed=5):
    rng = random.Random(seed)
    vocabulary = ["aa", "Bb", "cc", "é", "1", "DD"]
    text = lambda a, b: rng.choice(["", " ", "..."]) + " ".join(rng.choices(vocabulary, k=rng.randint(a, b)))
    items = [(k, text(0, 9)) for k in range(6)] + [(3, text(3, 6)), (None, text(4, 8)), (9, None), (10, "?!"), (11, "é")]
    docs = [(rng.choice([1, 2, 3, None, i]), rng.choice([text(0, 30), None, "aa bb", text(1, 4)])) for i in range(60)]
    docs += [docs[0], docs[0], (77, " ".join(rng.choices(vocabulary, k=4000)))]
    return items, docs, spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame([(*d, "x") for d in docs], "doc_id int, text string, size string")


@pytest.mark.parametrize("limit", [None, 300])
def test_rows_are_those_of_brute_force_in_one_pass_and_in_several(spark, limit):
    items, docs, benchmark, documents = tables(spark)
    got = sorted((str(r.doc_id), r.n_words, tuple(r.hit_words), sorted(map(str, r["items"]))) for r in D.contamination(documents, benchmark, 4, limit).collect())
    want = []
    for doc_id, text in docs:
        ws, hit, found = plain(text, items, 4)
        want.append((str(doc_id), len(ws), tuple(hit), sorted(map(str, found))))
    assert got == sorted(want)


@pytest.mark.parametrize("limit", [None, 300])
def test_hit_words_go_row_by_row_and_all_columns_stay(spark, limit):
    items, docs, benchmark, _ = tables(spark, 6)
    names = ["doc_id", "text", "key", "a.b", "of", "row", "gone"]
    rows = [(d, t, i, i * 2, "of", None, t) for i, (d, t) in enumerate(docs)]
    documents = spark.createDataFrame(rows, "doc_id int, text string, key int, `a.b` int, of string, row string, gone string").toDF(*names)
    got = {r.key: r for r in D.remove_spans(documents, benchmark, 4, limit=limit).collect()}
    for i, (doc_id, text) in enumerate(docs):
        ws, hit, _ = plain(text, items, 4)
        if not hit:
            assert got[i].text == text
            continue
        number = iter(range(1, len(ws) + 1))
        left = re.sub(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lambda m: "" if next(number) in hit else m[0], text)  # noqa: B023
        if len(hit) == len(ws):
            assert i not in got
        else:
            assert got[i].text == left and got[i].doc_id == doc_id and got[i]["a.b"] == 2 * i and got[i].gone == text


def test_empty_tables(spark):
    _, _, benchmark, documents = tables(spark)
    assert D.contamination(documents.limit(0), benchmark, 4).count() == 0
    found = D.contamination(documents, benchmark.limit(0), 4).collect()
    assert len(found) == documents.count() and not any(r.hit_words or r["items"] for r in found)
    assert D.remove_spans(documents, benchmark.limit(0), 4).count() == documents.count()


def test_the_query_gives_the_rows_of_its_sql(spark, tmp_path):
    _, _, benchmark, documents = tables(spark)
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = op6_decontaminate(spark, str(tmp_path))
    want = con.sql(OP6)
    assert got.columns == want.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
    assert hashlib.sha256(b"").hexdigest() in {r.items_sha256 for r in got.collect()}

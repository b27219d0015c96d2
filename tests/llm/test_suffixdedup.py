import hashlib
import random

import numpy as np
import pytest

from tracewell.llm import bwt, suffixdedup
from tracewell.llm.queries import op10_suffix_dedup
from tracewell.llm.suffixdedup import deduplicate


def brute_force(rows, least):
    """doc_id -> (n_bytes, n_removed, n_spans, kept bytes)."""
    seen, found = set(), {}
    for k, text in sorted(rows.items()):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - least + 1):
            if (window := data[i : i + least]) in seen:
                gone[i : i + least] = True
            seen.add(window)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        found[k] = (len(data), int(gone.sum()), spans, bytes(np.frombuffer(data, np.uint8)[~gone]))
    return found


def check(got, want):
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {k: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for k, v in want.items()}


def planted(rng, n=60):
    letters = "abcdefgh é字\n"
    text = lambda k: "".join(rng.choices(letters, k=k))
    passages = [text(rng.randint(60, 400)) for _ in range(6)]
    rows = {1: None, 2: "", 3: "x" * 99, 4: "x" * 99, 5: "x" * 100, 6: "x" * 350, 7: "ab" * 200, 8: "\0" * 130 + "é" * 90}
    for k in range(10, 10 + n):
        parts = []
        for _ in range(rng.randint(1, 5)):
            kind = rng.random()
            if kind < 0.4:
                parts.append(text(rng.randint(1, 300)))
            elif kind < 0.7:
                parts.append(rng.choice(passages))
            else:
                p = list(rng.choice(passages))
                p[rng.randrange(len(p))] = rng.choice(letters)
                parts.append("".join(p))
        rows[k] = "".join(parts) if rng.random() < 0.85 else rows[max(rows)]
    return rows


@pytest.mark.parametrize("many", [1024, 1])
def test_against_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(suffixdedup, "MANY", many)
    monkeypatch.setattr(suffixdedup, "TRANSFORM", 5000)
    monkeypatch.setattr(suffixdedup, "STRETCH", 350 if many == 1 else 1 << 20)
    rows = planted(random.Random(many))
    docs = spark.createDataFrame([(k, t, 7) for k, t in rows.items()], "doc_id bigint, text string, bucket int").repartition(5)
    check(deduplicate(docs, 100).collect(), brute_force(rows, 100))


def test_whole_small_table(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    check(op10_suffix_dedup(spark, "/root/testdata/sf0.001").collect(), brute_force(rows, 100))


def test_text_keeps_whole_characters(spark):
    rows = {1: "é" * 80, 2: "a" + "é" * 80 + "b"}
    got = {r.doc_id: r.kept_text for r in deduplicate(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string"), 100, with_text=True).collect()}
    assert got[2].startswith("a") and got[2].endswith("b") and "�" not in got[2]


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "q" * 50 + "w" * 80), (1, "q" * 50 + "w" * 80), (None, "z")], "doc_id bigint, text string")
    assert {(r.doc_id, r.n_removed) for r in deduplicate(docs, 100).collect()} == {(1, 0), (None, 0)}
    assert deduplicate(docs.limit(0), 100).count() == 0


def test_transform_classes():
    rng = random.Random(1)
    for _ in range(20):
        base = bytes(rng.choice(b"ab\0c") for _ in range(rng.randint(1, 300)))
        text = base + base[: len(base) // 2] + bytes(rng.choice(b"ab") for _ in range(30)) + base[len(base) // 3 :]
        least = rng.choice([1, 3, 10, 25])
        order, number = bwt.repeat_classes(np.frombuffer(text, np.uint8), least)
        ring, found = text * 40, {}
        for i, k in zip(order.tolist(), number.tolist(), strict=True):
            found.setdefault(k, set()).add(ring[i : i + least])
        assert all(len(x) == 1 for x in found.values()) and len(set().union(*found.values())) == len(found)


def test_long_texts_are_cut_into_stretches_without_losing_windows(monkeypatch):
    monkeypatch.setattr(suffixdedup, "STRETCH", 300)
    rng = random.Random(6)
    docs = [bytes(rng.choices(b"ab", k=n)) for n in (0, 40, 99, 100, 299, 300, 301, 399, 400, 2000)]
    starts = {k: [] for k in range(len(docs))}
    for block in suffixdedup.stretches(docs, list(range(len(docs))), 100):
        texts, ids, base = zip(*block, strict=True)
        for r in suffixdedup.contexts(list(texts), np.array(ids), 100, np.array(base)):
            starts[int(r["doc"])] += range(int(r["start"]), int(r["start"]) + int(r["more"]) + 1)
    assert {k: sorted(v) for k, v in starts.items()} == {k: list(range(max(0, len(d) - 99))) for k, d in enumerate(docs)}


def test_longer_strings_than_a_byte_counts(spark):
    rng = random.Random(8)
    block = "".join(rng.choices("abcdefgh", k=1200))
    texts = {1: block, 2: "x" + block + "y", 3: block[:500] + "z" + block[500:]}
    got = deduplicate(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), least=400).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed) for r in got} == {k: v[:2] for k, v in brute_force(texts, 400).items()}

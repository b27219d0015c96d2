import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import toxicity as T
from tracewell.llm.langid import crc_fold
from tracewell.llm.queries import op8_toxicity


def test_marginals_are_exact():
    rng = np.random.default_rng(4)
    first = np.array([0, 4, 4, 5, 11])
    emit, moves = rng.normal(size=11) * 2, rng.normal(size=(2, 2))
    a, b = T.forward_backward(emit, first, moves)
    p = 1 / (1 + np.exp(-a - b))
    for lo, hi in itertools.pairwise(first):
        total, on = 0.0, np.zeros(hi - lo)
        for path in itertools.product((0, 1), repeat=hi - lo):
            x = np.array(path)
            w = np.exp((emit[lo:hi] * x).sum() + sum(moves[s, t] for s, t in itertools.pairwise(path)))
            total += w
            on += w * x
        if hi > lo:
            np.testing.assert_allclose(p[lo:hi], on / total, rtol=1e-9)


def corpus(n=240):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=40)
        if toxic := i % 4 == 0:
            for _ in range(3):
                text[rng.randrange(40)] = "zorg" + rng.choice(words)[:3]
        rows.append((" ".join(text), int(toxic)))
    return rows


def test_planted_words_are_found_with_their_places():
    rows = corpus()
    model = T.fit(rows[:160])
    score, spans = T.tag([t for t, _ in rows[160:]], model)
    for (text, label), s, found in zip(rows[160:], score, spans, strict=True):
        assert (s >= 0.7) == bool(label)
        assert all("zorg" in text[a:b] for a, b, _ in found) and bool(found) == bool(label)


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op8_toxicity(spark, "/root/testdata/sf0.01").collect()}
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert all(r.held_out == (crc_fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [(got[m.doc_id].predicted, m.toxic) for m in marks if crc_fold(m.doc_id, 3) == 1]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_nulls_empty_and_unlabelled(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "a b", 5)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(1, None), (2, 0)], "doc_id bigint, toxic int")
    model = T.train(docs, labels, F.lit(True))
    assert [r.score for r in T.score(docs, model).collect()] == [0.0, 0.0, 0.0]
    assert T.score(docs.limit(0), model).count() == 0

import itertools
import random

import numpy as np

from tracewell.llm import wordgrams as W
from tracewell.llm.langid import crc_fold, fit, predict, train, viterbi
from tracewell.llm.queries import op1_langid
from pyspark.sql import functions as F


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    first = np.array([0, 5, 5, 6, 12])
    scores = rng.normal(size=(12, 3)).astype(np.float32) * 3
    got = viterbi(scores, first, 2.5)
    for a, b in itertools.pairwise(first):
        value = lambda path: sum(scores[a + i, x] for i, x in enumerate(path)) - 2.5 * sum(x != y for x, y in itertools.pairwise(path))
        best = max(itertools.product(range(3), repeat=b - a), key=value)
        assert abs(value(best) - value(tuple(got[a:b]))) < 1e-4


def test_words_and_sums_match_a_plain_count():
    texts = ["", "Ab ab-cß 12", "x" * 3, "  ", "été\nЖЖ"]
    rng = np.random.default_rng(1)
    tables = {n: rng.normal(size=(256, 2)).astype(np.float32) for n in (1, 2, 3)}
    got = W.words(texts, tables, 8)
    k = 0
    for i, text in enumerate(texts):
        for j in range(got.first[i], got.first[i + 1]):
            word = text[got.start[j] : got.end[j]]
            assert word.isalpha()
            chars = np.array([0, *map(ord, word.lower()), 0], np.uint64)
            want = np.zeros(2)
            for n, table in tables.items():
                at, inside = W.grams(chars, n, 8)
                want += table[at[inside & (np.arange(len(at)) < len(chars) - 1)]].sum(0)
            np.testing.assert_allclose(got.scores[j], want, rtol=1e-4, atol=1e-4)
            k += 1
    assert k == 6 == len(got.start)


def test_spans_of_mixed_text_and_scripts():
    en = " ".join(random.Random(1).choices("the house with green windows stands near this river and their garden".split(), k=400))
    de = " ".join(random.Random(2).choices("das haus mit grünen fenstern steht nahe diesem fluss und ihrem garten".split(), k=400))
    ru = " ".join(random.Random(3).choices("дом с зелеными окнами стоит у реки".split(), k=200))
    model = fit([(en, "en"), (de, "de"), (ru, "ru")])
    a, b = "the green garden near this river stands. ", "und das haus steht nahe diesem fluss"
    (lang, score, spans), none, cyr = predict([a + b, "12 --", ru[:30]], model)
    assert [x[2] for x in spans] == ["en", "de"] and 0 < score <= 1
    assert (a + b)[spans[1][0] : spans[1][1]] == b
    assert none == ("und", 0.0, []) and cyr[0] == "ru"


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = op1_langid(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (crc_fold(r.doc_id, 5) == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_nulls_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "abc", None), (2, "abc", None)], "doc_id bigint, text string, lang string")
    from tracewell.llm.langid import identify

    model = train(docs, F.lit(True))
    assert [r.lang_pred for r in identify(docs, model).collect()] == ["und"] * 3
    assert identify(docs.limit(0), model).count() == 0


def test_more_languages_than_a_byte_holds():
    first = np.array([0, 3, 5])
    scores = np.full((5, 300), -5.0, np.float32)
    scores[:3, 250] = scores[3:, 131] = 0
    assert viterbi(scores, first, 6.0).tolist() == [250] * 3 + [131] * 2

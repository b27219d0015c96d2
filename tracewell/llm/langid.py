"""Language identification: scripts narrow the candidates, Viterbi labels spans of words.

Words are scored by character n-gram log probabilities; Viterbi over the words of a text with a
penalty for each switch of language labels its spans, and a text's language is the one whose
spans hold most letters.

Defined results: a null text or one without letters is ``und`` with score 0 and no spans; rows may
repeat; extra columns are ignored; without any labelled row every text with letters is ``und``.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordgrams as W
from .common import blocks, released

ORDERS, BITS = (1, 2, 3, 4), 16
#: Code points labelled at once for up to eight languages, fewer for more.
BLOCK = 1 << 21
#: About so many labelled rows of each language are fitted on: the bound of the training sample.
SAMPLE_PER_LANGUAGE = 800
#: Nats that a switch of language costs; a word's score is a mean over n-gram orders.
SWITCH = 6.0
#: A language is a candidate for a script that at least this share of its words has.
SCRIPT_SHARE = 0.02


class Model(NamedTuple):
    languages: list[str]
    tables: dict[int, np.ndarray]
    scripts: np.ndarray  # language x script: candidate


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model of (text, language) rows."""
    counted = {}
    for language in sorted({lang for _, lang in rows}):
        counted[language] = count([t for t, lang in rows if lang == language])
    return model_of(counted)


def count(texts: list[str]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """What a language is learnt from: how often each table row is met, by order, and how many words each script has."""
    grams, scripts = {n: np.zeros(1 << BITS, np.int64) for n in ORDERS}, np.zeros(len(W.SCRIPT_NAMES), np.int64)
    for _, block in blocks(texts, BLOCK):
        for n, found in W.gram_counts(block, ORDERS, BITS).items():
            grams[n] += found
        scripts += np.bincount(W.words(block, {}, BITS).script, minlength=len(scripts))
    return grams, scripts


def model_of(counted: dict[str, tuple[dict[int, np.ndarray], np.ndarray]]) -> Model:
    """A model of the counts of each language."""
    languages = sorted(counted)
    tables = {n: np.zeros((1 << BITS, len(languages)), np.float32) for n in ORDERS}
    scripts = np.zeros((len(languages), len(W.SCRIPT_NAMES)), bool)
    for k, language in enumerate(languages):
        grams, seen = counted[language]
        for n, counts in grams.items():
            tables[n][:, k] = np.log(counts + 0.5) - np.log(counts.sum() + 0.5 * len(counts))
        scripts[k] = seen >= max(1, SCRIPT_SHARE * seen.sum())
    for n in ORDERS:
        if languages:
            tables[n] -= tables[n].mean(1, keepdims=True)
    return Model(languages, tables, scripts)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best label of every word; texts are worked on side by side."""
    n, k = scores.shape
    base, active = W.steps(first)
    back, labels = np.empty((n, k), np.int16), np.empty(n, np.int16)
    value = np.zeros((len(base), k), np.float32)
    own = np.arange(k, dtype=np.int16)
    last = np.zeros(len(base), np.int16)
    for t, m in enumerate(active):
        at, v = base[:m] + t, value[:m]
        best = v.argmax(1)
        jump = v[np.arange(m), best] - switch
        take = jump[:, None] > v
        back[at] = np.where(take, best[:, None].astype(np.int16), own)
        v = np.where(take, jump[:, None], v) + scores[at]
        value[:m] = v - v.max(1, keepdims=True)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        begin = active[t + 1] if t + 1 < len(active) else 0
        if begin < m:
            last[begin:m] = value[begin:m].argmax(1)
        at = base[:m] + t
        labels[at] = last[:m]
        last[:m] = back[at, last[:m]]
    return labels


def predict(texts: list[str], model: Model, switch: float = SWITCH):
    """For each text: language, score, spans as (start, end, language) in code points."""
    k = len(model.languages)
    found = W.words(texts, model.tables, BITS)
    n = len(found.start)
    if not k or not n:
        return [("und", 0.0, [])] * len(texts)
    allowed = model.scripts.T[found.script]
    scores = np.where(allowed | ~allowed.any(1, keepdims=True), found.scores / len(ORDERS), np.float32(-60))
    labels = viterbi(scores, found.first, switch)
    owner = np.repeat(np.arange(len(texts)), np.diff(found.first))
    letters = np.bincount(owner * k + labels, weights=found.end - found.start, minlength=len(texts) * k).reshape(-1, k)
    total = letters.sum(1)
    best = letters.argmax(1)
    share = letters.max(1) / np.maximum(total, 1)
    head = np.flatnonzero(np.r_[True, (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])])
    tail = np.r_[head[1:], n] - 1
    cut = np.searchsorted(owner[head], np.arange(len(texts) + 1))
    spans = [(int(s), int(e), model.languages[x]) for s, e, x in zip(found.start[head], found.end[tail], labels[head], strict=True)]
    lettered = [bool(total[i]) and any(map(str.isalpha, texts[i])) for i in range(len(texts))]  # marks alone are no letters
    return [(model.languages[best[i]], float(share[i]), spans[cut[i] : cut[i + 1]]) if lettered[i] else ("und", 0.0, []) for i in range(len(texts))]


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) leaves that remainder."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


def train(documents: DataFrame, learn: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on about per_language rows of each language, picked by a hash among the rows that ``learn`` admits.

    The picked texts are counted where they are read; tasks send a row of sums for each language (len(ORDERS) * 2**BITS counts, most of them 0 and
    so compressed), never texts, and sums of a language meet in one task.
    """
    rows = documents.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return fit([])
    pick = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30))
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1, per_language / n) * (1 << 30)))])
    size = len(ORDERS) << BITS

    def packed(found: dict[str, np.ndarray]) -> pa.RecordBatch:
        sums = [zlib.compress(v.astype("<i8").tobytes(), 1) for v in found.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(sums, pa.binary())], ["lang", "sums"])

    def learnt(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                grams, scripts = count([t for t, x in zip(texts, langs, strict=True) if x == lang])
                got = np.concatenate([*(grams[n] for n in ORDERS), scripts])
                found[lang] = found[lang] + got if lang in found else got
        if found:
            yield packed(found)

    def summed(batches):
        lang, total = None, None
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(data), "<i8")
                if name != lang and total is not None:
                    yield packed({lang: total})
                lang, total = name, got + total if name == lang else got
        if total is not None:
            yield packed({lang: total})

    part = rows.filter(pick < limit[F.col("lang")]).select("text", "lang").mapInArrow(lambda batches: released(learnt(batches)), "lang string, sums binary")
    sums = part.repartition("lang").sortWithinPartitions("lang").mapInArrow(summed, "lang string, sums binary").collect()
    found = {r.lang: np.frombuffer(zlib.decompress(r.sums), "<i8") for r in sums}
    return model_of({k: ({n: v[i << BITS : i + 1 << BITS] for i, n in enumerate(ORDERS)}, v[size:]) for k, v in found.items()})


def identify(documents: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row, from its text alone."""
    n_languages = len(model.languages)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2**BITS rows of one float a language and order

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        size = BLOCK // max(1, n_languages // 8)
        for batch in batches:
            for at, texts in blocks([t or "" for t in batch.column(1).to_pylist()], size):
                got = predict(texts, shared.value, switch)
                lang, score, spans = (list(x) for x in zip(*got, strict=True))
                spans = [[{"start": s, "end": e, "lang": x} for s, e, x in row] for row in spans]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"]
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(lambda batches: released(run(batches)), f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def crc_fold(doc_id, folds: int) -> int:
    """The remainder of ``held_out`` in Python."""
    return zlib.crc32(str(doc_id).encode()) % folds

"""Toxic spans by a linear-chain conditional random field over the words of a text.

Two states, clean and toxic. A word's emission is the sum of weights of its hashed character n-grams; forward
and backward passes give each word's marginal. Marginals are aggregated to features of the document
and a logistic layer turns them into its score; words of high marginal are reported as spans.

Token labels for the fit come from document labels: n-grams that tell toxic documents from clean ones are chosen one
by one, each by the toxic documents that those before it leave unexplained (so a group of copies speaks once), and
a word of a toxic document is labelled toxic when it has a chosen n-gram.

Defined results: null and empty texts get the score of a document without words; texts of any length are scored whole; without
labels of both kinds every score is 0 and ``reject`` keeps every row; a doc_id with several labels is toxic if one says so; null ids and null labels
teach nothing; equal texts get equal scores, each row its own; an empty table gives no rows; ``score`` ignores extra columns, ``reject`` keeps them.
"""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordgrams as W
from .common import blocks, released

ORDERS, BITS = (3, 4, 5, 6, 7, 8), 20
#: The bounds of the training sample: about so many toxic and clean labelled documents in the order of a hash, of whatever length, until
#: their texts hold so many characters a document on average.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1200, 2800, 2_500
#: In the fit, a long text is chains of so many words, and chains of about so many words are worked on at once; code points scored at once.
CHAIN, FIT_WORDS, BLOCK = 256, 1 << 19, 1 << 21
#: An n-gram speaks for toxicity if it is in so many documents, its likelihood-ratio statistic is so high and so few clean ones hold it.
LEAST_DOCUMENTS, LEAST_G2, CLEAN_SHARE = 4, 22.0, 0.004
#: Beside the chosen ones, n-grams speak that reach this statistic when documents count no more than distinct neighbourhoods.
SURE_G2 = 45.0
ITERATIONS, STEP, DECAY = 30, 0.5, 1e-4
SPAN_MARGINAL, FLOOR = 0.5, 0.25


class Model(NamedTuple):
    weights: dict[int, np.ndarray]
    bias: float
    moves: np.ndarray  # log potentials from state to state
    layer: np.ndarray  # of the document's features


def _lift(r: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log odds of the toxic state after one move, given log odds r before it."""
    m, x = np.exp(moves), np.exp(np.clip(r, -300, 300))
    return np.log((m[0, 1] + m[1, 1] * x) / (m[0, 0] + m[1, 0] * x))


def forward_backward(emit: np.ndarray, first: np.ndarray, moves: np.ndarray):
    """(forward, backward) log odds of every word; the sum gives the marginal's. Texts are worked on side by side."""
    base, active = W.steps(first)
    alpha, beta = np.empty(len(emit)), np.zeros(len(emit))
    for t, m in enumerate(active):
        at = base[:m] + t
        alpha[at] = emit[at] + (_lift(alpha[at - 1], moves) if t else 0.0)
    back = moves.T
    for t in range(len(active) - 1, 0, -1):
        at = base[: active[t]] + t
        beta[at - 1] = _lift(emit[at] + beta[at], back)
    return alpha, beta


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: a constant, the log of the number of toxic words by marginals above a floor (so length alone adds nothing), the highest marginal."""
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    top = np.zeros(len(n))
    np.maximum.at(top, owner, p)
    return np.stack([np.ones(len(n)), np.log1p(np.bincount(owner, np.maximum(p - FLOOR, 0) / (1 - FLOOR), len(n))), top], 1)


def _fit_layer(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
    return w


def _g2(holds: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The likelihood-ratio statistic of columns that toxic documents hold too often, else 0."""
    expected = holds.sum(0) * (of / of.sum())[:, None]
    g2 = 2 * (holds * np.log(np.maximum(holds, 1e-9) / np.maximum(expected, 1e-9))).sum(0)
    return np.where(holds[1] > expected[1], g2, 0.0)


def _speaking(holds: np.ndarray, toxic: list[np.ndarray], n_clean: int, length: np.ndarray) -> np.ndarray:
    """The chosen columns. holds: clean and toxic documents that hold each; toxic: the sorted columns of each toxic document."""
    chosen, left, open_ = np.zeros(holds.shape[1], bool), holds.copy(), list(toxic)
    rare = holds[0] <= CLEAN_SHARE * n_clean
    while open_:
        of = np.array([n_clean, len(open_)])
        g2 = np.where((left[1] >= LEAST_DOCUMENTS) & rare, _g2(left, of), 0.0)
        best = int(np.lexsort((length, g2.round(6)))[-1])
        if g2[best] < LEAST_G2:
            break
        chosen[best] = True
        still = []
        for held in open_:
            k = np.searchsorted(held, best)
            if k < len(held) and held[k] == best:
                left[1, held] -= 1
            else:
                still.append(held)
        open_ = still
    return chosen


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model of (text, label) rows."""
    none = Model({n: np.zeros((1 << BITS, 1), np.float32) for n in ORDERS}, -4.0, np.zeros((2, 2)), np.array([-1e3, 0, 0]))
    y = np.array([label for _, label in rows], float)
    if not len(rows) or y.min() == y.max():
        return none
    # The n-grams of every distinct word, as (word, table row) pairs by order; a column is order * 2**BITS + table row.
    seen: dict[str, int] = {}
    numbered, counts = [], []
    for _, texts in blocks([t for t, _ in rows], BLOCK):
        found = W.words(texts, {}, BITS)
        owner = np.repeat(np.arange(len(texts)), np.diff(found.first))
        spelled = (texts[d][s:e].lower() for d, s, e in zip(owner.tolist(), found.start.tolist(), found.end.tolist(), strict=True))
        numbered.append(np.fromiter((seen.setdefault(w, len(seen)) for w in spelled), np.int32, len(owner)))
        counts.append(np.diff(found.first))
    word, sizes = np.concatenate(numbered), np.concatenate(counts)
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    del numbered, found, owner
    chars = np.frombuffer(f"\0{chr(0).join(seen)}\0".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = (np.cumsum(chars == 0) - 1).astype(np.int32)
    # How many documents of either label hold an n-gram, an order at a time; rare ones are let go at once.
    pairs = np.sort(doc.astype(np.int64) * len(seen) + word)
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])[: len(pairs)]]
    row, col, names, holds = [], [], [], []
    toxic: list[list[np.ndarray]] = [[] for _ in range(int(y.sum()))]
    number = np.cumsum(y == 1) - 1
    for i, n in enumerate(ORDERS):
        at, inside = W.grams(chars, n, BITS)
        r, c = of[: len(at)][inside], at[inside].astype(np.int32)
        del at, inside
        head, held_by, mine = np.searchsorted(r, np.arange(len(seen) + 1)), np.zeros((2, 1 << BITS), np.float32), []
        for lo in range(0, len(rows), 128):
            a, b = np.searchsorted(pairs, [lo * len(seen), (lo + 128) * len(seen)])
            w, d = pairs[a:b] % len(seen), pairs[a:b] // len(seen)
            size = head[w + 1] - head[w]
            at = np.repeat(head[w] - np.cumsum(size) + size, size) + np.arange(size.sum())
            held = np.sort(np.repeat(d, size) << BITS | c[at])
            held = held[np.concatenate([[True], held[1:] != held[:-1]])[: len(held)]]
            of_doc, held = held >> BITS, (held & ((1 << BITS) - 1)).astype(np.int32)
            bad = y[of_doc] == 1
            held_by[0] += np.bincount(held[~bad], minlength=1 << BITS)
            held_by[1] += np.bincount(held[bad], minlength=1 << BITS)
            mine.append((number[of_doc[bad]], held[bad]))
        common = held_by.sum(0) >= LEAST_DOCUMENTS
        slot = (np.cumsum(common) - 1 + sum(map(len, names))).astype(np.int32)
        for d, held in mine:
            held, d = slot[held[common[held]]], d[common[held]]
            cuts = np.flatnonzero(np.diff(d)) + 1
            for k, part in zip(d[np.r_[0, cuts]] if len(d) else [], np.split(held, cuts), strict=False):
                toxic[k].append(part)
        kept = common[c]
        row.append(r[kept])
        col.append(slot[c[kept]])
        del r, c, kept, mine, slot
        names.append(np.flatnonzero(common) + (i << BITS))
        holds.append(held_by[:, common])
    row, col, names, holds = np.concatenate(row), np.concatenate(col), np.concatenate(names), np.concatenate(holds, 1).astype(float)
    toxic = [np.concatenate(x) if x else np.empty(0, np.int32) for x in toxic]
    speaks = _speaking(holds, toxic, len(rows) - len(toxic), np.asarray(ORDERS)[names >> BITS])
    # The same in copies counts once: distinct (word before, word, word after) that hold an n-gram in toxic documents.
    before, after = np.r_[-1, word[:-1]], np.r_[word[1:], -1]
    _, once = np.unique(np.stack([before, word, after])[:, y[doc] == 1], axis=1, return_index=True)
    around = np.bincount(word[y[doc] == 1][once], minlength=len(seen))
    varied = np.bincount(col, around[row], len(names))
    sure = np.stack([holds[0], np.minimum(holds[1], varied)])
    speaks |= (_g2(sure, np.array([len(rows) - len(toxic), len(toxic)])) >= SURE_G2) & (holds[0] <= CLEAN_SHARE * (len(rows) - len(toxic)))
    marked = np.zeros(len(seen), bool)
    np.logical_or.at(marked, row, speaks[col])
    z = (marked[word] & (y[doc] == 1)).astype(np.int8)
    # Gradient ascent with per-weight steps on the conditional log likelihood, some chains at a time.
    theta, bias, moves = np.zeros(len(names)), float(np.log(z.mean() + 1e-4)), np.zeros((2, 2))
    g2, b2, m2 = np.full(len(names), 1e-8), 1e-8, np.full((2, 2), 1e-8)
    ends = np.cumsum(sizes)
    heads = np.concatenate([np.arange(e - n, e, CHAIN) for e, n in zip(ends, sizes, strict=True)] or [np.empty(0, int)]).astype(np.int64)
    parts = [heads[k] for k in np.unique(np.searchsorted(heads, np.arange(0, len(word), FIT_WORDS)))] + [len(word)]
    for _ in range(ITERATIONS):
        value, rest_of, rest_all, pairs_left = np.bincount(row, theta[col], len(seen)) + bias, np.zeros(len(seen)), 0.0, np.zeros((2, 2))
        for lo, hi in zip(parts, parts[1:], strict=False):
            first = np.append(heads[np.searchsorted(heads, lo) : np.searchsorted(heads, hi)], hi) - lo
            own = word[lo:hi]
            emit = value[own]
            alpha, beta = forward_backward(emit, first, moves)
            rest = z[lo:hi] - _sigmoid(alpha + beta)
            rest_of += np.bincount(own, rest, len(seen))
            rest_all += rest.sum()
            # Pairs: state before by alpha, move, state after by emission and beta.
            inner = np.ones(hi - lo, bool)
            inner[first[:-1]] = False
            now = np.flatnonzero(inner)
            after = emit[now] + beta[now]
            log = np.stack([[np.full(len(now), moves[0, 0]), moves[0, 1] + after], [alpha[now - 1] + moves[1, 0], alpha[now - 1] + moves[1, 1] + after]])
            log -= log.max((0, 1))
            np.exp(log, out=log)
            pairs_left -= (log / log.sum((0, 1))).sum(2)
            pairs_left += np.bincount(2 * z[lo:hi][now - 1] + z[lo:hi][now], minlength=4).reshape(2, 2)
        grad = np.bincount(col, rest_of[row], len(names)) - DECAY * len(z) * theta / len(rows)
        for old, g, acc in ((theta, grad, g2), (moves, pairs_left, m2)):
            acc += g * g
            old += STEP * g / np.sqrt(acc)
        b2 += rest_all**2
        bias += STEP * rest_all / np.sqrt(b2)
    weights = {}
    for i, n in enumerate(ORDERS):
        mine = names >> BITS == i
        weights[n] = np.zeros((1 << BITS, 1), np.float32)
        weights[n][names[mine] & ((1 << BITS) - 1), 0] = theta[mine]
    value, p = np.bincount(row, theta[col], len(seen)) + bias, np.empty(len(word))
    for lo, hi in zip(parts, parts[1:], strict=False):
        first = np.append(heads[np.searchsorted(heads, lo) : np.searchsorted(heads, hi)], hi) - lo
        alpha, beta = forward_backward(value[word[lo:hi]], first, moves)
        p[lo:hi] = _sigmoid(alpha + beta)
    return Model(weights, bias, moves, _fit_layer(document_features(p, np.append(0, ends)), y))


def tag(texts: list[str], model: Model):
    """Scores of the texts; spans per text as (start, end, marginal) in code points, neighbours merged."""
    found = W.words(texts, model.weights, BITS)
    alpha, beta = forward_backward(found.scores[:, 0].astype(float) + model.bias, found.first, model.moves)
    p = _sigmoid(alpha + beta)
    score = _sigmoid(document_features(p, found.first) @ model.layer)
    spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    hot = np.flatnonzero(p >= SPAN_MARGINAL)
    owner = np.searchsorted(found.first, hot, side="right") - 1
    previous = (-1, -1)
    for k, d in zip(hot.tolist(), owner.tolist(), strict=True):
        if previous == (k - 1, d):
            s, _, q = spans[d].pop()
            spans[d].append((s, int(found.end[k]), max(q, float(p[k]))))
        else:
            spans[d].append((int(found.start[k]), int(found.end[k]), float(p[k])))
        previous = (k, d)
    return score, spans


def train(documents: DataFrame, labels: DataFrame, learn: Column, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on about so many rows of each label, picked by a hash among the labelled rows that ``learn`` (on doc_id) admits.

    The texts of the picked ids are found by all tasks of the scan; only they meet in the one task that fits. It takes them in the order of the hash
    until a label's texts hold ``chars`` characters a document, so the bound doesn't favour short texts.
    """
    marks = labels.filter(learn & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    counts = {r[0]: r[1] for r in marks.filter("label_id IS NOT NULL").groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return fit([])
    pick = lambda x: F.pmod(F.xxhash64(F.col(x), F.lit("sample")), F.lit(1 << 30))
    limit = [int(min(1, n / counts[k]) * (1 << 30)) for k, n in ((0, clean), (1, toxic))]
    some = {r.label_id: r.toxic for r in marks.filter(pick("label_id") < F.when(F.col("toxic") == 1, limit[1]).otherwise(limit[0])).collect()}
    if not some:
        return fit([])

    def run(batches):  # one task of bounded size; its worker has more room than the driver
        rows, left = [], [clean * chars, toxic * chars]
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if left[some[k]] > 0:
                    left[some[k]] -= len(text)
                    rows.append((text, some[k]))
        model = fit(rows)
        taken = [sum(label == k for _, label in rows) for k in (0, 1)]
        if min(taken):  # the sample holds the classes in other shares than all labelled rows
            model.layer[0] += np.log(counts[1] / counts[0]) - np.log(taken[1] / taken[0])
        packed = {n: (np.flatnonzero(w), w[w != 0]) for n, w in ((n, w[:, 0]) for n, w in model.weights.items())}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model._replace(weights=packed))], pa.binary())], ["model"])

    rows = documents.filter(F.col("doc_id").isin(list(some)) & F.col("text").isNotNull()).select("doc_id", "text")
    rows = rows.repartition(1).sortWithinPartitions(pick("doc_id"), "doc_id", "text")
    found = rows.mapInArrow(lambda batches: released(run(batches)), "model binary").first()
    model = pickle.loads(found[0]) if found else fit([])._replace(weights={})
    weights = {n: np.zeros((1 << BITS, 1), np.float32) for n in ORDERS}
    for n, (at, w) in model.weights.items():
        weights[n][at, 0] = w
    return model._replace(weights=weights)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, spans) of every row, from its text alone."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # one float for each of 2**BITS rows and order

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
        for batch in batches:
            for at, texts in blocks([t or "" for t in batch.column(1).to_pylist()], BLOCK):
                scores, spans = tag(texts, shared.value)
                spans = [[{"start": s, "end": e, "marginal": q} for s, e, q in row] for row in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(lambda batches: released(run(batches)), f"doc_id {kind}, score double, spans array<struct<start:int,end:int,marginal:double>>")


def reject(documents: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns; nothing is shuffled."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            scores = [tag(block, shared.value)[0] for _, block in blocks(texts, BLOCK)]
            yield batch.filter(pa.array(np.concatenate(scores) < threshold)) if scores else batch

    return documents.mapInArrow(lambda batches: released(run(batches)), documents.schema)

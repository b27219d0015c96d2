import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracewell.llm import packing as P
from tracewell.llm.queries import op3_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = list("ab sS'\n\t  12.,!é  字😀x") + ["'s", "'re", "'ll", " 't", "''", "<|endoftext|>", "\0", "́", "Ⅷ", "²"]


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder(PATH)


FRESH = Tokenizer.from_file(PATH)  # as the file has it, never the encoder's own


def plain(encoder, text):
    return FRESH.encode(text, add_special_tokens=False).ids


def test_strings_of_added_tokens_are_those_tokens(encoder):
    texts = ["a <|endoftext|> b", "plain", "<|endoftext|><|endoftext|>", "", "<|endoftext"]
    assert [x.tolist() for x in encoder.encode(texts)] == [plain(None, t) for t in texts]
    assert encoder.encode(texts[:1])[0].tolist() == [64, 220, 50256, 275]


def test_ids_are_the_tokenisers(encoder):
    rng = random.Random(2)
    texts = ["", " ", "  a", "a  ", "don't we'll 'tis it''s x's't", "\n's", "a\n\nb"]
    texts += ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(3000)]
    got = encoder.encode(texts)
    assert len(got) == len(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == plain(encoder, text), repr(text)


def test_a_full_store_keeps_what_most_blocks_held(monkeypatch):
    monkeypatch.setattr(P, "KEPT", 40)
    small, rng = P.Encoder(PATH), random.Random(5)
    for _ in range(60):
        texts = [" ".join(["of the", *(rng.choice("abcdef") * rng.randint(1, 9) for _ in range(rng.randint(0, 12)))]) for _ in range(4)] + ["", "of " + "".join(rng.choices(ALPHABET, k=30))]
        assert [x.tolist() for x in small.encode(texts)] == [plain(small, t) for t in texts]
        assert "of" in small.number and len(small.number) == len(small.sizes) == len(small.met) and small.sizes.sum() == len(small.ids)
    assert small.met[small.number[" the"]] > 1


def test_fullest_is_the_best_subset():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(0, 4) for _ in range(5)}
        room = rng.randint(0, 70)
        items = [x for x, n in counts.items() for _ in range(n)]
        best = max(s for s in (sum(c) for k in range(len(items) + 1) for c in set(itertools.combinations(sorted(items), k))) if s <= room) if len(items) <= 11 else None
        got = P.fullest(counts, room)
        assert all(n <= counts[x] for x, n in got.items())
        if best is not None:
            assert sum(x * n for x, n in got.items()) == best


def test_bins_use_everything_and_few_are_needed():
    rng = random.Random(4)
    histogram = {x: rng.randint(0, 40) for x in range(1, 100)}
    found = P.combinations(histogram, 100)
    assert all(sum(x * c for x, c in combo.items()) <= 100 for _, combo in found)
    used = {x: sum(t * combo.get(x, 0) for t, combo in found) for x in histogram}
    assert used == histogram
    least = max(-(-sum(x * n for x, n in histogram.items()) // 100), sum(n for x, n in histogram.items() if x > 50))
    assert sum(t for t, _ in found) <= least * 1.02 + 1
    assert P.combinations({}, 100) == []


def check(rows, texts, encoder, capacity):
    docs, bins = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert docs.keys() == texts.keys()
    for k, mine in docs.items():
        ids = np.array([*plain(encoder, texts[k] or ""), 2], "<u4")
        mine.sort(key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert [(r.start, r.length) for r in mine] == P.cut(len(ids), capacity)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
    for mine in bins.values():
        end = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= capacity
    least = max(-(-sum(r.length for r in rows) // capacity), sum(r.length > capacity // 2 for r in rows))
    assert len(bins) <= least * 1.02 + 1


def test_whole_table(spark, sf, encoder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(op3_packing(spark, sf).collect(), texts, encoder, 1024)


def test_nulls_and_long_texts(spark, encoder):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "a"}
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id bigint, text string, length int")
    check(P.pack_documents(docs, PATH, capacity=64).collect(), texts, encoder, 64)
    ids = P.pack_documents(docs, PATH, capacity=64, with_ids=True).filter("doc_id = 4").first().ids
    assert ids == [*plain(encoder, "a"), 2]
    assert P.pack_documents(docs.limit(0), PATH).count() == 0

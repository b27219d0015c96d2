import random
import re

import xxhash

from tracewell.llm.components import connected_components
from tracewell.llm.simhash import near_duplicates


def slow_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps, bits=4):
    label = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= bits and label[a] > label[b]:
                    label[a], changed = label[b], True
    return label


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(300)] + ["É", "straße", "Ünï"]
    texts = [None, "", "  \t\n", "one", "One", "a b c", "a b c d", "a\x0bb\x0cc\rd e"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 300))]
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append("  ".join(copy).title())
    rows = [(i + 1, t, "x") for i, t in enumerate(texts)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, component_id string"), shingle=4).collect()
    fps = {i: slow_fingerprint(t) for i, t, _ in rows}
    assert {r.doc_id: r.fp % 2**64 for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == slow_components(fps)


def test_large_group_is_compared_in_chunks(spark, monkeypatch):
    from tracewell.llm import simhash

    monkeypatch.setattr(simhash, "CHUNK", 4)
    rng = random.Random(7)
    fps = sorted({rng.getrandbits(6) | rng.getrandbits(3) << 40 for _ in range(200)})
    classes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp bigint, rep bigint")
    comps = {r.node: r.component for r in connected_components(simhash.close_links(classes, 1)).collect()}
    want = slow_components(dict(enumerate(fps)), 1)
    assert {i: comps.get(i, i) for i in range(len(fps))} == want


def test_similar_groups_keep_one_of_each(spark):
    from tracewell.llm.simhash import shingles, similar_groups

    rng = random.Random(9)
    vocabulary, texts, groups = ["w%d" % i for i in range(5000)], [None, "", None, "solo", "solo"], []
    for _ in range(20):
        base = rng.choices(vocabulary, k=200)
        group = [len(texts) + k for k in range(4)]
        texts += [" ".join(base), " ".join(base), " ".join([*base[:100], "edited", *base[101:]]).upper(), " ".join(["x", *base])]
        groups.append(group)
    texts += [" ".join(rng.choices(vocabulary, k=150)) for _ in range(60)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, component int")
    dropped = {r.doc_id: r.leader for r in similar_groups(frame).collect()}
    assert all(lead < d and lead not in dropped for d, lead in dropped.items())
    for d, lead in dropped.items():
        a, b = shingles(texts[d], 5), shingles(texts[lead], 5)
        assert len(a & b) >= 0.8 * len(a | b)
    assert {1, 2, 4} <= dropped.keys() and 0 not in dropped and 3 not in dropped
    assert all([k for k in group if k not in dropped] == group[:1] for group in groups)
    assert not dropped.keys() & set(range(len(texts) - 60, len(texts)))
    assert similar_groups(frame.limit(0)).count() == 0


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "u bigint, v bigint")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_similar_groups_leave_no_similar_pair_of_a_large_component(spark, monkeypatch):
    from tracewell.llm import simhash

    rng = random.Random(4)
    head, texts = rng.choices(["w%d" % i for i in range(5000)], k=340), []
    for k in range(12):  # one template, so all are candidates, but under 0.8
        own = [*head, *("t%d_%d" % (k, i) for i in range(60))]
        texts += [" ".join(own), " ".join(own), " ".join([*own[:-1], "edited"]), " ".join(own)]
    rng.shuffle(texts)
    for leaders, members in ((simhash.LEADERS, simhash.MEMBERS), (2, 5)):
        monkeypatch.setattr(simhash, "LEADERS", leaders)
        monkeypatch.setattr(simhash, "MEMBERS", members)
        got = {r.doc_id: r.leader for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
        kept, want = [], {}
        sets = [simhash.shingles(t, 5) for t in texts]
        for d, own in enumerate(sets):
            lead = next((k for k in kept if len(own & sets[k]) >= 0.8 * len(own | sets[k])), None)
            if lead is None:
                kept.append(d)
            else:
                want[d] = lead
        assert len(kept) == 12 and got == want


def test_any_number_of_blocks_finds_all_links(spark):
    from tracewell.llm import simhash

    assert [simhash.blocks_for(n, 4) for n in (0, 1 << 20, 1 << 28, 1 << 33, 1 << 36)] == [6, 6, 7, 7, 8]
    rng = random.Random(3)
    fps = []
    for _ in range(60):
        base = rng.getrandbits(64)
        fps += [base, base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))]
    fps = sorted(set(fps))
    classes = spark.createDataFrame([(f - (f >> 63 << 64), i) for i, f in enumerate(fps)], "fp bigint, rep bigint")
    want = slow_components(dict(enumerate(fps)), 4)
    for blocks in (6, 8, 9):
        comps = {r.node: r.component for r in connected_components(simhash.close_links(classes, 4, blocks)).collect()}
        assert {i: comps.get(i, i) for i in range(len(fps))} == want


def test_pairs_at_the_least_similarity_are_met(spark):
    from tracewell.llm.simhash import shingles, similar_groups, wide_key_shape

    assert wide_key_shape(1000, 0.8)[0] == 4 < wide_key_shape(1 << 30, 0.8)[0]
    assert wide_key_shape(1000, 0.8)[1] < 90 and wide_key_shape(1000, 0.95)[1] < 20
    rng, texts = random.Random(12), []
    vocabulary = ["w%d" % i for i in range(9000)]
    for _ in range(150):  # a run of new words at the end, so that about 0.81 of the shingles stay
        base = rng.choices(vocabulary, k=300)
        texts += [" ".join(base), " ".join(base[:270] + rng.choices(vocabulary, k=28))]
    pairs = [k for k in range(0, 300, 2) if len(shingles(texts[k], 5) & shingles(texts[k + 1], 5)) >= 0.8 * len(shingles(texts[k], 5) | shingles(texts[k + 1], 5))]
    dropped = {r.doc_id for r in similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert len(pairs) > 100 and sum(k + 1 in dropped for k in pairs) >= 0.93 * len(pairs)


def test_rows_without_an_id_and_very_long_texts(spark):
    from tracewell.llm.simhash import similar_groups

    long = " ".join("w%d" % (i * 7919 % 100_003) for i in range(150_000))
    rows = [(None, "a b"), (None, "a b"), (3, "a b"), (3, "a b"), (4, long), (5, long + " x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.leader for r in similar_groups(frame).collect() if r.doc_id is not None}.items() >= {5: 4}.items()
    got = near_duplicates(frame).collect()
    assert len(got) == 6 and {r.component_id for r in got if r.doc_id is None} <= {3}
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id == 5} == {(5, 4)}

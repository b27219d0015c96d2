import time

from tracewell.llm import licenses as L
import itertools
import random
import re

from tracewell.llm.licenses import TEMPLATES, align, longest_increasing, prepare, scan, scan_documents
from tracewell.llm.queries import op2_licenses

PREPARED = prepare(TEMPLATES)


def test_longest_increasing():
    rng = random.Random(1)
    for _ in range(200):
        values = rng.sample(range(20), rng.randint(0, 8))
        got = longest_increasing(values)
        assert got == sorted(got) and all(values[i] < values[j] for i, j in itertools.pairwise(got))
        best = max(k for k in range(len(values) + 1) for c in itertools.combinations(values, k) if list(c) == sorted(c))
        assert len(got) == best


def test_alignment_is_increasing_and_finds_edits():
    a, b = "x y the quick brown fox jumps over the lazy dog z".split(), "the quick red fox jumps over a lazy dog".split()
    pairs = align(a, b)
    assert [b[j] for _, j in pairs] == "quick fox jumps over lazy dog".split() or len(pairs) == 7
    assert all(a[i] == b[j] for i, j in pairs) and all(p < q and r < s for (p, r), (q, s) in itertools.pairwise(pairs))
    assert align([], b) == [] and align(a, []) == []


def test_every_template_is_found_whole_and_edited():
    rng = random.Random(2)
    filler = ["lorem", "ipsum", "dolor", "the", "of", "software", "this"]
    for name, text in TEMPLATES.items():
        before, after = " ".join(rng.choices(filler, k=3000)), " ".join(rng.choices(filler, k=500))
        words = text.split()
        if len(words) > 20:
            words[3] = "edited"
        page = f"{before}. {' '.join(words).upper()} {after}"
        assert any(m.name == name and m.coverage >= 0.8 and m.end > len(before) for m in scan(page, PREPARED)), name
        assert scan(before, PREPARED) == []


def test_repeats_ties_nulls(spark):
    line = "Released under the MIT License."
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, f"{line}\n{line}", "a"), (3, f"İ {line}", "a")], "doc_id bigint, text string, license string")
    got = sorted((r.doc_id, r.license or "", r.n_matches) for r in scan_documents(docs).collect())
    assert got == [(1, "", 0), (2, "", 0), (3, "MIT", 1), (3, "MIT", 2)]
    assert scan_documents(docs.limit(0)).count() == 0


def test_whole_table_against_plain_search(spark):
    sf = "/root/testdata/sf0.01"
    lines = {"MIT": "released under the mit license", "GPL-3.0": "this work is licensed under the gnu general public license version 3", "Apache-2.0": "licensed under the apache license version 2 0", "CC-BY-NC-4.0": "licensed under cc by nc 4 0"}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.license for r in op2_licenses(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        plain = f" {' '.join(re.findall('[a-z0-9]+', text.lower()))} "
        want = {n for n, line in lines.items() if f" {line} " in plain}
        assert (got[k] in want) if want else got[k] is None
    assert sum(x is not None for x in got.values()) > 5


def test_copies_that_lack_different_guards_are_all_found():
    whole = TEMPLATES["MIT-text"]
    edited, other = whole.replace("sublicense", "sub-license"), whole.replace("documentation", "docs")
    filler = "lorem ipsum dolor " * 200
    for texts in ([edited, whole], [whole, edited], [edited, other, whole, edited]):
        for gap in (filler, "sublicense " + filler + "sublicense ", "\n"):
            got = [m for m in scan(gap.join(texts), PREPARED) if m.name == "MIT-text"]
            assert len(got) == len(texts) and max(m.coverage for m in got) >= (1.0 if gap == filler else 0.98)
            assert all(a.end <= b.start + 60 for a, b in itertools.pairwise(got))
    assert [m.name for m in scan(whole + " sublicense", PREPARED)].count("MIT-text") == 1


def test_notices_one_after_another_are_all_found():
    prepared = L.prepare(L.TEMPLATES)
    for name in ("MIT", "MPL-2.0", "ISC", "CC-BY-4.0", "BSD-3-Clause", "GPL-3.0-header"):
        for n in (1, 2, 3, 5, 20, 50):
            for between in (" ", " filler words here ", "\n\n"):
                got = [m for m in L.scan(between.join([L.TEMPLATES[name]] * n), prepared) if m.name == name]
                assert len(got) == n and all(m.coverage >= 0.8 for m in got), (name, n, between, len(got))


def test_the_longer_of_two_templates_that_fit_is_the_license(spark):
    rows = [(1, L.TEMPLATES["BSD-3-Clause"]), (2, L.TEMPLATES["BSD-2-Clause"])]
    got = {r.doc_id: r.license for r in L.scan_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "BSD-3-Clause", 2: "BSD-2-Clause"}


def test_a_text_of_many_notices_takes_linear_time():
    prepared, began = L.prepare(L.TEMPLATES), time.perf_counter()
    text = "\n".join([L.TEMPLATES["MIT"], "some filler"] * 4000)
    assert sum(m.name == "MIT" for m in L.scan(text, prepared)) == 4000
    assert time.perf_counter() - began < 30

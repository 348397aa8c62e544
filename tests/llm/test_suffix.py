"""Duplicate passages against all pairs of places."""

import random
from collections import defaultdict

import numpy as np
from odd import DOC_SCHEMA, odd_docs

from callweft.llm import suffix_dedup as sa
from callweft.llm.wordhash import WordHashes, windows


def brute(rows, least):
    """Word places of each document that lie in a run of ``least`` words that occurs twice."""
    seen = defaultdict(set)
    rows = sorted({(d, t) for d, t in rows if t}, key=str)
    lists = [t.encode().split() for _, t in rows]
    for i, w in enumerate(lists):
        for p in range(len(w) - least + 1):
            seen[tuple(w[p : p + least])].add((i, p))
    covered = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                covered[i].update(range(p, p + least))
    return {rows[i][0]: c for i, c in covered.items()}


def sample(seed, n, copies=25):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randint(0, 400))
    passages = [[word() for _ in range(rng.choice([49, 50, 51, 70, 200]))] for _ in range(8)]
    out = []
    for i in range(n):
        parts = [[word() for _ in range(rng.randint(0, 120))] for _ in range(2)]
        if i % 2:
            parts.insert(1, rng.choice(passages))
        out.append(" ".join(w for p in parts for w in p))
    hot = [word() for _ in range(60)]
    out += [" ".join([word() for _ in range(30)] + hot + [word() for _ in range(30)]) for _ in range(copies)]
    return [*out, out[0], out[1], " ".join(passages[3] + [word()] + passages[3]), "again " * 300]


def test_minimisers_cover_every_window():
    rng = np.random.default_rng(1)
    for n in (1, 5, 43, 44, 300):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        at = set(sa.minimisers(x, 43).tolist())
        w = min(43, n)
        assert at == {s + int(x[s : s + w].argmin()) for s in range(n - w + 1)}


def test_passages_match_brute_force(spark):
    for seed, n in ((3, 120), (4, 60)):
        docs = odd_docs(spark, sample(seed, n)).repartition(5)
        rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
        want = brute(rows, 50)
        got = defaultdict(set)
        for r in sa.suffix_dedup(docs).collect():
            if r.doc_id is not None:
                assert r.end - r.start >= 50 and r.other_doc_id is not None
                got[r.doc_id].update(range(r.start, r.end))
        assert set(got) == set(want)
        assert all(got[d] == want[d] for d in want)


def test_groups_that_no_task_holds_whole_match_brute_force(spark):
    docs = odd_docs(spark, sample(11, 60, 40)).repartition(5)
    want = brute([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], 50)
    got = defaultdict(set)
    for r in sa.repeated_passages(docs, most=4).collect():
        if r.doc_id is not None:
            got[r.doc_id].update(range(r.start, r.end))
    assert got == want


def test_edges_of_partitions_are_compared(spark):
    docs = odd_docs(spark, sample(5, 40, 60))
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {r.doc_id for r in sa.suffix_dedup(docs).collect() if r.doc_id is not None}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == set(brute(rows, 50))


def test_no_repeat_around_a_frequent_phrase_is_lost(spark):
    """Pairs share own words and a phrase common to all documents, so true partners don't stand next to each other."""
    rng = random.Random(7)
    word = lambda: "w" + str(rng.randint(0, 10**6))
    texts = []
    for own, common in ((25, 30), (10, 45)):
        phrase = [word() for _ in range(common)]
        for _ in range(100):
            shared = [word() for _ in range(own)]
            texts += [" ".join([*(word() for _ in range(20)), *shared, *phrase, *(word() for _ in range(20))]) for _ in range(2)]
    docs = odd_docs(spark, texts).repartition(5)
    want = brute([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], 50)
    got = {}
    for r in sa.suffix_dedup(docs).collect():
        if r.doc_id is not None:
            got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
            assert r.other_doc_id == r.doc_id ^ 1
    assert len(want) == 400 and got == want


def test_a_repeated_row_is_no_partner_of_itself(spark):
    phrase = " ".join(f"p{i}" for i in range(12))
    texts = [" ".join(f"a{d}x{i}" for i in range(40)) + f" {phrase} " + " ".join(f"b{d}x{i}" for i in range(40)) for d in range(3)]
    docs = odd_docs(spark, texts)
    docs = docs.union(docs.filter("doc_id = 1"))
    assert [r for r in sa.suffix_dedup(docs).collect() if r.doc_id is not None] == []


def test_a_row_of_many_words_twice_is_one_document(spark):
    text = " ".join(f"q{i}" for i in range(80))
    docs = odd_docs(spark, [f"{text} x{i}" for i in range(2)] + [" ".join(f"r{i}" for i in range(80))])
    docs = docs.union(docs.filter("doc_id = 2")).union(docs.filter("doc_id < 2")).union(docs.filter("doc_id < 2"))
    assert sorted(tuple(r) for r in sa.suffix_dedup(docs).collect() if r.doc_id is not None) == [(0, 0, 80, 1), (1, 0, 80, 0)]


def test_a_repeat_behind_decoys(spark):
    """Two documents share 50 words whose only shared minimiser lies in the last eight, which 40 others hold in other company."""
    grams = lambda words: windows(WordHashes().of([w.encode() for w in words]), 8)
    word = (f"v{i}" for i in range(10**7))
    shared = [next(word) for _ in range(50)]
    while grams(shared).argmin() != 42:
        shared = [*shared[:42], *(next(word) for _ in range(8))]
    side = lambda n: [next(word) for _ in range(n)]
    texts = [" ".join([*side(60), *shared, *side(60)]) for _ in range(2)]
    texts += [" ".join([*side(60), *shared[42:], *side(60)]) for _ in range(40)]
    found = [tuple(r) for r in sa.suffix_dedup(odd_docs(spark, texts)).collect() if r.doc_id is not None]
    assert sorted(found) == [(0, 60, 110, 1), (1, 60, 110, 0)]


def test_an_empty_table(spark):
    assert sa.suffix_dedup(spark.createDataFrame([], DOC_SCHEMA)).count() == 0

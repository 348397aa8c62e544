"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
from odd import DOC_SCHEMA, doc_rows, odd_docs

from callweft.llm import jaccard_join as jj


def grams(text, k):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    sets = [grams(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(seed, groups, copies, length, edits):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"w{rng.randint(0, 60)}g{g}" for _ in range(length)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(length)] = f"e{rng.randint(0, 9999)}"
            out.append(" ".join(text))
    rng.shuffle(out)
    return out


def test_components_match_all_pairs(spark):
    texts = near_copies(1, 4, 30, 80, 4) + near_copies(2, 20, 4, 40, 2) + near_copies(3, 2, 40, 150, 8)
    texts += ["Big " * 3, "big big big big", "a", "A", "a b", "one two three", "x y z " * 4000, "x y z " * 4001, "K", "k"]
    docs = odd_docs(spark, texts).repartition(4)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k, num, den in ((3, 90, 100), (5, 80, 100)):
        got = sorted((tuple(r) for r in jj.jaccard_join(docs, k, num, den).collect()), key=str)
        assert got == brute(rows, k, num, den)
    kept = jj.first_of_each(docs)
    assert kept.schema == docs.schema
    want = {c for d, n, c in brute(rows, 5, 80, 100) if n and c is not None}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None and grams(r.text, 5)} == want


def test_a_column_with_many_unlinked_rows_takes_several_rounds(spark):
    rng = random.Random(9)
    # a chain of overlapping windows over one long text: neighbours link, distant ones don't
    long = [f"c{i}" for i in range(260)]
    texts = [" ".join(long[i : i + 100]) for i in range(0, 160, 2)] + [" ".join(rng.sample(long, 100)) for _ in range(20)]
    docs = spark.createDataFrame(doc_rows(texts), DOC_SCHEMA)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in jj.jaccard_join(docs, 1, 80, 100).collect()), key=str) == brute(rows, 1, 80, 100)


def test_an_empty_table(spark):
    assert jj.jaccard_join(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_the_bounds_keep_every_pair_that_can_link():
    for n in range(1, 60):
        p = jj.prefix_length(n, 90, 100)
        assert 1 <= p <= n and n - p + 1 >= int(np.ceil(0.9 * n - 1e-9))

"""Decontamination and sentence dedup against brute force."""

import random
import re

from odd import DOC_SCHEMA, doc_rows, odd_docs

from callweft.llm import decontaminate as dc
from callweft.llm import sentence_dedup as sd


def shingles(text, k=5):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def prose(rng, n):
    out = []
    for _ in range(n):
        out.append("".join(rng.choice("abcdefé") for _ in range(rng.randint(2, 7))))
        if rng.random() < 0.12:
            out[-1] += rng.choice([".", ",", "!", "?"])
    return " ".join(out)


def benchmark(spark, seed=4):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.choice([1, 3, 5, 12, 30, 60, 200]))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "?!"), (None, prose(rng, 40)), (7, items[7][1])]
    return items, spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, th string, row string")


def contaminated(rng, items):
    out = []
    for k in range(120):
        words = prose(rng, rng.choice([5, 80, 800])).split()
        if k % 2:
            item = (rng.choice(items)[1] or "").upper().split()
            for _ in range(rng.randint(0, 2)):
                if item:
                    item[rng.randrange(len(item))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = item
        out.append(" ".join(words))
    return [*out, items[5][1], prose(rng, 20000) + " " + items[6][1]]


def test_contained_items_match_brute_force(spark):
    items, bench = benchmark(spark)
    docs = odd_docs(spark, contaminated(random.Random(8), items))
    want = []
    for r in docs.collect():
        s = shingles(r.text)
        for item_id, text in items:
            q = shingles(text)
            if q and 100 * len(q & s) >= 80 * len(q):
                want.append((r.doc_id, item_id, len(q), len(q & s)))
    got = [tuple(r) for r in dc.contained_items(docs, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 20
    clean = dc.decontaminate(docs, bench)
    assert clean.schema == docs.schema
    dirty = {w[0] for w in want}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id not in dirty)


def test_a_large_benchmark_takes_more_passes(spark, monkeypatch):
    items, bench = benchmark(spark)
    docs = odd_docs(spark, contaminated(random.Random(8), items))
    one = sorted(str(tuple(r)) for r in dc.contained_items(docs, bench).collect())
    monkeypatch.setattr(dc, "BLOCK_WORDS", 300)
    assert len(list(dc.item_blocks(bench, 5, 80, 100))) > 3
    assert sorted(str(tuple(r)) for r in dc.contained_items(docs, bench).collect()) == one
    assert sorted(str(r.doc_id) for r in dc.decontaminate(docs, bench).collect())


def test_empty_tables(spark):
    _, bench = benchmark(spark)
    none = spark.createDataFrame([], DOC_SCHEMA)
    assert dc.contained_items(none, bench).count() == 0 and sd.sentence_dedup(none).count() == 0
    docs = odd_docs(spark)
    assert dc.contained_items(docs, bench.limit(0)).count() == 0 and dc.decontaminate(docs, bench.limit(0)).count() == docs.count()


def brute_spans(rows):
    lists = {}
    for doc_id, text in set(rows):
        parts = [re.sub(r"[\x20\x09-\x0D]+", " ", s).strip(" ") for s in re.split(r"(?<=[.!?])[\x20\x09-\x0D]+|[\n\r]+", text or "")]
        lists[doc_id, text] = [s.lower() for s in parts if s]
    first, last, runs = {}, {}, []
    for (doc_id, text), s in lists.items():
        size = [x.count(" ") + 1 for x in s]
        for i in range(len(s)):
            n = next((n for n in range(1, 26) if i + n <= len(s) and (size[i] >= 50 if n == 1 else sum(size[i : i + n]) >= 25)), None)
            if n and (n == 1 or i == 0 or s[i - 1] != s[i] or len(set(s[i : i + n])) > 1):
                place, key = (doc_id is None, doc_id or 0, text, i), tuple(s[i : i + n])
                runs.append((place, key))
                first[key] = min(first.get(key, place), place)
                last[key] = max(last.get(key, place), place)
    out = {}
    for place, key in sorted(runs):
        if first[key] != last[key]:
            spans = out.setdefault((*place[:3], "first" if first[key] == place else "repeat"), [])
            if spans and spans[-1][1] >= place[3]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], place[3] + len(key)), min(spans[-1][2], first[key][1]))
            else:
                spans.append((place[3], place[3] + len(key), first[key][1]))
    return sorted((None if k[0] else k[1], *s, k[3]) for k, v in out.items() for s in v)


def test_sentence_spans_match_brute_force(spark):
    rng = random.Random(12)
    passages = [prose(rng, 70) + "." for _ in range(6)]
    texts = []
    for i in range(80):
        parts = [prose(rng, rng.randint(5, 60)) for _ in range(3)]
        if i % 2:
            parts.insert(rng.randint(0, 3), rng.choice(passages))
        texts.append(rng.choice([" ", "\n", ". "]).join(parts))
    texts += [texts[0], texts[1], "Same short. One two. Three.", "Same short. One two. Three.", (passages[0] + " ") * 4]
    texts += [f"{prose(rng, 20)} " + "".join(f"W{i}!! " for i in range(60)) for _ in range(2)]
    texts += ["Again. " * 80, "Before. " + "Again. " * 80 + prose(rng, 30), " ".join(f"v{i}" for i in range(60)), "Own. " + " ".join(f"v{i}" for i in range(60))]
    docs = odd_docs(spark, texts)
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    got = sorted(tuple(r) for r in sd.sentence_dedup(docs).collect() if r.doc_id is not None)
    assert got == brute_spans(rows) and len(got) > 30
    cleaned = {r.doc_id: r.text for r in sd.without_repeats(docs).collect() if r.doc_id is not None and r.doc_id < 900}
    assert len(cleaned[80].split()) < 25 and cleaned[0] == texts[0] and cleaned[82] == cleaned[83] == texts[82]
    assert cleaned[90] == "Own."


def test_sentence_spans_catch_planted_passages(spark):
    """Carriers of a passage of 55 to 90 words, whole or cut inside its first and last sentence, against clean documents."""
    rng = random.Random(77)

    def sentence(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)).capitalize() + "."

    def text(words):
        out = []
        while sum(map(len, map(str.split, out))) < words:
            out.append(sentence(rng.randint(4, 24)))
        return " ".join(out)

    passages = [text(rng.randint(55, 90)) for _ in range(25)] + [sentence(60), sentence(30) + " " + sentence(30)]
    shared = "It may be read by all. Ask first. All rights are kept."
    texts, carriers = [], set()
    for i in range(500):
        body = [sentence(rng.randint(4, 24)) for _ in range(rng.randint(4, 20))]
        if i % 2:
            words = rng.choice(passages).split()
            if i % 4 == 1:
                words = words[rng.randint(1, 3) : -rng.randint(1, 3)]
            words = words if len(words) > 50 else passages[0].split()
            carriers.add(i)
            body.insert(rng.randrange(len(body)), " ".join(words))
        elif i % 3 == 0:
            body.insert(rng.randrange(len(body)), shared if i % 9 else " ".join([sentence(2)] * 40))
        texts.append(" ".join(body))
    found = {r.doc_id for r in sd.sentence_dedup(spark.createDataFrame(doc_rows(texts), DOC_SCHEMA)).collect()}
    caught, alone = len(found & carriers) / len(carriers), 1 - len(found - carriers) / (500 - len(carriers))
    print(f"caught {caught:.3f}, clean documents left alone {alone:.3f}")
    assert caught >= 0.95 and alone == 1.0


def test_every_run_of_one_sentence_on_demand(spark):
    """By itself one sentence said again and again has a run where it starts only, as in the query's SQL."""
    docs = spark.createDataFrame(doc_rows(["Again. " * 80, "Before. " + "Again. " * 80, "Again. " * 20, None]), DOC_SCHEMA)
    spans = lambda **kw: sorted(tuple(r) for r in sd.sentence_dedup(docs, **kw).collect())
    assert spans() == [(0, 0, 25, 0, "first"), (1, 1, 26, 0, "repeat")]
    assert spans(every=True) == [(0, 0, 25, 0, "first"), (0, 1, 80, 0, "repeat"), (1, 1, 81, 0, "repeat")]
    assert {r.doc_id: r.text for r in sd.without_repeats(docs, every=True).collect()} == {0: "Again.", 1: "Before.", 2: "Again. " * 20, 3: None}

"""Packing and token counts: exact round trip and brute force."""

import random
import time
from collections import defaultdict
from zlib import crc32

import corpus_pipeline
import numpy as np
import public_tokenizers
from odd import DOC_SCHEMA, doc_rows, odd_docs
from tokenizers import Tokenizer

from callweft.llm import packing, token_counts
from callweft.llm.tokens import SPECIAL, encode


def sample_texts():
    rng = random.Random(5)
    words = ["the", "naïve", "x1", "  ", "\n", "don't", "\U0001f600", "%%%", "<|endoftext|>", "日本", "it's", " ", "A"]
    return ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 900))) for _ in range(150)] + ["a" * 5000, " " * 3000]


def test_ids_are_those_of_the_named_vocabulary():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = sample_texts()
    assert [encode(t) for t in texts] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encode(None) == [] == encode("")
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275]


def long_runs():
    """Runs of two million blanks and letters, alone and inside prose, and shorter ones about the border of the cut."""
    rng = random.Random(8)
    prose = " ".join(rng.choice(["the", "naïve", "x1", "don't"]) for _ in range(50))
    for run in (" " * 2_000_000, "\n" * 2_000_000, "\t" * 2_000_000, "a" * 2_000_000):
        yield run
        yield f"{prose}{run}{prose}"
    kinds = [" ", "\n", "\r\n", "\u2003", "\x1c", "\xa0 ", " \n"]
    for run in ["".join(rng.choice(kinds) for _ in range(n)) for n in (99_999, 100_000, 100_001, 250_000)] + [c * 120_000 for c in kinds]:
        yield f"{prose}{run}{prose} {SPECIAL}{run}\n{SPECIAL}"
        yield f"{run}'s{run}"


def test_long_runs_give_the_ids_of_the_named_vocabulary():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in long_runs():
        began = time.process_time()
        got = encode(text)
        assert time.process_time() - began < 5
        assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_runs_are_packed_and_counted(spark):
    docs = spark.createDataFrame(doc_rows(["a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "short"]), DOC_SCHEMA)
    check_packing(packing.pack_documents(docs).collect(), docs.collect(), 1024)
    assert {r.context_limit for r in token_counts.token_counts(docs).collect()} == {len(encode(r.text)) for r in docs.collect()}
    step = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    check_packing(step.collect(), docs.collect(), 1024)


def check_packing(rows, docs, limit):
    ids = defaultdict(list)
    for r in docs:
        ids[r.doc_id].append([*encode(r.text), 0])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for seq in sequences.values():
        seq.sort(key=lambda r: r.offset)
        at = 0
        for r in seq:
            assert r.offset == at
            at += r.length
        assert at == limit or at & (at - 1) == 0
        assert len(seq) <= packing.MAX_SEGMENTS and at <= limit
    for doc_id, texts in ids.items():
        assert sum(r.length for r in pieces[doc_id]) == sum(map(len, texts))
        for r in pieces[doc_id]:
            assert any(len(t) == r.doc_tokens and crc32(np.array(t[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for t in texts)
        if len(texts) == 1:
            at = 0
            for r in sorted(pieces[doc_id], key=lambda r: r.start):
                assert r.start == at
                at += r.length


def test_packing_round_trip(spark):
    docs = odd_docs(spark, sample_texts()).repartition(3)
    check_packing(packing.pack_documents(docs).collect(), docs.collect(), 1024)
    tiny = spark.createDataFrame(doc_rows([""] * 3000), DOC_SCHEMA)
    check_packing(packing.pack_documents(tiny).collect(), tiny.collect(), 1024)
    assert packing.pack_documents(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_examples_stay_whole_within_all_limits(spark):
    rng = random.Random(6)
    rows = [(i, n := rng.randint(0, 1300), rng.randint(0, n)) for i in range(4000)] + [(None, None, None)]
    out = packing.pack_examples(spark.createDataFrame(rows, "example_id long, n_tokens long, n_loss long"), 1024, 8, 600).collect()
    assert sorted(str((r.example_id, r.n_tokens, r.n_loss)) for r in out) == sorted(str((a, b or 0, c or 0)) for a, b, c in rows)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append(r)
    for seq in sequences.values():
        if seq[0].oversize:
            assert len(seq) == 1 and (seq[0].n_tokens > 1024 or seq[0].n_loss > 600)
        else:
            assert sum(r.n_tokens for r in seq) <= 1024 and sum(r.n_loss for r in seq) <= 600 and len(seq) <= 8
    least = sum(r.n_tokens for r in out if not r.oversize) / 1024
    assert len([s for s in sequences.values() if not s[0].oversize]) < 1.25 * least


def test_token_counts(spark):
    docs = odd_docs(spark, sample_texts())
    lengths = [len(encode(r.text)) for r in docs.collect()]
    table = token_counts.token_counts(docs)
    got = {r.context_limit: r for r in table.collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        over = [n for n in lengths if n > limit]
        assert (r.n_docs, r.docs_over, r.tokens_over, r.docs_total, r.tokens_total) == (lengths.count(limit), len(over), sum(over), len(lengths), sum(lengths))
        assert r.tokens_kept == sum(min(n, limit) for n in lengths) and abs(r.quantile - (1 - len(over) / len(lengths))) < 1e-12
    histogram = token_counts.length_histogram(token_counts.token_lengths(docs))
    asked = token_counts.at_limits(histogram, spark.createDataFrame([(0,), (100,), (7,), (10**6,)], "context_limit long")).collect()
    assert {(r.context_limit, r.docs_fitting, r.tokens_kept) for r in asked} == {(x, sum(n <= x for n in lengths), sum(min(n, x) for n in lengths)) for x in (0, 100, 7, 10**6)}
    assert token_counts.length_quantile(table, 0.5).first()[0] == sorted(lengths)[-(-len(lengths) // 2) - 1]
    assert token_counts.token_counts(spark.createDataFrame([], DOC_SCHEMA)).count() == 0

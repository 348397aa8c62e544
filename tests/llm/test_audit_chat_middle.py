"""Filter audit, chat format and fill-in-the-middle against brute force and exact round trips."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from odd import odd_docs
from pyspark.sql import functions as F

from callweft.llm import chat_format as chat
from callweft.llm import fill_middle as fim
from callweft.llm import filter_audit as audit
from callweft.llm import queries as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# ------------------------------------------------------------ filter audit


def audit_texts(seed, n):
    rng = random.Random(seed)
    vocab = ["a", "b", "CC", "d$", "é", "word", "Xy"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocab if i % 2 else vocab[:7]) for _ in range(rng.choice([0, 3, 199, 200, 260]))) for i in range(n)]
    return texts + texts[:9] + texts[:4] + ["CAPS", "\t\n", "x|y"]


def brute_audit(rows, labels):
    def fails(r):
        t, w = r["text"] or "", WORD.findall(r["text"] or "")
        copied = r["doc_id"] is not None and any(o["doc_id"] is not None and o["doc_id"] < r["doc_id"] and (o["text"] or "") == t for o in rows)
        checks = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), copied)
        return {f for f, c in zip("ABCDE", checks, strict=True) if c}

    marked = lambda i, k: any(x["doc_id"] == i and x[k] == 1 for x in labels) if i is not None else False
    parts = {}
    for r in rows:
        parts.setdefault(r["lang"] or "", []).append((fails(r), marked(r["doc_id"], "quality"), marked(r["doc_id"], "toxic")))
    out = Counter()
    for part, docs in parts.items():
        lines, share = [], Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                lost = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                share[f] += len(lost)
                lines.append((f, (part, "".join(order), step, len(left), len(lost), sum(f in d[0] for d in docs) - len(lost), sum(d[0] == {f} for d in docs), sum(d[1] for d in lost), sum(d[2] for d in lost))))
        for f, line in lines:
            out[(*line, share[f])] += 1
    return out


def test_audit_matches_all_orders_one_by_one(spark):
    docs = odd_docs(spark, audit_texts(3, 60)).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "fr").otherwise(F.col("lang")))
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 70, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (9999, 1, 1), (1003, 1, 0), (1003, 1, 0)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).withColumn("part", F.lit(1))
    want = brute_audit([r.asDict() for r in docs.collect()], [r.asDict() for r in frame.collect()])
    got = Counter(tuple(r) for r in audit.filter_audit(docs, frame).collect())
    assert got == want and len({k[0] for k in want}) == 3


def test_audit_of_empty_tables(spark):
    docs, labels = odd_docs(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(docs.limit(0), labels).count() == 0
    assert {r.good_lost for r in audit.filter_audit(docs, labels).collect()} == {0}


def test_polynomial_corners_and_shares():
    rng = random.Random(5)
    counts = {m: rng.randrange(10**15) for m in range(32)}
    p = audit.removal_polynomial(counts)
    for s in range(32):
        assert audit.at_corner(p, s) == sum(n for m, n in counts.items() if m & s)
    shares = [audit.shapley_share(p, i) for i in range(5)]
    assert sum(shares) == 120 * sum(n for m, n in counts.items() if m)
    assert shares[0] == sum(next(i for i in o if m >> i & 1) == 0 and n for m, n in counts.items() if m for o in permutations(range(5)))


# ------------------------------------------------------------ chat format

CONVERSATION = "conv_id long, turn long, role string, text string, formatted string, segment long, t int"
NASTY = ["</s>", "<s>", "<\\s>", "<\\\\/s>", "[INST] a [/INST]", "[\\INST]", "[TURN]", "[ROLE]x[/ROLE]", "[[TURN]]", "<<s>>", "<", "[", "\\", "</", "s>", "", "é\U0001f600", "[\\\\TURN", "<s", "TURN]", "$1\\$2"]


def chats(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        for turn in range(rng.choice([1, 2, 5, 70])):
            text = "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 6)))
            rows.append((c, turn, rng.choice(["user", "assistant", "assistant", "system", "[ROLE]"]), rng.choice([text, text, None])))
    rows += [(100, None, "user", "no number"), (100, None, None, None), (100, 1, "assistant", "a"), (100, 1, "assistant", "a"), (100, 1, "assistant", None), (None, 0, "user", "x"), (None, 3, "assistant", "y"), (101, -5, "", "neg"), (101, -70, "assistant", "first")]
    return [(*r, "clash", 7, 8) for r in rows]


def by_conversation(rows):
    out = {}
    key = lambda r: ((r[1] is not None), r[1] or 0, r[2] or "", r[3] or "")
    for r in sorted(rows, key=lambda r: ((r[0] is not None), r[0] or 0, key(r))):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def test_chats_come_back_and_the_mask_holds_the_assistants_texts(spark):
    rows = chats(1)
    turns = by_conversation(rows)
    made = chat.format_chats(spark.createDataFrame(rows, CONVERSATION))
    read = made.select("conv_id", "formatted", "loss_spans", "n_messages", chat.read_back(F.col("formatted")).alias("turns")).collect()
    assert len(read) == len(turns)
    for r in read:
        want = turns[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.n_messages == sum(i == 0 or want[i - 1][0] != want[i][0] for i in range(len(want)))
        raw = r.formatted.encode()
        back = lambda s: re.sub(r"(?<=<)\\(?=\\*/?s>)|(?<=\[)\\(?=\\*(?:/?(?:INST|ROLE|SYS)|TURN)\])", "", s)
        assert [back(raw[s.start : s.stop].decode()) for s in r.loss_spans] == [x for role, x in want if role == "assistant"]
        marks = re.findall(r"</?s>|\[/?(?:INST|ROLE|SYS)\]|\[TURN\]", r.formatted)
        assert len(marks) == 4 * r.n_messages + len(want) - r.n_messages


def test_chat_digests(spark):
    rows = chats(2)
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(spark.createDataFrame(rows, CONVERSATION))).collect()}
    for c, turns in by_conversation(rows).items():
        loss = "".join(x for role, x in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))


def test_chats_of_an_empty_table_and_a_long_conversation(spark):
    empty = spark.createDataFrame([], CONVERSATION)
    assert chat.format_chats(empty).count() == 0
    assert [r.conv_id for r in chat.chat_digests(chat.format_chats(chat.with_probe(empty))).collect()] == [-7]
    long = spark.range(20000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 7 < 3, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é"), "id").alias("text"))
    r = chat.chat_digests(chat.format_chats(long)).first()
    said = "".join(f"é{i}" for i in range(20000) if i % 7 >= 3)
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (20000, len(said), sha(said))


def test_chats_run_on_spark_expressions_only(spark):
    plan = q.op12_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


# ------------------------------------------------------------ fill in the middle


def brute_middle(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def middle_texts(seed, n):
    rng = random.Random(seed)
    parts = ["abc", "Z", " ", "\n", "é", "\U0001f600", "<", "<P", "P>", "@", "[", "`", "{", "0", "\x7f", "ß", "x" * 90]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 9, 400]))) for _ in range(n)]
    return texts + ["has <M> in it", "<S>", "<p>", "A" * 70000, "é" * 30000, "a b " * 20000, " \r\n\t\u2028"]


@pytest.mark.parametrize("chunk", [8, 1 << 22])
def test_fill_middle_matches_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(fim, "CHUNK", chunk)
    docs = odd_docs(spark, middle_texts(1, 300 if chunk > 8 else 3)).repartition(3)
    rows = docs.select("doc_id", "text").collect()
    if chunk > 8:
        made = fim.fill_middle(docs)
        got = Counter(tuple(r) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect())
        assert got == Counter(brute_middle(r.doc_id, r.text) for r in rows)
        assert {k[2] for k in got} == {"plain", "psm", "spm"}
        back = made.select("doc_id", fim.restored(F.col("form"), F.col("output")).alias("text")).collect()
        assert Counter(map(tuple, back)) == Counter((r.doc_id, r.text or "") for r in rows)
    else:  # chunks of eight bytes, in this process
        data = "".join(r.text or "" for r in rows).encode()[:5000]
        text = data.decode(errors="ignore")
        whole = text.encode()
        units, points = fim.boundaries(np.frombuffer(whole, np.uint8), np.array([0]))
        at = np.cumsum([0] + [len(u.encode()) for u in re.findall(r"[A-Za-z]+|[^A-Za-z]", text)])
        assert (units.select(np.arange(len(at) - 1)) == at[:-1]).all() and (units.rank(at) == np.arange(len(at))).all()
        assert (points.rank(at) == [len(whole[:x].decode()) for x in at]).all()


def test_rank_and_select_match_counting():
    rng = np.random.default_rng(7)
    for share, size in ((0.5, 5000), (0.001, 40000), (1.0, 4096), (0.0, 100), (0.02, 513)):
        bits = rng.random(size) < share
        v, before = fim.Bits(np.packbits(bits)), np.concatenate([[0], np.cumsum(bits)])
        at = np.arange(size + 1)
        assert (v.rank(at) == before).all()
        ones = np.flatnonzero(bits)
        assert (v.select(np.arange(len(ones))) == ones).all()


def test_fill_middle_of_an_empty_table_and_seeds(spark):
    docs = odd_docs(spark, middle_texts(2, 20))
    assert fim.fill_middle_digests(docs.limit(0)).count() == 0
    assert fim.fill_middle(docs, "2").select("output").collect() != fim.fill_middle(docs).select("output").collect()

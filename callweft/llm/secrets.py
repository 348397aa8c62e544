"""Secret scans: fixed patterns plus sliding-window entropy. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweft.llm.common import placed, text_of

#: The base patterns, the group whose length counts, and its least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings of the entropy scan: runs of token characters, and what is left of them beside allowed parts.
RUN = "A-Za-z0-9+/_=-"
CANDIDATE = rf"(?<![{RUN}])[{RUN}]{{20,}}"
WINDOW = 20
#: Spans that ``redact`` works through at a time, so that growing arrays stay short.
BLOCK = 256
SPANS = "array<struct<s:int,k:int,e:int,v:string>>"
#: Character class of a string -> least window entropy in bits; the first class that fits counts. About
#: 1 % of random strings of 20 characters stay below, but for letters and names with separators, which words reach too.
CLASSES = (
    ("digits", r"^[0-9]+$", 2.7),
    ("hex", r"^[0-9a-fA-F]+$", 2.9),
    ("letters", r"^[A-Za-z+/_=-]+$", 3.9),
    ("one case", r"^([0-9a-z]+|[0-9A-Z]+)$", 3.4),
    ("both cases", r"^[0-9A-Za-z]+$", 3.65),
    ("one case with separators", r"^([0-9a-z+/_=-]+|[0-9A-Z+/_=-]+)$", 3.9),
    ("both cases with separators", "", 3.8),
)
#: Allowed parts of a run, by their length: UUIDs, counting runs, placeholders, one character again and again.
ALLOWED = (
    (36, r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    (11, "(?i)placeholder"),
    (10, "(?i)0123456789|abcdefghij"),
    (8, "(?i)changeme"),
    (7, "(?i)example"),
    (5, "(?i)dummy"),
    (4, "(?i)xxxx"),
    (6, rf"([{RUN}])\1{{5}}"),
)
#: Whole runs that are allowed: paths.
PATH = r"^/?[a-z0-9_-]+(/[a-z0-9_-]+){2,}/?$"


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time, also where ``use`` reads it in a loop."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def found(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Array of (s, k, e, v) of the leftmost non-overlapping matches of a pattern, in code points.

    The pieces between matches and the matches alternate, so running sums of their lengths are the
    positions. Matches whose group is shorter than ``least`` are dropped after their place is counted.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.transform(gaps, F.char_length).alias("g"), whole.alias("m"), part.alias("p"))
    length = lambda x: F.coalesce(F.char_length(x["m"]), F.lit(0))

    def hit(at, x):
        start = (at + x["g"]).cast("int")
        span = F.struct(start.alias("s"), F.lit(kind).alias("k"), (start + length(x)).alias("e"), x["m"].alias("v"))
        return F.when(F.char_length(x["p"]) >= least, F.array(span)).otherwise(F.array().cast(SPANS))

    spans = placed(zipped, lambda x: x["g"] + length(x), hit, SPANS)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPANS))


def window_entropy(string: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits) over the windows of a string of token characters.

    Counts per character are kept while the window moves: the character that leaves and the one that
    enters change two counts and the running sum of n*log2(n), whatever the window's length. A string
    shorter than the window has entropy 0.
    """
    first = ord("+")
    size = ord("z") - first + 1
    table = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    all_codes = F.transform(F.split(string, ""), lambda c: (F.ascii(c) - first).cast("int"))
    steps = once(
        all_codes,
        lambda codes: F.transform(
            codes, lambda c, i: F.struct(c.alias("a"), F.when(i >= window, F.get(codes, i - window)).otherwise(-1).alias("b"), i.alias("i"))
        ),
    )
    start = F.struct(
        F.array_repeat(F.lit(0), size).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best")
    )

    def step(acc, x):
        a, b = x["a"], x["b"]
        entering = F.get(acc["n"], a)
        leaving = F.get(acc["n"], b)
        moved = (
            acc["s"]
            + F.get(table, entering + 1)
            - F.get(table, entering)
            + F.when(b >= 0, F.get(table, leaving - 1) - F.get(table, leaving)).otherwise(0.0)
        )
        total = F.when(a == b, acc["s"]).otherwise(moved)
        counts = F.transform(acc["n"], lambda n, k: n + F.when(k == a, 1).otherwise(0) - F.when(k == b, 1).otherwise(0))
        bits = F.when(x["i"] >= window - 1, math.log2(window) - total / window).otherwise(0.0)
        return F.struct(counts.alias("n"), total.alias("s"), F.greatest(acc["best"], bits).alias("best"))

    return F.aggregate(steps, start, step, lambda acc: acc["best"])


def limit_of(value: Column) -> Column:
    """Least entropy of a string's character class."""
    out = F.lit(CLASSES[-1][2])
    for _, pattern, bits in reversed(CLASSES[:-1]):
        out = F.when(value.rlike(pattern), bits).otherwise(out)
    return out


def entropy_spans(text: Column, base: Column) -> Column:
    """Candidate strings with a window of high entropy for their class, outside allowed parts and base spans."""
    kind = len(BASE)
    runs = F.filter(found(text, kind, CANDIDATE, 0, WINDOW), lambda c: ~c["v"].rlike(PATH))

    def rest(c):
        left = c["v"]
        for length, pattern in ALLOWED:
            left = F.regexp_replace(left, pattern, " " * length)
        part = lambda x: F.struct((c["s"] + x["s"]).alias("s"), F.lit(kind).alias("k"), (c["s"] + x["e"]).alias("e"), x["v"].alias("v"))
        return once(left, lambda v: F.transform(found(v, kind, CANDIDATE, 0, WINDOW), part))

    def secret(c, known):
        covered = F.exists(known, lambda b: (b["s"] <= c["s"]) & (b["e"] >= c["e"]))
        return ~covered & (window_entropy(c["v"]) >= limit_of(c["v"]))

    return once(base, lambda known: F.filter(F.flatten(F.transform(runs, rest)), lambda c: secret(c, known)))


def joined(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def with_spans(docs: DataFrame) -> DataFrame:
    """(row, t, base, added): each row as a struct, its text, its base spans, its entropy spans."""
    t = docs.select(F.struct("*").alias("row")).select("row", text_of("row.text").alias("t"))
    parts = t.select("row", "t", *[found(F.col("t"), k, p, g, n).alias(name) for k, (name, p, g, n) in enumerate(BASE)])
    base = parts.select("row", "t", "assign", "access", "hex", F.concat("assign", "access", "hex").alias("base"))
    return base.select("*", entropy_spans(F.col("t"), F.col("base")).alias("added"))


def secret_scan(docs: DataFrame) -> DataFrame:
    """Secrets of every document row.

    doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans), spans (base and entropy spans).
    Null text is empty and has no spans, null doc_id stays null, repeated rows each get a row, other
    columns are ignored, an empty table gives no rows.
    """
    return with_spans(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"),
        *[F.size(name).cast("long").alias(f"n_{name}") for name, *_ in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
    )


def reached(blocks: Column) -> Column:
    """0, and the largest end of the spans up to each block."""
    last = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda x: x["e"])))
    return F.aggregate(last, F.array(F.lit(0)), lambda out, e: F.concat(out, F.array(F.greatest(F.element_at(out, -1), e))))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret span replaced by ``mark``; same columns, n_chars follows.

    Overlapping spans become one mark. Spans are replaced in blocks, each in its own part of the text. Rows without a secret are unchanged, null text included.
    """
    found_in = with_spans(docs).select("row", "t", F.array_sort(F.concat("base", "added")).alias("spans"))

    def pieces(block, begin, end):
        """The text from one place to another with the spans of a block replaced, in pieces."""
        nothing = F.array().cast("array<string>")
        state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

        def step(acc, x, part):
            gap = F.concat(F.substring(part, acc["at"] - begin + 1, x["s"] - acc["at"]), F.lit(mark))
            return state(F.greatest(acc["at"], x["e"]), F.concat(acc["out"], F.when(x["s"] >= acc["at"], F.array(gap)).otherwise(nothing)))

        text = F.substring(F.col("t"), begin + 1, end - begin)
        return once(text, lambda part: F.aggregate(block, state(begin, nothing), lambda acc, x: step(acc, x, part), lambda acc: acc["out"]))

    def cleaned(spans):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), lambda i: F.slice(spans, i * BLOCK + 1, BLOCK))
        return once(blocks, lambda b: once(reached(b), lambda ends: joined_pieces(b, ends)))

    def joined_pieces(blocks, ends):
        done = F.flatten(F.transform(blocks, lambda b, i: pieces(b, F.get(ends, i), F.get(ends, i + 1))))
        rest = F.substring(F.col("t"), F.element_at(ends, -1) + 1, F.char_length("t"))
        return F.concat(F.array_join(done, ""), rest)

    new = found_in.select("row", F.when(F.size("spans") > 0, once(F.col("spans"), cleaned)).otherwise(F.col("row.text")).alias("new"))
    return new.select(
        *[
            F.col("new").alias(c) if c == "text" else F.char_length("new").cast(kind).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
            for c, kind in docs.dtypes
        ]
    )

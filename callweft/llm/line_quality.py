"""Quality rules with cross-document line frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweft.llm.common import SPACES, WORD_CHAR, same_row, text_of, words_of

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: A line is boilerplate where more documents of its host than both of these hold it.
MIN_LINE_DOCS = 20
MAX_LINE_SHARE = 0.05
#: A document is depleted where removal leaves less than this share of its words (percent).
MIN_LEFT_PCT = 30


def base_counts(docs: DataFrame) -> DataFrame:
    """One row per document row: counts of words, symbols, repeated lines and repeated windows.

    Windows are sorted as 64-bit keys whose low bits hold the position and whose other bits hold
    a hash of the three words; neighbours with equal hash bits are compared word by word, so a
    chance collision never counts. Null text counts as empty. Very long texts only move the
    border between position and hash bits.
    """
    t = (
        docs.select("doc_id", "source", text_of().alias("t"))
        .withColumn("w", words_of(F.col("t")))
        .withColumn("n", F.size("w"))
        .withColumn("bits", F.ceil(F.log2(F.col("n") + F.lit(2))).cast("int"))
        .withColumn("lines", F.expr(rf"filter(split(t, '\n'), l -> l rlike '{WORD_CHAR.replace(chr(92), chr(92) * 2)}')"))
    )
    # Each transform(array(x), v -> ...)[0] binds v, so that x is computed once however often v is read,
    # also where a filter on the result is pushed down to the scan.
    same = " and ".join(
        ["shiftright({a}, v.bits) = shiftright(k, v.bits)"] + [f"v.w[int({{a}} & v.mask) + {i}] = v.w[int(k & v.mask) + {i}]" for i in range(3)]
    )
    repeated = f"""
        transform(array(named_struct('w', w, 'bits', bits, 'mask', shiftleft(1L, bits) - 1)), v ->
          transform(array(sort_array(transform(slice(v.w, 1, greatest(size(v.w) - 2, 0)),
            (x, i) -> shiftleft(xxhash64(x, v.w[i + 1], v.w[i + 2]), v.bits) | cast(i as bigint)))),
          keys -> aggregate(
            sort_array(transform(filter(keys, (k, j) ->
                (j > 0 and {same.format(a="get(keys, j - 1)")})
                or (j < size(keys) - 1 and {same.format(a="get(keys, j + 1)")})), k -> k & v.mask)),
            named_struct('n', 0L, 'e', 0L),
            (s, p) -> named_struct('n', s.n + p + 3L - greatest(p, s.e), 'e', p + 3L),
            s -> s.n))[0])[0]"""
    return t.select(
        "doc_id",
        "source",
        F.xxhash64("t").alias("th"),
        F.col("n").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(repeated).alias("n_repeat_words"),
    )


def lines_of(docs: DataFrame) -> DataFrame:
    """One row per line with a word: host, document key, line number, hash, words."""
    clean = F.lower(F.trim(F.regexp_replace("line", SPACES, " ")))
    return (
        docs.select(
            F.coalesce("source", F.lit("")).alias("host"),
            "doc_id",
            text_of().alias("t"),
            F.xxhash64(text_of()).alias("th"),
        )
        .select("host", "doc_id", "th", F.posexplode(F.split("t", "\n")).alias("at", "line"))
        .filter(F.col("line").rlike(WORD_CHAR))
        .select(
            "host",
            "doc_id",
            "th",
            "at",
            F.xxhash64(clean).alias("lh"),
            F.size(F.array_remove(F.split("line", SPACES), "")).alias("words"),
        )
    )


def frequent_lines(docs: DataFrame, min_docs: int = MIN_LINE_DOCS, share: float = MAX_LINE_SHARE) -> DataFrame:
    """Lines (host, lh, n_docs) that more distinct documents of a host hold than the limits allow.

    Exact copies of a text count as one document, so a copied document does not turn its own
    lines into boilerplate. The distinct step carries the text hash in its key, so a line that
    a third of all documents hold is spread over tasks before it is summed.
    """
    each = lines_of(docs).select("host", "lh", "th").distinct()
    often = each.groupBy("host", "lh").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > min_docs)
    hosts = (
        docs.select(F.coalesce("source", F.lit("")).alias("host"), F.xxhash64(text_of()).alias("th"))
        .distinct()
        .groupBy("host")
        .agg(F.count("*").alias("host_docs"))
    )
    return often.join(hosts, "host").filter(F.col("n_docs") > F.col("host_docs") * share).select("host", "lh", "n_docs")


def removed_lines(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """Per document key (doc_id, th): the numbers of its frequent lines and the words they hold.

    Repeated rows of a document give the same set once.
    """
    hit = lines_of(docs).join(frequent.select("host", "lh"), ["host", "lh"], "left_semi")
    return (
        hit.groupBy("doc_id", "th", "host")
        .agg(F.collect_set(F.struct("at", "words")).alias("cut"))
        .select(
            "doc_id",
            "th",
            "host",
            F.transform("cut", lambda c: c["at"]).alias("cut_lines"),
            F.aggregate("cut", F.lit(0), lambda a, c: a + c["words"]).cast("long").alias("cut_words"),
        )
    )


def verdicts(docs: DataFrame, min_docs: int, share: float, min_left_pct: int) -> DataFrame:
    """Base counts and removed lines per document row, with ``base_failed`` and ``kept``."""
    base = base_counts(docs).withColumn("host", F.coalesce("source", F.lit("")))
    cut = removed_lines(docs, frequent_lines(docs, min_docs, share))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT)
    left = F.col("n_words") - F.coalesce("cut_words", F.lit(0))
    return base.join(cut, same_row(base, cut, "doc_id", "th", "host"), "left").select(
        *[base[c] for c in base.columns],
        "cut_lines",
        F.coalesce("cut_words", F.lit(0).cast("long")).alias("n_line_words"),
        failed.alias("base_failed"),
        (~failed & (left * 100 >= F.col("n_words") * min_left_pct)).alias("kept"),
    )


def quality_rules(docs: DataFrame, min_docs: int = MIN_LINE_DOCS, share: float = MAX_LINE_SHARE, min_left_pct: int = MIN_LEFT_PCT) -> DataFrame:
    """Counts and verdict per document row.

    Base rule: fewer than 50 words, or more than half of the words inside repeated three-word
    windows. Method: hash normalised lines, count distinct documents per host (``source``), remove
    lines above the limits, reject documents that keep under ``min_left_pct`` percent of their words.

    Null text is empty (no words, base_failed), null source is the host '', null doc_id stays null,
    repeated rows each get a row, an empty table gives no rows, other columns are ignored.
    """
    return verdicts(docs, min_docs, share, min_left_pct).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words"
    )


def apply_rules(docs: DataFrame, min_docs: int = MIN_LINE_DOCS, share: float = MAX_LINE_SHARE, min_left_pct: int = MIN_LEFT_PCT) -> DataFrame:
    """The documents that ``quality_rules`` keeps, without their frequent lines, same columns.

    ``n_chars`` follows the text. Rules are those of ``quality_rules``.
    """
    # Grouped before it is filtered: a filter on plain columns would be pushed down and count again.
    verdict = (
        verdicts(docs, min_docs, share, min_left_pct)
        .groupBy("doc_id", "th", "host")
        .agg(F.max("kept").alias("kept"), F.first("cut_lines").alias("cut_lines"))
        .filter("kept")
    )
    whole = docs.select(F.struct("*").alias("row")).select(
        "row", F.col("row.doc_id").alias("doc_id"), F.coalesce("row.source", F.lit("")).alias("host"), F.xxhash64(text_of("row.text")).alias("th")
    )
    text = F.when(
        F.size("cut_lines") > 0,
        F.array_join(F.filter(F.split(F.col("row.text"), "\n"), lambda line, i: ~F.array_contains("cut_lines", i)), "\n"),
    ).otherwise(F.col("row.text"))
    kept = whole.join(verdict, same_row(whole, verdict, "doc_id", "th", "host")).select("row", text.alias("new"))
    return kept.select(
        *[
            F.col("new").alias(c) if c == "text" else F.char_length("new").cast(kind).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
            for c, kind in docs.dtypes
        ]
    )

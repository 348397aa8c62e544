"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

The columns of the incidence matrix are taken in one global order, rare n-grams first. A document's
first block holds its ``n - ceil(t*n) + 1`` first columns: two documents with a Jaccard index of at
least ``t`` share a column there. The product over first blocks accumulates overlap counts for pairs.
Bounds discard pairs that can't reach ``t`` any more: one from the two sizes and the place of the shared
column, one from the sizes of both rows in each of 2^BLOCK_BITS blocks of columns (the overlap is at most the
sum of the lesser sizes). For the survivors the product is completed over all columns, exactly.

Equal sets are one row of the matrix from the start. Within a column the product is taken against a
few hub rows a round: rows that a verified link has put in one component need no further product, and later
rounds take more hubs (1, 16, 256, ...) from columns that still hold several components, until none is left
untested. Only a column whose rows no link joins is worked through by all its pairs in the end, less those that
the bounds discard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_digest

from callweft.llm.common import Scratch, small_batches, text_of
from callweft.llm.wordhash import WordHashes, ascii_words, windows

#: Log2 of the counters of the column order; its size (4 MB) doesn't depend on the data.
SKETCH_BITS = 20
#: Log2 of the column blocks whose sizes bound an overlap.
BLOCK_BITS = 7
#: Rows of ids that may be broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def ngram_set(hashes: WordHashes, text: str | None, k: int) -> np.ndarray:
    return np.unique(windows(hashes.of(ascii_words(text)), k))


def column_counts(docs: DataFrame, k: int) -> np.ndarray:
    """How many sets hold the n-grams of each hash bucket, over all documents.

    Only the order of columns depends on it, no result does. Each task sums a vector of fixed size;
    the vectors are added up in a tree.
    """
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, total = WordHashes(), np.zeros(size, np.int64)
        for batch in batches:
            for some in np.array_split(batch["text"].to_numpy(), 1 + len(batch) // 500):
                grams = np.concatenate([ngram_set(hashes, text, k) for text in some]) if len(some) else np.empty(0, np.uint64)
                total += np.bincount((grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
        yield pd.DataFrame({"counts": [total.astype("<f4").tobytes()]})

    def add(total: np.ndarray, row) -> np.ndarray:
        return total + (np.frombuffer(row[0], "<f4") if not isinstance(row, np.ndarray) else row)

    with small_batches(docs.sparkSession):
        rows = docs.select("text").mapInPandas(count, "counts binary").rdd
        return rows.treeAggregate(np.zeros(size, np.float32), add, lambda a, b: a + b, 3)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - (num * n + den - 1) // den + 1


def incidence(docs: DataFrame, k: int, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """Per document row: doc_id, th (hash of its text), n (set size), node (hash of its set), its first block, sizes in column blocks."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, order = WordHashes(), shared.value
        for batch in batches:
            n, node, block, sizes = [], [], [], []
            for text in batch["text"]:
                grams = ngram_set(hashes, text, k)
                n.append(len(grams))
                node.append(int.from_bytes(xxh3_64_digest(grams.tobytes()), "little", signed=True))
                sizes.append(np.bincount((grams >> np.uint64(64 - BLOCK_BITS)).astype(np.int64), minlength=1 << BLOCK_BITS).astype(np.int32))
                if len(grams):
                    rank = order[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    grams = grams[np.lexsort((grams, rank))[: prefix_length(len(grams), num, den)]]
                block.append(grams.view(np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "th": batch["th"], "n": n, "node": node, "block": block, "sizes": sizes})

    keyed = docs.select(F.col("doc_id").cast("string"), F.xxhash64(text_of()).alias("th"), "text")
    out = keyed.mapInPandas(rows, "doc_id string, th long, n long, node long, block array<long>, sizes array<int>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def full_rows(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, grams): the whole matrix rows of the wanted nodes, made again from one text of each.

    Few wanted ids are broadcast, so that texts stay where they are; many are joined by a shuffle.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 1000):
                some = batch.iloc[at : at + 1000]
                yield pd.DataFrame({"node": some["node"], "grams": [ngram_set(hashes, text, k).view(np.int64) for text in some["text"]]})

    few = wanted.count() <= BROADCAST_ROWS
    ids = F.broadcast(wanted) if few else wanted
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("text_hash"), "text")
    joined = texts.join(ids, texts["id"].eqNullSafe(wanted["rep_id"]) & (texts["text_hash"] == wanted["rep_th"]))
    return joined.select("node", "text").mapInPandas(rows, "node long, grams array<long>")


def reaches(overlap: Column, n: Column, m: Column, num: int, den: int) -> Column:
    """Whether an overlap of two sets of sizes n and m gives a Jaccard index of num/den or more."""
    return overlap * (num + den) >= (n + m) * num


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp, moved) of every linked node, a kept table; comp is the least node that its links reach.

    Each round hooks a component to the least one beside it and follows two hooks; the labels are
    written each round.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = scratch.keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp")), "labels")
    while True:
        one = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        two = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        cross = both.join(one, "a").join(two, "b").filter("ca <> cb").select("ca", "cb").distinct()
        pointed = labels.select(F.col("node").alias("ca"), F.col("comp").alias("cb")).filter("ca <> cb")
        hooks = cross.union(pointed).groupBy("ca").agg(F.min("cb").alias("p")).filter("p < ca")
        hooks = hooks.select(F.col("ca").alias("comp"), "p")
        further = hooks.select(F.col("comp").alias("p"), F.col("p").alias("pp"))
        hooks = hooks.join(further, "p", "left").select("comp", F.coalesce("pp", "p").alias("p"))
        moved = scratch.keep(
            labels.join(hooks, "comp", "left").select("node", F.coalesce("p", "comp").alias("comp"), F.col("p").isNotNull().alias("moved")), "labels"
        )
        scratch.drop(labels)
        labels = moved
        if moved.filter("moved").isEmpty():
            return moved


def join_components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, th, n, first_id, first_th) per document row: set size and the first document of its component.

    First is the least doc_id, then the least text hash; null ids come last.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = scratch.keep(incidence(docs, k, num, den, column_counts(docs, k)), "incidence")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    some = F.first(F.struct("n", "block", "sizes")).alias("row")
    nodes = scratch.keep(rows.filter("n > 0").groupBy("node").agg(first, some).select("node", "first", "row.*"), "nodes")
    entries = nodes.select("node", "n", F.posexplode("block").alias("i", "g"))
    several = entries.groupBy("g").agg(F.count("*").alias("rows")).filter("rows > 1").select("g")
    entries = scratch.keep(entries.join(several, "g", "left_semi"), "entries")
    full, links, labels, turn = None, None, None, 0
    while True:
        now = entries.withColumn("comp", F.col("node"))
        if labels is not None:
            now = entries.join(labels.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        open_columns = now.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("g")
        # Written first: few columns are broadcast from the start, many are joined by a sort that splits hot columns.
        open_columns = scratch.keep(open_columns, "columns")
        now = scratch.keep(now.join(open_columns, "g", "left_semi"), "open")
        scratch.drop(entries)
        if now.isEmpty():
            break
        salt = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(16**turn))
        hubs = now.groupBy("g", salt.alias("salt")).agg(F.min(F.struct("i", "n", "node", "comp")).alias("hub")).select("g", "hub")
        hubs = scratch.keep(hubs, "hubs")
        reachable = reaches(F.least(F.col("n") - F.col("i"), F.col("hub.n") - F.col("hub.i")), F.col("n"), F.col("hub.n"), num, den)
        pairs = (
            now.join(hubs, "g")
            .filter(F.col("comp") != F.col("hub.comp"))
            .filter(reachable)
            .select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
            .groupBy("a", "b")
            .agg(F.count("*").alias("shared"))
        )
        one = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sizes").alias("sa"))
        two = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sizes").alias("sb"))
        most = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
        pairs = pairs.join(one, "a").join(two, "b").filter(reaches(most, F.col("na"), F.col("nb"), num, den)).select("a", "b")
        pairs = scratch.keep(pairs, "pairs")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if full is not None:
            wanted = wanted.join(full, "node", "left_anti")
        reps = nodes.select("node", F.col("first.doc_id").alias("rep_id"), F.col("first.th").alias("rep_th"))
        wanted = scratch.keep(wanted.join(reps, "node"), "wanted")
        more = scratch.keep(full_rows(docs, wanted, k), "rows")
        full = more if full is None else full.union(more)
        one = full.select(F.col("node").alias("a"), F.col("grams").alias("x"))
        two = full.select(F.col("node").alias("b"), F.col("grams").alias("y"))
        overlap = F.size(F.array_intersect("x", "y"))
        verified = pairs.join(one, "a").join(two, "b").filter(reaches(overlap, F.size("x"), F.size("y"), num, den)).select("a", "b").distinct()
        found = scratch.keep(verified, "links")
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            if labels is not None:
                scratch.drop(labels)
            labels = components(links, scratch)
        left = now.drop("comp").join(hubs.select("g", F.col("hub.node").alias("node")), ["g", "node"], "left_anti")
        entries = scratch.keep(left, "entries")
        scratch.drop(now, hubs, pairs, wanted, open_columns)
        turn += 1
    named = nodes.select("node", "first")
    if labels is not None:
        named = named.join(labels.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = named.groupBy("comp").agg(F.min("first").alias("first"))
        named = named.drop("first").join(least, "comp").select("node", "first")
    return rows.join(named, "node", "left").select(
        "doc_id",
        "th",
        "n",
        F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("first_id"),
        F.when(F.col("n") > 0, F.col("first.th")).otherwise(F.col("th")).alias("first_th"),
    )


def jaccard_join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id per document row.

    A document's set: its distinct runs of ``k`` words (A-Z in lower case); with fewer words, the whole
    sequence as one; without words or with a null text it is empty and linked with nothing. Two
    documents link when den * intersection >= num * union. Component: the least doc_id that links
    reach; rows of null doc_id take part, and a component of nulls only is null. Repeated rows each get
    a row; an empty table gives no rows; other columns are ignored.
    """
    return join_components(docs, k, num, den).select("doc_id", F.col("n").alias("n_shingles"), F.col("first_id").alias("component_id"))


def first_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without those that have an earlier one in their component; same columns.

    Of rows that repeat id and text one stays; documents without words all stay.
    """
    groups = join_components(docs, k, num, den)
    key = lambda doc_id, th: [F.coalesce(doc_id, F.lit(0)).alias("k1"), doc_id.isNull().alias("k2"), th.alias("k3")]
    firsts = groups.filter(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th")))
    firsts = firsts.select(*key(F.col("doc_id"), F.col("th"))).distinct()
    whole = docs.select(F.struct("*").alias("row")).select("row", *key(F.col("row.doc_id"), F.xxhash64(text_of("row.text"))))
    kept = whole.join(firsts, ["k1", "k2", "k3"]).dropDuplicates(["k1", "k2", "k3"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

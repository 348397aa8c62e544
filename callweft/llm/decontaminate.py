"""Benchmark decontamination by size-partitioned MinHash containment search with exact verification.

Test items are partitioned by the size of their shingle set, and each item keeps the ``SKETCH`` least
values of its shingles under one hash: a MinHash sketch of the contained side. A document is searched
in the partitions whose items it is large enough to contain. It is a candidate for an item where it
holds a shingle of the item's sketch: an item of which a share c is contained is missed with a
probability of at most (1 - c)^SKETCH, 7e-12 at c = 0.8, however long the document is. Candidates are
verified by the exact number of item shingles that the document holds.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweft.llm.common import text_of
from callweft.llm.wordhash import WordHashes, mix, windows

K = 5
#: Least share of an item's shingles, as num / den.
NUM, DEN = 80, 100
SKETCH = 16
#: Bits of the table that says whether a shingle may belong to a sketch.
TABLE_BITS = 22
#: Item words that are broadcast at a time (under 100 MB in a task); larger benchmarks take more passes.
BLOCK_WORDS = 4_000_000

WORD = re.compile(r"\w+")


def shingle_set(hashes: WordHashes, text: str | None, k: int) -> np.ndarray:
    return np.unique(windows(hashes.of(WORD.findall(text.lower())), k)) if text else np.empty(0, np.uint64)


class Items:
    """One block of test items as shingle sets, sketches and size partitions."""

    def __init__(self, rows: list[tuple[int | None, str | None]], k: int, num: int, den: int):
        hashes = WordHashes()
        self.k, self.num, self.den = k, num, den
        sets = [(item_id, grams) for item_id, text in rows if len(grams := shingle_set(hashes, text, k))]
        self.ids = [item_id for item_id, _ in sets]
        self.sets = [grams for _, grams in sets]
        self.least = np.array([-(-num * len(g) // den) for g in self.sets], np.int64)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        # partitions by size: (least shared shingles in the partition, sketch shingle -> items)
        by_size: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, grams in enumerate(self.sets):
            sketch = grams[np.argsort(mix(grams), kind="stable")[:SKETCH]]
            self.table[(sketch >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
            for gram in sketch.tolist():
                by_size[len(grams).bit_length()][gram].append(i)
        self.partitions = [
            (min(int(self.least[i]) for items in found.values() for i in items), dict(found)) for _, found in sorted(by_size.items())
        ]

    def within(self, grams: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) of every item that the sorted set of a document contains."""
        if not len(grams):
            return []
        hits = grams[self.table[(grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]].tolist()
        if not hits:
            return []
        candidates: Counter = Counter()
        for least, found in self.partitions:
            if least > len(grams):
                break
            for gram in hits:
                candidates.update(found.get(gram, ()))
        out = []
        for i in sorted(candidates):
            at = np.searchsorted(grams, self.sets[i])
            shared = int((grams[np.minimum(at, len(grams) - 1)] == self.sets[i]).sum())
            if shared >= self.least[i]:
                out.append((i, shared))
        return out


def item_blocks(items: DataFrame, k: int, num: int, den: int) -> Iterator[Items]:
    """The items in blocks whose size is bounded, whatever the benchmark's size."""
    words = items.agg(F.sum(F.size(F.split(text_of(), r"\s+")))).first()[0] or 0
    n = max(1, -(-words // BLOCK_WORDS))
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).select("item_id", "text").collect()
        yield Items([(r[0], r[1]) for r in rows], k, num, den)


def contained_items(docs: DataFrame, items: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, item_id, n_item, n_shared of every document row and every test item that it contains.

    Words are runs of word characters in lower case; shingles are ``k`` words, a text with fewer words is
    one shingle of all its words (so such an item is found only in a document of the same words). An item
    is contained where den * shared >= num * n_item. Null texts and texts without words contain nothing
    and are contained nowhere; null ids stay null; repeated rows each give rows; empty tables give none;
    other columns are ignored.
    """
    out = None
    for block in item_blocks(items, k, num, den):
        found = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(_search(docs, block), "doc_id string, item_id string, n_item long, n_shared long")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("item_id", F.col("item_id").cast("long"))


def _search(docs: DataFrame, block: Items) -> Callable:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, items = WordHashes(), shared.value
        for batch in batches:
            rows = [
                (doc_id, None if items.ids[i] is None else str(items.ids[i]), len(items.sets[i]), n)
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True)
                for i, n in items.within(shingle_set(hashes, text, items.k))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_item", "n_shared"])

    return search


def decontaminate(docs: DataFrame, items: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """The document rows that contain no test item, unchanged. Rules are those of ``contained_items``."""
    for block in item_blocks(items, k, num, den):
        docs = docs.filter(_clean(docs, block)("text"))
    return docs


def _clean(docs: DataFrame, block: Items) -> Callable:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes, items = WordHashes(), shared.value
        for texts in batches:
            yield pd.Series([not items.within(shingle_set(hashes, t, items.k)) for t in texts], dtype=bool)

    return clean

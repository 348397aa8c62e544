"""Vector bin packing of examples under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweft.llm.tokens import VOCABULARY, encode

MAX_TOKENS = 1024
MAX_SEGMENTS = 256
MAX_LOSS = 1024
#: Examples that wait for a place at a time; the bound of a task's memory besides its batch.
POOL = 512


class Pool:
    """Examples that wait, as demand vectors (tokens, segments, loss-bearing tokens) with payloads.

    A bin is filled by the dot-product heuristic: of the examples that fit in every dimension the
    one with the largest scalar product of its demand with the room left, both as shares of the
    limits, is placed next; ties go to the earlier one.
    """

    def __init__(self, limits: tuple[int, int, int], size: int):
        self.limits = np.array(limits, dtype=np.int64)
        self.demand = np.zeros((size, 3), dtype=np.int64)
        self.items: list = [None] * size
        self.n = 0

    def add(self, demand: tuple[int, int, int], item) -> None:
        self.demand[self.n] = demand
        self.items[self.n] = item
        self.n += 1

    def full(self) -> bool:
        return self.n == len(self.items)

    def take(self, i: int):
        """Remove example ``i``; later ones keep their order."""
        item = self.items[i]
        self.demand[i : self.n - 1] = self.demand[i + 1 : self.n]
        del self.items[i]
        self.items.append(None)
        self.n -= 1
        return item

    def best(self, room: np.ndarray) -> int:
        """The example to place next in a bin with this room, or -1."""
        demand = self.demand[: self.n]
        fits = (demand <= room).all(axis=1)
        if not fits.any():
            return -1
        score = (demand / self.limits) @ (room / self.limits)
        score[~fits] = -1.0
        return int(score.argmax())


def fill(pool: Pool, split=None) -> list:
    """Fill one bin from the pool and return its items in order.

    ``split(item, room)``: where it is given and nothing more fits whole, cuts the head off the
    largest waiting example to fill the bin, and returns (head, demand, tail, demand) or None.
    """
    room, out = pool.limits.copy(), []
    while pool.n:
        i = pool.best(room)
        if i < 0:
            break
        room = room - pool.demand[i]
        out.append(pool.take(i))
    if split and pool.n and room.min() > 0:
        i = int(pool.demand[: pool.n, 0].argmax())
        cut = split(pool.items[i], room)
        if cut:
            head, tail, demand = cut
            pool.items[i], pool.demand[i] = tail, demand
            out.append(head)
    return out


def in_powers(segments: list[tuple[int, int, int]], total: int) -> Iterator[list[tuple[int, int, int]]]:
    """Cut a bin's (item, start, length) into groups whose lengths are the powers of two in total."""
    rest = [list(s) for s in segments]
    for bit in range(total.bit_length() - 1, -1, -1):
        need, group = total & (1 << bit), []
        while need:
            item, start, length = rest[0]
            n = min(need, length)
            group.append((item, start, n))
            need -= n
            if n == length:
                rest.pop(0)
            else:
                rest[0] = [item, start + n, length - n]
        if group:
            yield group


def pack_documents(docs: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, vocabulary: str = VOCABULARY, end_id: int = 0) -> DataFrame:
    """Pack whole documents, encoded and closed with ``end_id``, into sequences of ``max_tokens``.

    Documents longer than a sequence give full sequences; what is left, and shorter documents, are
    the examples of the vector bin packing (every id bears loss). Nothing fits any more: the bin is
    filled with the head of the largest waiting example. A bin that still isn't full (the end of a
    task, or the segment limit) is cut into sequences whose lengths are powers of two, which need
    no padding.

    Each task packs its own rows, with a bounded pool and no shuffle; ``sequence_id`` is the
    partition's number times 2^33 plus a count, so a task that runs again gives the same rows.
    Null text is empty (one id), null doc_id stays null, repeated rows are packed each, an empty
    table gives no rows, other columns are ignored.
    """
    limits = (max_tokens, max_segments, max_loss)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, number = Pool(limits, POOL), TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        step = min(max_tokens, max_loss)

        def put(segments) -> None:
            nonlocal number
            offset = 0
            for (doc_id, ids, base, total), start, length in segments:
                rows.append((doc_id, base + start, length, crc32(ids[start : start + length]), total, number, offset))
                offset += length
            number += 1

        def split(item, room):
            doc, start, length = item
            n = int(min(room[0], room[2]))
            return (doc, start, n), (doc, start + n, length - n), (length - n, 1, length - n)

        def close() -> None:
            segments = fill(pool, split)
            total = sum(s[2] for s in segments)
            if total == max_tokens:
                put(segments)
            else:
                for group in in_powers(segments, total):
                    put(group)

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            rows.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                whole = np.array([*encode(text, vocabulary), end_id], dtype="<u4")
                n, start = len(whole), 0
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                doc = (doc_id, whole, 0, n)
                while n - start >= step:
                    if step == max_tokens:
                        put([(doc, start, step)])
                    else:
                        for group in in_powers([(doc, start, step)], step):
                            put(group)
                    start += step
                if n > start:
                    rest = (doc_id, whole[start:].copy(), start, n)  # what waits holds no more than its own ids
                    pool.add((n - start, 1, n - start), (rest, 0, n - start))
                while pool.full():
                    close()
            yield frame()
        while pool.n:
            close()
        yield frame()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(pack, schema)


def pack_examples(examples: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS) -> DataFrame:
    """Pack whole instruction examples (example_id, n_tokens, n_loss) without cutting any.

    Returns example_id, n_tokens, n_loss, sequence_id, offset. An example that is over a limit by
    itself gets a sequence of its own with ``oversize`` true. Null counts are 0.
    """
    limits = (max_tokens, max_segments, max_loss)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, number = Pool(limits, POOL), TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def put(items, oversize=False) -> None:
            nonlocal number
            offset = 0
            for example, n, loss in items:
                rows.append((example, n, loss, number, offset, oversize))
                offset += n
            number += 1

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["example_id", "n_tokens", "n_loss", "sequence_id", "offset", "oversize"])
            out["example_id"] = out["example_id"].astype("Int64")
            rows.clear()
            return out

        for batch in batches:
            for example, n, loss in zip(batch["example_id"], batch["n_tokens"].fillna(0), batch["n_loss"].fillna(0), strict=True):
                item = (None if pd.isna(example) else int(example), int(n), int(loss))
                if n > max_tokens or loss > max_loss:
                    put([item], True)
                else:
                    pool.add((int(n), 1, int(loss)), item)
                while pool.full():
                    put(fill(pool))
            yield frame()
        while pool.n:
            put(fill(pool))
        yield frame()

    schema = "example_id long, n_tokens long, n_loss long, sequence_id long, offset long, oversize boolean"
    return examples.select(F.col("example_id").cast("string"), "n_tokens", "n_loss").mapInPandas(pack, schema)

"""Fill-in-the-middle transformation over units, cut by rank and select on packed bitvectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
#: Packed bytes per entry of the directory, and text bytes that are looked at together.
BLOCK, CHUNK = 64, 1 << 22
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


class Bits:
    """A packed bitvector with the number of ones before each block of it."""

    def __init__(self, packed: np.ndarray):
        self.packed = np.concatenate([packed, np.zeros(BLOCK - len(packed) % BLOCK, np.uint8)])
        ones = np.bitwise_count(self.packed).reshape(-1, BLOCK).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    def _block(self, block: np.ndarray) -> np.ndarray:
        return self.packed[block[:, None] * BLOCK + np.arange(BLOCK)]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        byte, bit = at >> 3, at & 7
        block = byte // BLOCK
        inside = np.where(np.arange(BLOCK) < (byte % BLOCK)[:, None], np.bitwise_count(self._block(block)), 0).sum(1, dtype=np.int64)
        return self.before[block] + inside + np.bitwise_count(self.packed[byte] >> (8 - bit).astype(np.uint8))

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the one that has ``k`` ones before it."""
        block = np.searchsorted(self.before, k, side="right") - 1
        left = k - self.before[block]
        upto = np.cumsum(np.bitwise_count(self._block(block)), 1, dtype=np.int64)
        byte = (upto <= left[:, None]).sum(1)
        left = left - np.where(byte > 0, np.take_along_axis(upto, np.maximum(byte - 1, 0)[:, None], 1)[:, 0], 0)
        bits = np.cumsum(np.unpackbits(self.packed[block * BLOCK + byte][:, None], axis=1), 1)
        return (block * BLOCK + byte) * 8 + (bits <= left[:, None]).sum(1)


def boundaries(data: np.ndarray, starts: np.ndarray) -> tuple[Bits, Bits]:
    """Beginnings of units and of code points in UTF-8 bytes that hold texts from ``starts`` on.

    A unit is a run of ASCII letters or one other code point. Bytes are looked at ``CHUNK`` at a time, so that
    only packed bits are ever held for a whole batch.
    """
    units, points = [], []
    starts = np.sort(starts)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        letter = ((part | 32) >= 97) & ((part | 32) <= 122)
        after = np.empty_like(letter)
        after[1:] = letter[:-1]
        after[0] = at > 0 and 97 <= data[at - 1] | 32 <= 122
        point = (part & 0xC0) != 0x80
        unit = point & ~(letter & after)
        unit[starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + len(part))] - at] = True
        units.append(np.packbits(unit))
        points.append(np.packbits(point))
    none = [np.zeros(0, np.uint8)]
    return Bits(np.concatenate(units or none)), Bits(np.concatenate(points or none))


def transform_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (doc_id, text, h1, h2, h3, h4) as rows of ``SCHEMA``."""
    text = batch.column("text").cast(pa.large_binary())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = text.buffers()[2]
    raw = memoryview(raw)[ends[0] : ends[-1]] if raw is not None else memoryview(b"")
    data, lo, hi = np.frombuffer(raw, np.uint8), ends[:-1] - ends[0], ends[1:] - ends[0]
    units, points = boundaries(data, lo[hi > lo])
    first = units.rank(lo)
    n = units.rank(hi) - first
    h1, h2, h3, h4 = (batch.column(c).to_numpy() for c in ("h1", "h2", "h3", "h4"))
    a, b = h1 % (n + 1), h2 % (n + 1)
    cuts = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        cut, inside = hi.copy(), k < n
        cut[inside] = units.select((first + k)[inside])
        cuts.append(cut)
    one, two = cuts
    spans = [points.rank(x) for x in (lo, one, two)]
    form, output = [], []
    for i in range(len(lo)):
        p, m, s = bytes(raw[lo[i] : one[i]]), bytes(raw[one[i] : two[i]]), bytes(raw[two[i] : hi[i]])
        whole = p + m + s
        if not whole or h3[i] % 100 >= PLAIN_FROM or any(mark in whole for mark in (PREFIX, SUFFIX, MIDDLE)):
            form.append("plain")
            output.append(whole)
        elif h4[i] % 100 < SPM_BELOW:
            form.append("spm")
            output.append(b"".join((SUFFIX, s, PREFIX, p, MIDDLE, m)))
        else:
            form.append("psm")
            output.append(b"".join((PREFIX, p, SUFFIX, s, MIDDLE, m)))
    plain = np.array([f == "plain" for f in form], bool)
    chars = [pa.array(spans[k + 1] - spans[k], pa.int64(), mask=plain) for k in (0, 1)]
    columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), *chars, pa.array(output, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_middle(docs: DataFrame, seed: str = "1") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per row: texts cut into prefix, middle and suffix.

    Units are counted by total popcount, and the two cuts are found by ``select`` on the number of units before them,
    which the digest of ``seed:doc_id`` draws. A text that holds a sentinel, an empty one and a tenth of the others stay
    plain. Null text is empty, a null doc_id counts as the empty string in the digest, repeated rows are transformed
    each (alike), an empty table gives no rows, other columns are ignored; very long texts only take memory for
    themselves and a quarter more.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest.alias("digest")).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *drawn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield transform_batch(batch)

    return rows.mapInArrow(run, SCHEMA).withColumn("output", F.col("output").cast("string"))


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from: the parts between sentinels, in their first order."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def fill_middle_digests(docs: DataFrame) -> DataFrame:
    """``fill_middle`` with digests of its outputs and of the texts that are rebuilt from them."""
    return fill_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256")
    )

"""Duplicate passages by a sparse suffix array.

Only suffixes that start at minimisers are retained: of every ``WINDOW`` consecutive runs of ``K`` words
the one with the least hash. Any passage of ``LEAST`` words that occurs twice starts a retained suffix at
the same place of both occurrences. The retained suffixes that share their first ``K`` words with another
are sorted by their words, neighbours are compared, and each match is extended right and left word by word.
Neighbours are all partners only where few suffixes share their first ``K`` words. In a larger group with a
suffix no neighbour of which shares all its context, every window of ``LEAST`` words around the group's
suffixes is compared by its hash too, inside the task. Of a group that isn't whole in one task each task hands
on one place of every different window, and those that a task holds once are looked for in the others. So no
repeat is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweft.llm.common import Scratch, text_of
from callweft.llm.wordhash import ODD, WordHashes, mix, windows

LEAST = 50
K = 8
#: Sorted neighbours on each side that a suffix is compared with.
NEIGHBOURS = 2
#: Rows of a frame that a task hands over at a time.
FRAME = 4096
#: Suffixes of one group that a task holds at a time.
MOST = 20_000
CONTEXT = ["doc_id", "th", "pos", "key", "n", "right", "left"]
CONTEXT_TYPES = "th long, pos int, key long, n long, right binary, left binary"


def slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` consecutive values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the values that are the least of some ``window`` consecutive ones."""
    if not len(grams):
        return np.empty(0, np.int64)
    least = slide(grams, min(window, len(grams)), np.minimum)
    edge = np.zeros(min(window, len(grams)) - 1, np.uint64)
    return np.flatnonzero(slide(np.concatenate((edge, least, edge)), len(edge) + 1, np.maximum) == grams)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def suffixes(docs: DataFrame, least: int, k: int) -> DataFrame:
    """doc_id, th, pos (word number), key (hash of the first ``k`` words) of the retained suffixes."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            pos, key, sizes = [], [], []
            for text in batch["text"]:
                words = words_of(text)
                if len(words) < least:
                    sizes.append(0)
                    continue
                grams = windows(hashes.of(words), k)
                at = minimisers(grams, least - k + 1)
                sizes.append(len(at))
                pos.append(at)
                key.append(grams[at].view(np.int64))
            if pos:
                ids, th = (np.repeat(batch[c].to_numpy(), sizes) for c in ("doc_id", "th"))
                yield pd.DataFrame({"doc_id": ids, "th": th, "pos": np.concatenate(pos).astype(np.int32), "key": np.concatenate(key)})

    keyed = docs.select(F.col("doc_id").cast("string"), F.xxhash64(text_of()).alias("th"), "text")
    out = keyed.mapInPandas(rows, "doc_id string, th long, pos int, key long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def with_context(docs: DataFrame, kept: DataFrame, least: int, k: int) -> DataFrame:
    """The kept suffixes with the size of their group, their first ``least`` words and the ``least`` words before, nearest first.

    Words are 32-bit hashes in binary strings, so that suffixes sort by their words.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, out = WordHashes(), []
        frame = lambda: pd.DataFrame(out, columns=CONTEXT)
        for batch in batches:
            for doc_id, th, text, places, keys, sizes in zip(*(batch[c] for c in ("doc_id", "th", "text", "places", "keys", "sizes")), strict=True):
                words = (hashes.of(words_of(text)) >> np.uint64(32)).astype(">u4")
                for at, key, n in zip(places, keys, sizes, strict=True):
                    out.append((doc_id, th, int(at), int(key), int(n), words[at : at + least].tobytes(), words[max(0, at - least) : at][::-1].tobytes()))
                    if len(out) == FRAME:
                        yield frame()
                        out.clear()
        yield frame()

    spots = kept.groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "key", "n")).alias("spots"))
    spots = spots.select(F.col("doc_id").alias("id"), F.col("th").alias("text_hash"), F.col("spots.pos").alias("places"), F.col("spots.key").alias("keys"), F.col("spots.n").alias("sizes"))
    texts = docs.select("doc_id", F.xxhash64(text_of()).alias("th"), "text")
    joined = texts.join(spots, texts["doc_id"].eqNullSafe(spots["id"]) & (texts["th"] == spots["text_hash"]))
    out = joined.select(F.col("doc_id").cast("string"), "th", "text", "places", "keys", "sizes").mapInPandas(rows, f"doc_id string, {CONTEXT_TYPES}")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def padded(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes as a table of ``width`` columns, and how many of each row are words."""
    table = np.frombuffer(b"".join(v.ljust(4 * width, b"\0") for v in values), ">u4").reshape(len(values), width)
    return table, np.array([len(v) // 4 for v in values])


def common(table: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows a and b."""
    differ = table[a] != table[b]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), table.shape[1])
    return np.minimum(first, np.minimum(sizes[a], sizes[b]))


def window_hashes(right, right_size, left, left_size, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``least`` words that hold the first ``k`` words of each suffix, by their start, and which exist.

    Column j is the window that starts ``least - k - j`` words before the suffix.
    """
    side, power = least - k, np.uint64(pow(int(ODD), least, 1 << 64))
    words = mix(np.concatenate((left[:, :side][:, ::-1], right), axis=1).astype(np.uint64) + np.uint64(1)).T.copy()
    sums = np.zeros((len(words) + 1, words.shape[1]), np.uint64)
    for i, column in enumerate(words):
        sums[i + 1] = sums[i] * ODD + column
    h = mix(sums[least:] - sums[:-least] * power).T
    at = np.arange(h.shape[1])
    there = (at >= side - np.minimum(left_size, side)[:, None]) & (at + least <= side + right_size[:, None])
    return h, there


def shared_windows(h: np.ndarray, there: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows by their hash and place in the suffix's surroundings: (row, column, other document, hash, first, single).

    All windows, those of one kind together; ``first`` marks one of each kind, ``single`` kinds of one window only.
    """
    row, at = np.nonzero(there)
    values = mix(h[row, at] + at.astype(np.uint64))
    order = np.argsort(values)
    values, row, at = values[order], row[order], at[order]
    first = np.concatenate(([True], values[1:] != values[:-1])) if len(values) else np.zeros(0, bool)
    kind, starts = np.cumsum(first) - 1, np.flatnonzero(first)
    if not len(starts):
        return row, at, doc[row], values.view(np.int64), first, first
    own = doc[row]
    least_doc = np.minimum.reduceat(own, starts)[kind]
    next_doc = np.minimum.reduceat(np.where(own == least_doc, NO_DOC, own), starts)[kind]
    other = np.where(own != least_doc, least_doc, np.where(next_doc == NO_DOC, own, next_doc))
    return row, at, other, values.view(np.int64), first, np.bincount(kind)[kind] == 1


#: Stands for a null doc_id among numbers, after all others, and for none at all.
NULL_DOC, NO_DOC = np.int64(2**63 - 2), np.int64(2**63 - 1)
SPAN = ["doc_id", "th", "start", "end", "other"]


def compare(least: int, k: int, edges: bool, most: int = MOST):
    """Compare sorted suffixes with their neighbours, and the windows of larger groups that a task holds whole.

    Rows that come out: spans (doc_id, th, start, end, other); with ``edges`` the rows at a partition's ends with
    their context, and of larger groups that aren't whole here one place (doc_id, th, start) of every window by its
    hash (h, single). Rows that repeat the one before are left out.
    """
    columns = [*SPAN, *CONTEXT[2:], "h", "single"]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, int]]:
        """Frames of whole groups, but for groups of more than ``most`` rows; the second value tells how many rows were compared before."""
        held, old = pd.DataFrame(columns=CONTEXT), 0
        for batch in batches:
            held = pd.concat([held, batch[CONTEXT]], ignore_index=True) if len(held) else batch[CONTEXT].reset_index(drop=True)
            key = held["key"].to_numpy()
            cut = int((key != key[-1]).sum()) if len(key) else 0  # rows of a key stand together
            if cut > old:
                yield held[:cut], old
                held, old = held[cut:].reset_index(drop=True), 0
            if len(held) > most:
                yield held, old
                held, old = held.tail(NEIGHBOURS).reset_index(drop=True), NEIGHBOURS
        if len(held) > old:
            yield held, old

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, last = 0, None
        for frame, old in pieces(batches):
            if edges and head < NEIGHBOURS:
                first = frame[old:].head(NEIGHBOURS - head)
                head += len(first)
                yield first
            last = frame.tail(NEIGHBOURS) if last is None or len(frame) >= NEIGHBOURS else pd.concat([last, frame]).tail(NEIGHBOURS)
            yield from spans(frame, old)
        if edges and last is not None:
            yield last

    def spans(frame: pd.DataFrame, old: int) -> Iterator[pd.DataFrame]:
        _, group, size = np.unique(frame["key"].to_numpy(), return_inverse=True, return_counts=True)
        n = frame["n"].to_numpy()
        whole = size[group] >= n
        doc = pd.to_numeric(frame["doc_id"]).astype("Int64").fillna(NULL_DOC).to_numpy(np.int64)
        th, pos, key = (frame[c].to_numpy() for c in ("th", "pos", "key"))
        fresh = np.concatenate(([True], (th[1:] != th[:-1]) | (pos[1:] != pos[:-1]) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
        doc, th, pos, key, n, whole = doc[fresh], th[fresh], pos[fresh], key[fresh], n[fresh], whole[fresh]
        right, right_size = padded(frame["right"][fresh].tolist(), least)
        left, left_size = padded(frame["left"][fresh].tolist(), least)
        full = np.zeros(len(doc), bool)
        full[:old] = True  # told about before
        found = []
        for step in range(1, NEIGHBOURS + 1):
            a = np.flatnonzero(key[step:] == key[:-step])
            b = a + step
            r, back = common(right, right_size, a, b), common(left, left_size, a, b)
            for x in (a, b):
                full[x[(r == right_size[x]) & (back >= np.minimum(least - k, left_size[x]))]] = True
            ok = r + back >= least
            a, b, r, back = a[ok], b[ok], r[ok], back[ok]
            for x, y in ((a, b), (b, a)):
                found.append((doc[x], th[x], pos[x] - back, pos[x] + r, doc[y]))
        ids = lambda x: pd.Series(x.astype(str), dtype=object).where(x != NULL_DOC, None)
        large = n > NEIGHBOURS + 1
        at = np.flatnonzero(large & (np.isin(key, np.unique(key[~full & large])) | (edges & ~whole)))
        if len(at):
            h, there = window_hashes(right[at], right_size[at], left[at], left_size[at], least, k)
            row, column, other, value, first, single = shared_windows(h, there, doc[at])
            begin = pos[at][row] - (least - k) + column
            if edges:
                out = first & ~whole[at][row]
                x = at[row[out]]
                yield pd.DataFrame({"doc_id": ids(doc[x]), "th": th[x], "start": begin[out].astype(np.int32), "h": value[out], "single": single[out]})
            order = np.flatnonzero(~single)
            order = order[np.lexsort((column[order], row[order]))]
            row, column, other, begin = row[order], column[order], other[order], begin[order]
            if len(row):  # neighbouring windows of a suffix make one span
                first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (column[1:] != column[:-1] + 1))))
                until = np.concatenate((first[1:], [len(row)])) - 1
                x = at[row[first]]
                found.append((doc[x], th[x], begin[first], begin[until] + least, np.minimum.reduceat(other, first)))
        doc, th, start, end, other = (np.concatenate(c) for c in zip(*found, strict=True))
        yield pd.DataFrame({"doc_id": ids(doc), "th": th, "start": start.astype(np.int32), "end": end.astype(np.int32), "other": ids(other)}).drop_duplicates()

    def out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in rows(batches):
            yield frame.assign(**{c: None for c in columns if c not in frame})[columns]

    return out


COMPARED = "doc_id string, th long, start int, end int, other string, pos int, key long, n long, right binary, left binary, h long, single boolean"


def elsewhere(scratch: Scratch, windows: DataFrame, least: int) -> DataFrame:
    """doc_id, th, start, end, other: the windows that their task holds once, and another task too; ``other`` is the least document of another place."""
    place = F.xxhash64("doc_id", "th", "start")
    counted = windows.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min(place).alias("a"), F.max(place).alias("b"))
    repeated = scratch.keep(counted.filter("a <> b").select("h", "first", "last"), "repeated")  # read back, as the shared keys are
    again = windows.filter("single").join(repeated, "h")
    other = F.when(F.col("doc_id") == F.col("first"), F.col("last")).otherwise(F.col("first"))
    return again.select("doc_id", "th", "start", (F.col("start") + least).alias("end"), other.alias("other"))


def repeated_passages(docs: DataFrame, least: int = LEAST, k: int = K, most: int = MOST) -> DataFrame:
    """doc_id, th, start, end, other_doc_id: passages [start, end) in words that occur elsewhere too; ``most``: see ``MOST``.

    Overlapping matches of a document make one passage; ``other_doc_id`` is the least document that a
    partner it was compared with belongs to (the document itself where a passage repeats inside it only).
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    every = scratch.keep(suffixes(docs, least, k), "suffixes")
    place = F.xxhash64("doc_id", "th", "pos")
    shared = every.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b")
    shared = scratch.keep(shared.select("key", "n"), "shared")  # read back, so that the join below can split a hot key
    found = scratch.keep(with_context(docs, every.join(shared, "key"), least, k), "context")
    scratch.drop(every)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges are cut by a short beginning of the words after the key, which goes to the driver in samples; a group
    # that is larger than a partition is cut further by the hash of all its words, then by the words before and the document.
    ranges = ["key", F.substring("right", 4 * k + 1, 16), F.xxhash64("right"), F.substring("left", 1, 16), "doc_id", "pos"]
    order = ["key", "right", "left", "doc_id", "th", "pos"]
    ranged = found.repartitionByRange(parts, *ranges).sortWithinPartitions(*order)
    text_ids = lambda df: df.withColumn("doc_id", F.col("doc_id").cast("string"))
    compared = scratch.keep(text_ids(ranged).mapInPandas(compare(least, k, True, most), COMPARED), "compared")
    # Neighbours in different partitions: the few rows at every edge, sorted once more among those of their key.
    # A row that is both among the first and the last of a small partition comes out twice.
    seams = compared.filter("pos is not null").withColumn("doc_id", F.col("doc_id").cast("long")).dropDuplicates(["doc_id", "th", "pos"])
    across = text_ids(seams.repartition(parts, "key").sortWithinPartitions(*order)).mapInPandas(compare(least, k, False, most), COMPARED)
    spans = compared.filter("end is not null").unionByName(across)
    spans = spans.select(F.col("doc_id").cast("long").alias("doc_id"), "th", "start", "end", F.col("other").cast("long").alias("other"))
    windows = compared.filter("h is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "th", "start", "h", "single")
    spans = spans.unionByName(elsewhere(scratch, windows, least))
    best = spans.groupBy("doc_id", "th", "start", "end").agg(F.min("other").alias("other"))
    grouped = best.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end", "other"))).alias("spans"))
    merged = F.expr(
        """aggregate(spans, cast(array() as array<struct<a:int,b:int,o:bigint>>), (acc, r) ->
             if(size(acc) > 0 and element_at(acc, -1).b >= r.start,
                concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a,
                       'b', greatest(element_at(acc, -1).b, r.end), 'o', least(element_at(acc, -1).o, r.other)))),
                concat(acc, array(named_struct('a', r.start, 'b', r.end, 'o', r.other)))))"""
    )
    return grouped.select("doc_id", "th", F.explode(merged).alias("x")).select(
        "doc_id", "th", F.col("x.a").alias("start"), F.col("x.b").alias("end"), F.col("x.o").alias("other_doc_id")
    )


def suffix_dedup(docs: DataFrame, least: int = LEAST, k: int = K) -> DataFrame:
    """doc_id, start, end, other_doc_id of every passage of ``least`` words or more that occurs twice or more.

    Places are word numbers (words are runs without ASCII white space), end exclusive. Null text and
    shorter texts have no passages, null doc_id stays null, rows that repeat id and text count as one
    document, an empty table gives no rows, other columns are ignored.
    """
    return repeated_passages(docs, least, k).select("doc_id", "start", "end", "other_doc_id")

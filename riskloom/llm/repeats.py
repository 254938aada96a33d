"""Removal of repeated passages: windows of words, by level-wise doubling.

A window of 20 words can only occur twice if every shorter window in it does. So a level
looks for repeated windows of one length, and only windows of twice that length whose
halves' worth of shorter windows survived go to the next level, until the wanted length is
reached or nothing survives. Below the wanted length it is enough to look up one window of
each run of twice the length: the one with the smallest hash, which equal runs choose alike
(about two of twelve windows at ten words). At the wanted length every candidate counts.

Texts are dealt to buckets of bounded size by one exchange, which all levels reuse. A bucket
sends its window hashes to cells of the hash space, one entry per distinct hash, so a passage
that a third of all documents share is one entry per bucket; its other places need no
lookup. A cell answers each bucket with the places it wants to know about, in short form, so
what travels is in proportion to the windows, whatever their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from riskloom.llm.common import Spans, buffer_of, mix, only, words

#: Words of a window, and of the windows of the first level (fixed values of the registered query).
LENGTH, FIRST = 20, 10
#: Bytes of text of a bucket, and of the text whose windows one cell of the hash space holds.
BUCKET_BYTES, CELL_BYTES = 4 << 20, 16 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

ENTRIES = StructType([StructField("cell", IntegerType()), StructField("bucket", IntegerType()), *[
    StructField(c, BinaryType()) for c in ("ids", "counts", "places", "hashes")]])
ANSWERS = StructType([StructField("bucket", IntegerType()), StructField("places", BinaryType())])
CLEANED = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType()),
           StructField("removed", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))]


def window_hashes(found: Spans, size: int) -> np.ndarray:
    """For every word the hash of the ``size`` words that begin there; the largest number where the text ends before.

    Differences of running totals, so the cost does not depend on ``size``.
    """
    n = len(found.hashes)
    out = np.full(n, _NONE)
    if n < size:
        return out
    forth, back = np.full(n, _STEP), np.full(n, _BACK)
    forth[0] = back[0] = 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(found.hashes * np.multiply.accumulate(forth), dtype=np.uint64, out=total[1:])
    inside = found.docs[:n - size + 1] == found.docs[size - 1:]
    hashed = mix((total[size:] - total[:-size]) * np.multiply.accumulate(back)[:n - size + 1])
    out[:n - size + 1] = np.where(inside, np.minimum(hashed, _NONE - np.uint64(1)), _NONE)
    return out


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each value and the ``size - 1`` after it; what lies beyond the end counts as the largest number."""
    out, have = values.copy(), 1
    while have < size:
        step = min(have, size - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def sliding_max_before(values: np.ndarray, size: int) -> np.ndarray:
    """The greatest of each value and the ``size - 1`` before it."""
    out, have = values.copy(), 1
    while have < size:
        step = min(have, size - have)
        out[step:] = np.maximum(out[step:], out[:-step].copy())
        have += step
    return out


def looked_up(found: Spans, size: int, length: int, survived: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window of ``size`` words at each word, and which of them this level looks up.

    ``survived`` marks the words where a looked-up window of half the size was found
    repeated; without it, this is the first level.
    """
    own = window_hashes(found, size)
    wanted = own != _NONE
    if survived is not None:
        half = window_hashes(found, size // 2)
        least = sliding_min(half, size // 2 + 1)
        wanted &= sliding_min(np.where(survived, half, _NONE), size // 2 + 1) == least
    if size < length:
        # The chosen window of every run of twice the size that lies in one text.
        n = len(own)
        least = sliding_min(own, size + 1)
        whole = np.zeros(n, bool)
        if n >= 2 * size:
            whole[:n - 2 * size + 1] = found.docs[:n - 2 * size + 1] == found.docs[2 * size - 1:]
        least = np.where(whole, least, np.uint64(0))
        wanted &= sliding_max_before(least, size + 1) == own
    return own, wanted


def encode(places: np.ndarray) -> bytes:
    """Ascending ``places`` in short: a run of c > 1 places from p on is ``p, -c``."""
    at = np.flatnonzero(np.r_[True, places[1:] != places[:-1] + 1]) if len(places) else np.zeros(0, np.int64)
    runs = np.diff(np.r_[at, len(places)])
    ends = np.cumsum(np.where(runs > 1, 2, 1))
    out = np.empty(ends[-1] if len(ends) else 0, np.int32)
    out[ends - np.where(runs > 1, 2, 1)] = places[at]
    out[ends[runs > 1] - 1] = -runs[runs > 1]
    return out.tobytes()


def decode(data: bytes) -> np.ndarray:
    """The places of ``encode``."""
    numbers = np.frombuffer(data, np.int32).astype(np.int64)
    at = np.flatnonzero(numbers >= 0)
    follows = np.r_[numbers, 0][at + 1] < 0
    runs = np.ones(len(at), np.int64)
    runs[follows] = -numbers[at[follows] + 1]
    return np.repeat(numbers[at] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())


def _groups(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal ``keys`` begins."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def _later(hashes: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Entries whose hash also stands earlier: at a smaller id, or a smaller place of the same id."""
    order = np.lexsort((places, ids, hashes))
    h, i, p = hashes[order], ids[order], places[order]
    starts = _groups(h)
    each = np.repeat(starts, np.diff(np.r_[starts, len(h)]))
    out = np.empty(len(h), bool)
    out[order] = (i != i[each]) | (p != p[each])
    return out


def _repeated(hashes: np.ndarray) -> np.ndarray:
    """Entries whose hash occurs more than once."""
    order = np.argsort(hashes, kind="stable")
    starts = _groups(hashes[order])
    runs = np.diff(np.r_[starts, len(hashes)])
    out = np.empty(len(hashes), bool)
    out[order] = np.repeat(runs > 1, runs)
    return out


def _texts(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, Spans]:
    """The rows of a bucket in their order by id and text, the bytes and bounds of the texts, and their words."""
    rows = rows.take(pa.array(np.lexsort((rows.column("print").to_numpy(), rows.column("id").to_numpy()))))
    texts = rows.column("text").cast(pa.large_string()).combine_chunks()
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    buffer, offsets = buffer_of(texts)
    return rows, buffer, offsets, words(buffer, offsets, lower=False)


def _told(answers: pa.Table, n: int) -> np.ndarray:
    """Which of the ``n`` words of a bucket its answers name."""
    out = np.zeros(n, bool)
    for data in answers.column("places").to_pylist():
        out[decode(data)] = True
    return out


def _entries(rows: pa.Table, answers: pa.Table | None, size: int, length: int, cells: int) -> pa.Table:
    """What a bucket sends to the cells at one level; the places that it settles itself go in a cell below zero."""
    rows, _, _, found = _texts(rows)
    own, wanted = looked_up(found, size, length, None if answers is None else _told(answers, len(found.docs)))
    at = np.flatnonzero(wanted)
    ids, hashes, docs = rows.column("id").to_numpy(), own[at], found.docs[at]
    if size == length:
        place = at - np.searchsorted(found.docs, docs)
        settled = _later(hashes, ids[docs], place)
        sent = ~settled
    else:
        settled = _repeated(hashes)
        sent = np.zeros(len(at), bool)
        sent[np.unique(hashes, return_index=True)[1]] = True
    bucket = rows.column("bucket")[0].as_py() if rows.num_rows else 0
    none = np.zeros(0, np.int64)
    out = [(-1 - bucket % cells, none, none, encode(at[settled]), none)] if settled.any() else []
    at, hashes, docs = at[sent], hashes[sent], docs[sent]
    cell = ((hashes >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(cell, kind="stable")
    for part in np.split(order, _groups(cell[order])[1:]):
        if not len(part):
            continue
        # Places in the document are needed to see which of two windows is earlier, so each document's first word comes along.
        new = _groups(docs[part])
        first = np.searchsorted(found.docs, docs[part][new])
        out.append((int(cell[part[0]]), np.c_[ids[docs[part][new]], first], np.diff(np.r_[new, len(part)]),
                    at[part].astype(np.int32).tobytes(), hashes[part]))
    return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([bucket] * len(out), pa.int32()), *[
        pa.array([x[i] if isinstance(x[i], bytes) else x[i].tobytes() for x in out], pa.binary()) for i in (1, 2, 3, 4)]],
        names=ENTRIES.names)


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _settle(table: pa.Table, last: bool) -> pa.Table:
    """Answers of a cell: the places of windows that also stand elsewhere, at the last level earlier."""
    if table.column("cell")[0].as_py() < 0:
        return table.select(ANSWERS.names)
    hashes, places = _joined(table, "hashes", np.uint64), _joined(table, "places", np.int32)
    if last:
        texts = _joined(table, "ids", np.int64).reshape(-1, 2)[np.repeat(
            np.arange(sum(len(x) // 16 for x in table.column("ids").to_pylist())), _joined(table, "counts", np.int64))]
        found = _later(hashes, texts[:, 0], places - texts[:, 1])
    else:
        found = _repeated(hashes)
    bounds = np.cumsum([0, *(len(x) // 8 for x in table.column("hashes").to_pylist())])
    own = [np.sort(places[a:b][found[a:b]]) for a, b in zip(bounds, bounds[1:])]
    rows = [i for i, x in enumerate(own) if len(x)]
    return pa.table([table.column("bucket").take(pa.array(rows, pa.int64())), pa.array([encode(own[i]) for i in rows], pa.binary())],
                    names=ANSWERS.names)


def _dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id, id, print, text, bucket`` in one exchange, and the number of cells.

    ``id`` has nulls last, and ``print`` tells rows of one id apart.
    """
    slim = only(docs, "doc_id", "text")
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = slim.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)).alias("id"),
                       F.xxhash64("text").alias("print"), "text")
    buckets = max(1, -(-size // BUCKET_BYTES))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("id", "print"), F.lit(buckets)).cast("int")), max(1, -(-size // CELL_BYTES))


def _later_windows(rows: DataFrame, cells: int, length: int, first: int) -> DataFrame:
    """``bucket, places``: the words of each bucket where a window begins that also stands earlier."""
    def level(size: int, answers: DataFrame | None) -> DataFrame:
        def deal(own: pa.Table) -> pa.Table:
            return _entries(own, None, size, length, cells)

        def deal_survivors(own: pa.Table, told: pa.Table) -> pa.Table:
            return _entries(own if told.num_rows else own.slice(0, 0), told, size, length, cells)

        def settle(entries: pa.Table) -> pa.Table:
            return _settle(entries, size == length)

        texts = rows.groupBy("bucket")
        dealt = texts.applyInArrow(deal, ENTRIES) if answers is None else texts.cogroup(
            answers.groupBy("bucket")).applyInArrow(deal_survivors, ENTRIES)
        return dealt.groupBy("cell").applyInArrow(settle, ANSWERS)

    size, answers = first, level(first, None)
    while size < length:
        size *= 2
        answers = level(size, answers)
    return answers


def remove_repeats(docs: DataFrame, length: int = LENGTH, first: int = FIRST) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, removed`` for every row of ``docs(doc_id, text)``.

    Each word goes that lies in a window of ``length`` words whose sequence also starts
    earlier: in a document of smaller id, or earlier in the same one. Windows are judged on
    the input, so the first occurrence of a passage stays whole. ``kept`` are the words that
    stay, joined by one space, and ``removed`` the spans of removed words. ``length`` must be
    ``first``, the size of the windows of the first level, doubled some times.

    Null and empty texts have no words, and texts below ``length`` words lose none. Null ids
    come after all others and count as one id. Rows of one id are one document: equal places
    of theirs are not earlier than each other, so rows that repeat a whole row lose the same
    words. Other columns are ignored. An empty table gives an empty result.
    """
    rows, cells = _dealt(docs)
    schema = StructType([rows.schema["doc_id"], *CLEANED])

    def clean(own: pa.Table, answers: pa.Table) -> pa.Table:
        own, buffer, offsets, found = _texts(own)
        n = own.num_rows
        bounds = np.searchsorted(found.docs, np.arange(n + 1))
        places = np.flatnonzero(_told(answers, len(found.docs)))
        change = np.zeros(len(found.docs) + 1, np.int64)
        change[places] += 1
        change[places + length] -= 1
        gone = np.cumsum(change[:-1]) > 0
        return pa.Table.from_arrays(
            [own.column("doc_id"), pa.array(np.diff(bounds)), pa.array(np.bincount(found.docs[gone], minlength=n)),
             _kept(buffer, found, ~gone, n), _spans(found, gone, bounds, n)], schema.names)

    return rows.groupBy("bucket").cogroup(_later_windows(rows, cells, length, first).groupBy("bucket")).applyInArrow(clean, schema)


def _kept(buffer: np.ndarray, found: Spans, keep: np.ndarray, n: int) -> pa.Array:
    """The kept words of each text, joined by one space."""
    starts, ends, docs = found.starts[keep], found.ends[keep], found.docs[keep]
    last = np.r_[docs[1:] != docs[:-1], True] if len(docs) else np.zeros(0, bool)
    sizes = ends - starts + ~last
    total = np.cumsum(sizes)
    out = np.full(total[-1] if len(total) else 0, 32, np.uint8)
    change = np.zeros(len(buffer) + 1, np.int8)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    letters = np.ones(len(out), bool)
    letters[total[~last] - 1] = False
    out[letters] = buffer[np.cumsum(change[:-1], dtype=np.int8) > 0]
    offsets = np.r_[0, total][np.searchsorted(docs, np.arange(n + 1))].astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out))


def _spans(found: Spans, gone: np.ndarray, bounds: np.ndarray, n: int) -> pa.Array:
    """Spans of removed words of each text, as places in it, end exclusive."""
    at = np.flatnonzero(gone)
    docs = found.docs[at]
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (docs[1:] != docs[:-1])] if len(at) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(at)]
    own = docs[begin]
    start = (at[begin] - bounds[own]).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(start), pa.array(start + (end - begin).astype(np.int32))], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(n + 1)).astype(np.int32)), spans)

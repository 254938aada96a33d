"""Words, their hashes and other helpers that several operators share.

Texts come as Arrow arrays and are handled as one byte buffer per batch, so that counting
and hashing words costs a few array passes and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: White space between words: space and \t \n \v \f \r.
SPACES = b" \t\n\x0b\x0c\r"
#: Words of a text, as a pattern for Spark's and Python's regular expressions.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are hashed at a time; keeps the arrays in the processor's cache.
PIECE = 1 << 18

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_AS_IS = np.where(IS_SPACE, np.uint64(0), _BYTE)
_LOWERED = _AS_IS[_LOWER]


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false where the id is null."""
    code = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(code % modulus == remainder, F.lit(False))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that other columns of any name cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def set_aside(df: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns renamed whose name, in any case, is in ``used``, and the names to give them back."""
    names, taken, back = {u.lower() for u in used}, {c.lower() for c in [*df.columns, *used]}, {}
    for c in df.columns:
        if c.lower() in names:
            free = f"_own_{c}"
            while free.lower() in taken:
                free = f"_{free}"
            taken.add(free.lower())
            back[free] = c
    return (df.withColumnsRenamed({c: free for free, c in back.items()}) if back else df), back


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers above 0 and at most 1 from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins; one more offset at the end. Null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    forth, back = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    forth[:1] = back[:1] = 1
    return np.multiply.accumulate(forth), np.multiply.accumulate(back)


@dataclass
class Spans:
    """Runs of bytes: their hashes, their bounds in the buffer, and the text each is in."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes; a longer text makes a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def running(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running hash totals of the bytes, and the factors that move a difference to the origin.

    ``(total[j] - total[i]) * back[i]`` is a hash of the bytes from i to j, wherever they stand.
    """
    n = len(part)
    forth, back = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[part] * forth[:n], dtype=np.uint64, out=total[1:])
    return total, back


def _hashed(part: np.ndarray, table: np.ndarray, inside: np.ndarray, bounds: np.ndarray, powers):
    """Start, end and hash of every run of ``inside`` bytes that crosses no bound."""
    n = len(part)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    edge[n] = True
    before = np.empty(n, bool)
    before[:1] = True
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:n]))
    after = np.empty(n, bool)
    after[-1:] = True
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:]))
    forth, back = powers
    value = table[part] * forth[:n]
    total = np.cumsum(value, dtype=np.uint64)
    return starts, ends + 1, mix((total[ends] - total[starts] + value[starts]) * back[starts])


def words(buffer: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Spans:
    """Every word of every text with a 64-bit hash; ``lower`` maps A-Z to a-z first.

    Two different words share a hash with a chance of about 2**-52 or less, which takes the
    place of comparing strings everywhere in this package.
    """
    return _runs(buffer, offsets, _LOWERED if lower else _AS_IS, lambda part: ~IS_SPACE[part])


def lines(buffer: np.ndarray, offsets: np.ndarray) -> Spans:
    """Every non-empty line between line feeds, hashed with all its bytes."""
    return _runs(buffer, offsets, _BYTE, lambda part: part != 10)


def _runs(buffer: np.ndarray, offsets: np.ndarray, table: np.ndarray, inside) -> Spans:
    hashes, starts, ends, docs = [], [], [], []
    ranges = list(pieces(offsets))
    powers = _powers(max((int(offsets[b] - offsets[a]) for a, b in ranges), default=0))
    for first, last in ranges:
        low = offsets[first]
        part = buffer[low: offsets[last]]
        if not len(part):
            continue
        s, e, h = _hashed(part, table, inside(part), offsets[first:last] - low, powers)
        hashes.append(h)
        starts.append(s + low)
        ends.append(e + low)
        docs.append(np.searchsorted(offsets[first: last + 1], s + low, "right") - 1 + first)
    if not hashes:
        none = np.zeros(0, np.int64)
        return Spans(np.zeros(0, np.uint64), none, none, none)
    return Spans(np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends), np.concatenate(docs))


def windows(hashes: np.ndarray, docs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first position of every run of ``size`` words inside one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(docs[:n] == docs[size - 1:])
    out = np.zeros(len(at), np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[at + i])
    return out, at


def count_words(texts: pa.Array) -> np.ndarray:
    """Words per text; null is empty."""
    buffer, offsets = buffer_of(texts)
    out = np.zeros(len(offsets) - 1, np.int64)
    for first, last in pieces(offsets):
        part = ~IS_SPACE[buffer[offsets[first]: offsets[last]]]
        local = offsets[first:last + 1] - offsets[first]
        before = np.zeros(len(part), bool)
        before[1:] = part[:-1]
        bounds = local[:-1]
        before[bounds[bounds < len(part)]] = False
        total = np.zeros(len(part) + 1, np.int64)
        np.cumsum(part & ~before, out=total[1:])
        out[first:last] = np.diff(total[local])
    return out


def with_words(df: DataFrame, text: str = "text", out: str = "size", keep_text: bool = False) -> DataFrame:
    """``df`` with the number of words of its text, by default without the text."""
    passed = [f for f in df.schema.fields if f.name != out and (keep_text or f.name != text)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, text):
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in passed] + [pa.array(count_words(batch.column(text)))],
                [*[f.name for f in passed], out])

    return df.mapInArrow(add, StructType([*passed, StructField(out, LongType())]))


def fingerprints(found: Spans, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text's sequence of words; 0 for a text without words."""
    counts = np.bincount(found.docs, minlength=n)
    place = (np.arange(len(found.docs)) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)).astype(np.uint64)
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        each = mix(found.hashes ^ mix(place * np.uint64(salt) + np.uint64(1)))
        total = np.zeros(len(each) + 1, np.uint64)
        np.cumsum(each, dtype=np.uint64, out=total[1:])
        ends = np.cumsum(counts)
        out.append(total[ends] - total[ends - counts])
    return out[0], out[1]


def in_parts(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices of at most ``limit`` bytes of text, or one longer text."""
    for batch in batches:
        _, offsets = buffer_of(batch.column(text))
        for first, last in pieces(offsets, limit):
            yield batch.slice(first, last - first)


#: Letters and digits of ASCII and every byte of other characters: what a search term consists of.
IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(buffer: np.ndarray, offsets: np.ndarray) -> Spans:
    """Every maximal run of ASCII letters, digits and other characters beyond ASCII, hashed with A-Z as a-z."""
    return _runs(buffer, offsets, _BYTE[_LOWER], lambda part: IS_TERM[part])

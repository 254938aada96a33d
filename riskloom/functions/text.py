"""Text expressions with Unicode white space, and paragraph packing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskloom import fixed_values as fixed

# White space as Unicode defines it, plus the four ASCII separators; written out because
# the JVM's \s is ASCII only. The same class is valid in RE2.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACE_RANGES = [(0x9, 0xd), (0x1c, 0x20), (0x85, 0x85), (0xa0, 0xa0), (0x1680, 0x1680), (0x2000, 0x200a),
                (0x2028, 0x2029), (0x202f, 0x202f), (0x205f, 0x205f), (0x3000, 0x3000)]
SPACES = "".join(chr(c) for low, high in SPACE_RANGES for c in range(low, high + 1))
BLANK_LINE = rf"\n{SPACE}*\n"


def stripped(text: Column) -> Column:
    """``text`` without white space at either end."""
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """The non-empty pieces between white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, without building them; ``text`` must be stripped."""
    return F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit(f"{SPACE}+")) + 1)


def paragraphs(text: Column, separator: str = BLANK_LINE) -> Column:
    """Stripped, non-empty paragraphs."""
    return F.filter(F.transform(F.split(text, separator), stripped), lambda p: p != "")


def _starts(sizes: Column, max_words: int) -> Column:
    """Indices of the paragraphs that open a chunk; the fold's state grows only with these."""
    start = F.struct(
        F.lit(0).alias("words"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, size: Column) -> Column:
        opens = (acc["at"] == 0) | (acc["words"] + size > max_words)
        return F.struct(
            F.when(opens, size).otherwise(acc["words"] + size).alias("words"),
            (acc["at"] + 1).alias("at"),
            F.when(opens, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"),
        )

    return F.aggregate(sizes, start, step, lambda acc: acc["starts"])


def packed(text: Column, max_words: int = fixed.CHUNK_WORDS, separator: str = BLANK_LINE) -> Column:
    """Array of chunks: paragraphs packed in order, a new chunk where the next would overflow.

    A paragraph above the limit stays whole. Each paragraph is copied once, when the
    chunks are joined.
    """

    def cut(bound: Column) -> Column:
        parts, starts = bound["parts"], bound["starts"]
        return F.transform(starts, lambda at, i: F.array_join(
            F.slice(parts, at + 1, F.coalesce(F.get(starts, i + 1), F.size(parts)) - at), fixed.PARAGRAPH_JOIN))

    # A one-element array binds the intermediate arrays, so they are computed once.
    bound = F.transform(F.array(paragraphs(text, separator)), lambda p: F.struct(
        p.alias("parts"), _starts(F.transform(p, word_count), max_words).alias("starts")))
    return F.flatten(F.transform(bound, cut))


def packed_count(text: Column, max_words: int = fixed.CHUNK_WORDS, separator: str = BLANK_LINE) -> Column:
    """Number of chunks, without joining them."""
    sizes = F.transform(paragraphs(text, separator), word_count)
    return F.coalesce(F.size(_starts(sizes, max_words)), F.lit(0))

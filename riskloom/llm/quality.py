"""Quality rules: document statistics, fixed rules, and gradient-boosted trees over both.

Trees are grown on histograms of a bounded sample of labelled rows and flattened into
numpy node arrays, which score a whole batch at once. Some statistics are constrained: more
repetition or more symbols never raises the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from riskloom.llm.common import IS_SPACE, buffer_of, in_parts, lines, mix, only, pieces, windows, words

#: Most labelled rows that trees are fitted on: those with the smallest hashes of their id.
SAMPLE_ROWS = 20_000
#: A text is rejected where the trees give good quality less than this.
KEEP_AT = 0.3
MIN_WORDS = 50
MAX_REPEATED = 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Columns that judging adds.
ADDED = [*COUNTS, "base_failed", "quality_score", "kept"]
#: What the trees see, and the sign of the constraint: -1 never raises the score as it grows.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": 0, "digit_share": 0, "mark_share": 0, "distinct_share": 0, "stutter_share": -1,
    "lone_mark_share": -1, "line_words": 0,
}


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SYMBOL = _table(b"#*$%&|<>")
_UPPER = _table(bytes(range(65, 91)))
_DIGIT = _table(b"0123456789")
_MARK = _table(b"!\"'()+,-./:;=?@[]^_`{}~\\")
_POINT = ((np.arange(256) & 0xC0) != 0x80) & ~IS_SPACE
_ALNUM = _UPPER | _DIGIT | _table(bytes(range(97, 123))) | (np.arange(256) >= 128)


def _per_text(buffer: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """How many bytes of each text are in each table."""
    out = np.zeros((len(tables), len(offsets) - 1), np.int64)
    for first, last in pieces(offsets):
        part = buffer[offsets[first]: offsets[last]]
        local = offsets[first:last + 1] - offsets[first]
        for i, table in enumerate(tables):
            total = np.zeros(len(part) + 1, np.int64)
            np.cumsum(table[part], out=total[1:])
            out[i, first:last] = np.diff(total[local])
    return out


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts, one row per name in ``COUNTS``, and features, one column per name in ``FEATURES``."""
    n = len(texts)
    buffer, offsets = buffer_of(texts)
    found = words(buffer, offsets, lower=False)
    n_words = np.bincount(found.docs, minlength=n)
    points, symbols, upper, digits, marks = _per_text(buffer, offsets, [_POINT, _SYMBOL, _UPPER, _DIGIT, _MARK])

    def grouped(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, _ = pd.factorize(mix(hashes + docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        return codes, np.bincount(codes) if len(codes) else np.zeros(0, np.int64)

    run, at = windows(found.hashes, found.docs, 3)
    codes, counts = grouped(run, found.docs[at])
    again = at[counts[codes] > 1] if len(at) else at
    repeated = np.zeros(len(found.docs), bool)
    for i in range(3):
        repeated[again + i] = True
    n_repeat = np.bincount(found.docs[repeated], minlength=n)

    row = lines(buffer, offsets)
    next_word = np.searchsorted(found.starts, row.starts)
    worded = next_word < np.searchsorted(found.starts, row.ends)
    codes, counts = grouped(row.hashes[worded], row.docs[worded])
    line_docs = row.docs[worded]
    n_lines = np.bincount(line_docs, minlength=n)
    first = np.zeros(len(counts), np.int64)
    first[codes] = line_docs
    distinct_lines = np.bincount(first, minlength=n)
    n_dup = n_lines - distinct_lines

    codes, counts = grouped(found.hashes, found.docs)
    first = np.zeros(len(counts), np.int64)
    first[codes] = found.docs
    distinct = np.bincount(first, minlength=n)
    same = (found.hashes[1:] == found.hashes[:-1]) & (found.docs[1:] == found.docs[:-1])
    stutter = np.bincount(found.docs[1:][same], minlength=n) if len(found.docs) else np.zeros(n, np.int64)
    lone = (found.ends - found.starts == 1) & ~_ALNUM[buffer[found.starts]]
    lone = np.bincount(found.docs[lone], minlength=n)

    per_word, per_char = np.maximum(n_words, 1), np.maximum(points, 1)
    features = np.c_[
        np.log1p(n_words), points / per_word, symbols / per_char, n_dup / np.maximum(n_lines, 1),
        n_repeat / per_word, upper / per_char, digits / per_char, marks / per_char, distinct / per_word,
        stutter / per_word, lone / per_word, n_words / np.maximum(n_lines, 1)]
    return np.stack([n_words, points, symbols, n_dup, n_repeat]), features


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[0] < MIN_WORDS) | (100 * counts[4] > MAX_REPEATED * counts[0])


@dataclass
class Trees:
    """Node arrays, one row per tree. A leaf is its own child, so every walk takes the same steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of good quality of each row of ``x``."""
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.start)))
        tree = np.arange(len(self.feature))
        node = np.zeros((len(x), len(tree)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[rows, self.feature[tree, node]] <= self.threshold[tree, node]
            node = np.where(low, self.left[tree, node], self.right[tree, node])
        return 1 / (1 + np.exp(-self.start - self.value[tree, node].sum(axis=1)))


def grow(x: np.ndarray, y: np.ndarray, signs: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2,
         bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Boosted trees for logistic loss; ``signs`` has -1, 0 or 1 per column of ``x``.

    A split on a constrained column must order its children's values, and both children
    must stay on their side of the middle from then on. No rows, or rows of one class only,
    give trees without a split, which keep every text.
    """
    nodes = 2 ** (depth + 1) - 1
    if not len(y) or y.min() == y.max():
        empty = np.zeros((0, nodes))
        return Trees(empty.astype(int), empty, empty.astype(int), empty.astype(int), empty, depth, 10.0)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    cell = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    total, n_bins = np.full(len(y), start), bins + 1
    out = [[], [], [], [], []]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(nodes, np.int64), np.zeros(nodes)
        left, right, value = np.arange(nodes), np.arange(nodes), np.zeros(nodes)
        low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
        place = np.zeros(len(y), np.int64)
        weight = lambda g, h: -g / (h + ridge)
        value[0] = weight(gradient.sum(), hessian.sum())
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(place == node)
                if len(rows) < 2:
                    continue
                g_all, h_all = gradient[rows].sum(), hessian[rows].sum()
                best = (1e-6, -1, 0, 0.0, 0.0)
                for j in range(x.shape[1]):
                    g = np.cumsum(np.bincount(cell[j, rows], gradient[rows], n_bins))[:len(cuts[j])]
                    h = np.cumsum(np.bincount(cell[j, rows], hessian[rows], n_bins))[:len(cuts[j])]
                    a = np.clip(weight(g, h), low[node], high[node])
                    b = np.clip(weight(g_all - g, h_all - h), low[node], high[node])
                    gain = -(g * a + 0.5 * (h + ridge) * a * a) - ((g_all - g) * b + 0.5 * (h_all - h + ridge) * b * b)
                    gain += g_all * value[node] + 0.5 * (h_all + ridge) * value[node] ** 2
                    bad = (h < least) | (h_all - h < least) | (signs[j] * (b - a) < 0)
                    gain = np.where(bad, -np.inf, gain)
                    if len(gain) and gain.max() > best[0]:
                        k = int(gain.argmax())
                        best = (float(gain[k]), j, k, float(a[k]), float(b[k]))
                _, j, k, a, b = best
                if j < 0:
                    continue
                feature[node], threshold[node] = j, cuts[j][k]
                left[node], right[node] = 2 * node + 1, 2 * node + 2
                value[left[node]], value[right[node]] = a, b
                for child, own in ((left[node], -1), (right[node], 1)):
                    low[child], high[child] = low[node], high[node]
                    if signs[j]:
                        if own * signs[j] > 0:
                            low[child] = max(low[child], (a + b) / 2)
                        else:
                            high[child] = min(high[child], (a + b) / 2)
                place[rows] = np.where(cell[j, rows] <= k, left[node], right[node])
        total = total + rate * value[place]
        for store, part in zip(out, (feature, threshold, left, right, rate * value)):
            store.append(part)
    return Trees(*[np.stack(part) for part in out], depth, start)


def fit(docs: DataFrame, labels: DataFrame) -> Trees:
    """Trees for ``labels(doc_id, quality)`` of ``docs(doc_id, text)``.

    At most ``SAMPLE_ROWS`` ids are used, by hash of the id; an id with several labels has
    the lowest; null ids and labels are left out. Only statistics come to the driver.
    """
    rows = only(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    sample = rows.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality")).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    texts = only(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
    schema = StructType([StructField("doc_id", LongType()), StructField("quality", LongType())]
                        + [StructField(f, DoubleType()) for f in FEATURES])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, "text"):
            _, x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int64())]
                + [pa.array(x[:, j]) for j in range(len(FEATURES))], [f.name for f in schema])

    got = texts.mapInArrow(measure, schema).toPandas()
    got = got.sort_values(list(got.columns), kind="stable")
    return grow(got[list(FEATURES)].to_numpy(), got["quality"].to_numpy(float), np.array(list(FEATURES.values())))


def judge(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``quality_score`` and ``kept``.

    A null or empty text has no words and fails the fixed rules. Columns of these names in
    ``docs`` are replaced.
    """
    added = [StructField(c, LongType()) for c in COUNTS] + [
        StructField("base_failed", BooleanType()), StructField("quality_score", DoubleType()),
        StructField("kept", BooleanType())]
    passed = [f for f in docs.schema.fields if f.name not in ADDED]
    model = vars(trees)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Trees(**model)
        for batch in in_parts(batches, text):
            counts, x = statistics(batch.column(text))
            failed = base_failed(counts)
            good = forest.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in passed] + [pa.array(c) for c in counts]
                + [pa.array(failed), pa.array(good), pa.array(~failed & (good >= KEEP_AT))],
                [f.name for f in [*passed, *added]])

    return docs.mapInArrow(add, StructType([*passed, *added]))

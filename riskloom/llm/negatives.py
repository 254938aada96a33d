"""Hard negatives by inner product, with bounds from segment summaries.

A vector is cut into segments, and of each segment its mean and its deviation (the length of
what the mean leaves over) are kept. The inner product of two segments is the product of
their means times their size, give or take the product of their deviations. Sums over the
segments bound a score from both sides, first with one segment, then with two, four and so
on. Only pairs whose bounds still reach an interval of wanted scores are refined, and only
those that all levels leave are scored exactly.

Anchors are stored once; every task scans its rows block by block and keeps, for each anchor,
the few best so far, whose last score is the bar for all later blocks. So neither side is
shuffled or repeated, and a task returns a bounded number of rows an anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import dataset
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskloom.llm.common import only
from riskloom.plans.lineage import file_system, materialise, scratch_path

#: Positives of an anchor, negatives of a pair, and the least and greatest percentage of the positive's score (fixed values).
POSITIVES, NEGATIVES, LEAST, MOST = 5, 3, 50, 95
#: Anchors that one pass over the rows serves (about a kilobyte each in every task), and blocks of anchors and rows that meet.
PASS_ANCHORS, BLOCK_ANCHORS, BLOCK_ROWS = 1 << 18, 128, 2048
#: Most segments of a vector, and components that a segment has at least.
SEGMENTS, SEGMENT = 16, 4
#: Share of pairs below which they are refined one by one instead of as a matrix.
FEW = 0.1
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def integers(vectors: DataFrame, scale: int = 256, label: Column | None = None) -> DataFrame:
    """``id, label, v`` of ``vectors(vec_id, embedding, label)``: every component as ``floor(scale * x)``, x as double.

    Rows with a null id, label or vector, or a null or non-finite component take no part.
    ``label`` may be an expression over ``id`` and ``label``.
    """
    x = F.transform(F.col("v"), lambda c: c.cast("double"))
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = only(vectors, "vec_id", "embedding", "label").toDF("id", "v", "label").where(
        "id IS NOT NULL AND v IS NOT NULL AND label IS NOT NULL")
    rows = rows.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), x.alias("v")).where(usable)
    return rows.select("id", (F.col("label") if label is None else label).cast("bigint").alias("label"),
                       F.transform("v", lambda c: F.floor(c * scale)).alias("v"))


@dataclass
class Level:
    """Mean and deviation of every segment of some vectors, at one number of segments."""

    means: np.ndarray
    deviations: np.ndarray
    sizes: np.ndarray


def levels(vectors: np.ndarray) -> list[Level]:
    """Summaries with 1, 2, 4, ... segments."""
    n, width = vectors.shape
    out, count = [], 1
    while count == 1 or count <= SEGMENTS and width // count >= SEGMENT:
        bounds = np.linspace(0, width, count + 1).astype(int)
        sizes = np.diff(bounds)
        means, deviations = np.zeros((n, count)), np.zeros((n, count))
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if b > a:
                means[:, i] = vectors[:, a:b].mean(axis=1)
                deviations[:, i] = np.sqrt(((vectors[:, a:b] - means[:, [i]]) ** 2).sum(axis=1))
        out.append(Level(means, deviations, sizes))
        count *= 2
    return out


@dataclass
class Vectors:
    """Vectors of one length with ids, labels, summaries and lengths."""

    ids: np.ndarray
    labels: np.ndarray
    exact: np.ndarray
    floats: np.ndarray
    levels: list[Level]
    lengths: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> "Vectors":
        floats = matrix.astype(np.float64)
        return cls(ids, labels, matrix, floats, levels(floats), np.sqrt((floats * floats).sum(axis=1)))

    def part(self, at) -> "Vectors":
        return Vectors(self.ids[at], self.labels[at], self.exact[at], self.floats[at],
                       [Level(x.means[at], x.deviations[at], x.sizes) for x in self.levels], self.lengths[at])


def possible_pairs(rows: Vectors, asked: Vectors, wanted: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row and an anchor that the bounds of all levels leave.

    ``wanted(low, high, rows, anchors)`` says which pairs with scores from low to high matter;
    the places may be arrays that broadcast to a matrix, or lists of pairs.
    """
    every = np.arange(len(rows.ids))[:, None], np.arange(len(asked.ids))[None, :]
    slack = 1e-9 * rows.lengths[:, None] * asked.lengths[None, :] + 1e-6
    mask, pairs = None, None
    for own, other in zip(rows.levels, asked.levels):
        if pairs is None:
            middle = (own.means * own.sizes) @ other.means.T
            around = own.deviations @ other.deviations.T + slack
            now = wanted(middle - around, middle + around, *every)
            mask = now if mask is None else mask & now
            if mask.sum() <= FEW * mask.size:
                pairs = np.nonzero(mask)
        else:
            r, a = pairs
            middle = np.einsum("ij,ij->i", (own.means * own.sizes)[r], other.means[a])
            around = np.einsum("ij,ij->i", own.deviations[r], other.deviations[a]) + slack[r, a]
            keep = wanted(middle - around, middle + around, r, a)
            pairs = r[keep], a[keep]
    return pairs if pairs is not None else np.nonzero(mask)


def exact_scores(rows: Vectors, asked: Vectors, r: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs, as a matrix product where most pairs of the block are asked for."""
    width = rows.exact.shape[1]
    safe = float(np.abs(rows.floats).max(initial=0)) * float(np.abs(asked.floats).max(initial=0)) * max(width, 1) < 2**53
    left, right = (rows.floats, asked.floats) if safe else (rows.exact, asked.exact)
    if safe and len(r) > FEW * len(rows.ids) * len(asked.ids):
        return (left @ right.T)[r, a].astype(np.int64)
    out = np.empty(len(r), np.int64)
    for i in range(0, len(r), 1 << 16):
        out[i:i + (1 << 16)] = np.einsum("ij,ij->i", left[r[i:i + (1 << 16)]], right[a[i:i + (1 << 16)]])
    return out


class Best:
    """The ``k`` best ids and scores of numbered slots: highest scores, ties to smaller ids."""

    def __init__(self, slots: int, k: int):
        self.ids = np.full((slots, k), _HIGH)
        self.scores = np.full((slots, k), _LOW)

    @property
    def floor(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, slots: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.floor[slots]
        slots, ids, scores = slots[good], ids[good], scores[good]
        touched = np.unique(slots)
        k = self.ids.shape[1]
        slots = np.r_[slots, np.repeat(touched, k)]
        ids, scores = np.r_[ids, self.ids[touched].ravel()], np.r_[scores, self.scores[touched].ravel()]
        order = np.lexsort((ids, -np.maximum(scores, _LOW + 1), slots))
        slots, ids, scores = slots[order], ids[order], scores[order]
        place = np.arange(len(slots)) - np.searchsorted(slots, slots)
        keep = place < k
        self.ids[slots[keep], place[keep]] = ids[keep]
        self.scores[slots[keep], place[keep]] = scores[keep]


def few_copies(rows: Vectors, keep: int) -> Vectors:
    """The rows without those that equal ``keep`` others of smaller id in vector and label, which cannot be among the best."""
    mixer = np.random.default_rng(5).integers(1, 2**62, rows.exact.shape[1] + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    code = rows.exact.astype(np.uint64) @ mixer[1:] + rows.labels.astype(np.uint64) * mixer[0]
    order = np.lexsort((rows.ids, code))
    same = np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    near = np.flatnonzero(code[a] == code[b])
    same[near + 1] = (rows.exact[a[near]] == rows.exact[b[near]]).all(axis=1) & (rows.labels[a[near]] == rows.labels[b[near]])
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    return rows.part(np.sort(order[np.arange(len(order)) - start < keep]))


def scan(rows: Vectors, asked: Vectors, least: np.ndarray, most: np.ndarray, number: np.ndarray, same: bool, best: Best) -> None:
    """Offers ``best`` the rows whose score lies in an interval of an anchor.

    ``least`` and ``most`` hold the intervals of every anchor, which are the slots
    ``number * intervals`` and following of ``best``; ``same`` asks for rows of the anchor's label, else
    of other labels. The anchor's own id never counts.
    """
    intervals = least.shape[1]
    slots = number[:, None] * intervals + np.arange(intervals)
    bar = np.maximum(least, best.floor[slots])

    def wanted(low, high, r, a):
        out = np.zeros(np.broadcast(r, a).shape, bool)
        for j in range(intervals):
            out |= (high >= bar[a, j]) & (low <= most[a, j])
        return out & ((rows.labels[r] == asked.labels[a]) == same) & (rows.ids[r] != asked.ids[a])

    r, a = possible_pairs(rows, asked, wanted)
    scores = exact_scores(rows, asked, r, a)
    for j in range(intervals):
        good = np.flatnonzero((scores >= bar[a, j]) & (scores <= most[a, j]))
        best.add(slots[a[good], j], rows.ids[r[good]], scores[good])


def _by_width(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[np.ndarray, Vectors]]:
    """Row numbers and vectors of a table, one part for each length of vectors."""
    column = table.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    widths = column.value_lengths().to_numpy()
    starts = np.cumsum(widths) - widths
    flat = column.flatten().to_numpy()
    ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        yield at, Vectors.of(ids[at], labels[at], flat[starts[at][:, None] + np.arange(width)])


def _meet(rows: DataFrame, asked: DataFrame, intervals: int, same: bool, k: int) -> DataFrame:
    """``anchor_id, place, id, score``: the ``k`` best rows in each interval of every stored anchor, per task."""
    stored = scratch_path(asked.sparkSession, "anchors")
    asked.write.parquet(stored)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, blocks = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            if best is None:
                fs, path = file_system(stored)
                table = dataset.dataset(path, filesystem=fs, format="parquet", exclude_invalid_files=False).to_table()
                table = table.sort_by([("label", "ascending"), ("id", "ascending")]) if table.num_rows else table
                least, most = (np.array(table.column(c).to_pylist(), np.int64).reshape(-1, intervals) for c in ("least", "most"))
                names = table.column("id").to_numpy()
                best = Best(len(names) * intervals, k)
                if not len(names):
                    return
                for at, vectors in _by_width(table):
                    blocks[vectors.exact.shape[1]] = [(at[i:i + BLOCK_ANCHORS], vectors.part(slice(i, i + BLOCK_ANCHORS)))
                                                      for i in range(0, len(at), BLOCK_ANCHORS)]
            for _, own in _by_width(batch):
                own = few_copies(own, k + 1)
                own = own.part(np.argsort(own.labels, kind="stable"))
                for number, anchors in blocks.get(own.exact.shape[1], ()):
                    # Both sides are sorted by label.
                    low, high = np.searchsorted(own.labels, [anchors.labels[0], anchors.labels[-1] + 1]) if same else (0, len(own.ids))
                    for i in range(low, high, BLOCK_ROWS):
                        scan(own.part(slice(i, min(i + BLOCK_ROWS, high))), anchors, least[number], most[number], number, same, best)
        if best is not None:
            slot, place = np.nonzero(best.scores > _LOW)
            yield pa.RecordBatch.from_arrays([
                pa.array(names[slot // intervals]), pa.array((slot % intervals).astype(np.int32)),
                pa.array(best.ids[slot, place]), pa.array(best.scores[slot, place])], ["anchor_id", "place", "id", "score"])

    return rows.mapInArrow(meet, "anchor_id bigint, place int, id bigint, score bigint")


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         least: int = LEAST, most: int = MOST) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` over ``rows(id, label, v)``.

    Rows for which ``anchors`` holds are anchors. Their positives are the ``positives`` best other rows of
    their label; for each, the ``negatives`` best rows of other labels are returned whose score is
    from ``least`` to ``most`` percent of the positive's. Best is the highest inner product,
    then the smallest id.

    A row with the anchor's id is never its partner, and vectors of different lengths never
    meet. Repeated rows count as often as they occur; of anchors with one id that of the
    smallest label and vector asks. A positive with a negative score has an empty interval. Empty
    inputs give no rows. Scores must fit 64 bits.
    """
    if not rows.schema.names == ["id", "label", "v"]:
        rows = only(rows, "id", "label", "v")
    asked = materialise(rows.where(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("s")).select(
        "id", "s.label", "s.v"), "asked")
    passes, out = max(1, -(-asked.count() // PASS_ANCHORS)), None
    for i in range(passes):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == i) if passes > 1 else asked
        whole = own.withColumns({"least": F.array(F.lit(_LOW + 1)), "most": F.array(F.lit(_HIGH))})
        found = _best(_meet(rows, whole, 1, True, positives), positives)
        found = materialise(found.select("anchor_id", F.col("id").alias("positive_id"), F.col("rank").alias("place"),
                                         F.col("score").alias("positive_score")), "positives")
        # Rounded to the integers inside, without overflow; where there is no positive stands an interval without numbers.
        ranges = found.where("positive_score >= 0").withColumns({
            "low": F.expr(f"positive_score div 100 * {least} + (positive_score % 100 * {least} + 99) div 100"),
            "high": F.expr(f"positive_score div 100 * {most} + positive_score % 100 * {most} div 100")})
        lists = ranges.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("low", "high")))).alias("m"))
        at = lambda name, none: F.array(*[F.coalesce(F.col("m")[p + 1][name], F.lit(none)) for p in range(positives)])
        intervals = own.join(lists.withColumnRenamed("anchor_id", "id"), "id").select(
            "id", "label", "v", at("low", _HIGH).alias("least"), at("high", _LOW + 1).alias("most"))
        hits = _best(_meet(rows, intervals, positives, False, negatives), negatives)
        part = hits.withColumn("place", F.col("place") + 1).join(found, ["anchor_id", "place"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"))
        out = part if out is None else out.unionByName(part)
    return out

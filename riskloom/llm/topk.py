"""Exact top-k by inner product from an impact-ordered index, score at a time.

Vectors of integers are held in blocks of bounded size. The index of a block has, for every
dimension, posting segments of the rows whose component has the same quantised impact.
Segments are processed by descending impact for a batch of queries at once: each adds its
impact times the query's weight to the accumulators of its rows. What a row's accumulator
still lacks is at most the length of the query times the length of the row's unprocessed
and rounded-off rest (Cauchy-Schwarz), which the index knows for every level. Processing
stops only when that bound proves that few rows can be among the best; those rows are
scored again exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskloom.llm.common import only
from riskloom.plans.lineage import materialise

#: Rows of a block, and queries that meet a block in one group.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 8_192
#: Queries whose accumulators are held at once.
BATCH = 128
#: Quantised impact levels of a block.
LEVELS = 24
#: Processing may stop when the proof leaves at most so many rows a query, on average.
FEW = 48


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``id, v``: every component as ``floor(scale * x)``, x as double.

    Rows with a null id, a null vector, or a null or non-finite component take no part.
    """
    x = F.transform(F.col("v"), lambda c: c.cast("double"))
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = only(vectors, key, vector).select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").alias("v"))
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL").select("id", x.alias("v"))
    return rows.where(usable).select("id", F.transform("v", lambda c: F.floor(c * scale)).alias("v"))


@dataclass
class Index:
    """Posting segments of one block, by descending level, and what remains after each level."""

    ids: np.ndarray
    rows: np.ndarray
    segments: list[list[tuple[int, np.ndarray, np.ndarray]]]
    rest: np.ndarray


def build(ids: np.ndarray, rows: np.ndarray, levels: int = LEVELS) -> Index:
    """Quantises ``rows`` by magnitude; a segment's impact is the middle of its level, with the sign."""
    rows = rows.astype(np.float64)
    size = np.abs(rows)
    width = max(float(np.ceil((size.max(initial=0) + 1) / levels)), 1.0)
    level = (size // width).astype(np.int16)
    centre = np.sign(rows) * (level * width + (width - 1) / 2)
    segments, left, rest = [], rows.copy(), []
    for depth in range(levels - 1, -1, -1):
        own = []
        at, dims = np.nonzero(level == depth)
        order = np.argsort(dims, kind="stable")
        at, dims = at[order], dims[order]
        bounds = np.searchsorted(dims, np.arange(rows.shape[1] + 1))
        for dim in range(rows.shape[1]):
            some = at[bounds[dim]:bounds[dim + 1]]
            if len(some):
                own.append((dim, some, centre[some, dim]))
                left[some, dim] -= centre[some, dim]
        segments.append(own)
        rest.append(np.sqrt((left * left).sum(axis=1)))
    return Index(ids, rows, segments, np.array(rest))


def search(index: Index, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query, id, score`` of the ``k`` best rows of the block for each query, ties to smaller ids.

    A row with the query's own id does not count.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = len(index.ids)
    for start in range(0, len(query_ids), BATCH):
        own, q = query_ids[start:start + BATCH], queries[start:start + BATCH].astype(np.float64)
        length = np.sqrt((q * q).sum(axis=1))
        total = np.zeros((n, len(own)))
        same = np.equal.outer(index.ids, own)
        weights = np.ascontiguousarray(q.T)
        possible = ~same
        for depth, segments in enumerate(index.segments):
            for dim, rows, impact in segments:
                total[rows] += impact[:, None] * weights[dim]
            # A look costs about as much as a level, so the first half goes without.
            if n <= k or depth < len(index.segments) // 2 or depth % 2 == 0 and depth + 1 < len(index.segments):
                continue
            slack = index.rest[depth][:, None] * length[None, :] * (1 + 1e-9) + 1e-6
            sure = np.where(same, -np.inf, total - slack)
            floor = np.partition(sure, n - k, axis=0)[n - k]
            possible = (total + slack >= floor) & ~same
            if possible.sum() <= FEW * len(own):
                break
        rows, columns = np.nonzero(possible)
        exact = np.empty(len(rows))
        for a in range(0, len(rows), 1 << 17):
            b = a + (1 << 17)
            exact[a:b] = np.einsum("ij,ij->i", index.rows[rows[a:b]], q[columns[a:b]])
        order = np.lexsort((index.ids[rows], -exact, columns))
        columns, rows, exact = columns[order], rows[order], exact[order]
        rank = np.arange(len(columns)) - np.searchsorted(columns, columns)
        best = rank < k
        out.append((own[columns[best]], index.ids[rows[best]], exact[best].astype(np.int64)))
    return tuple(np.concatenate(part) for part in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    table = table.combine_chunks()
    ids = table.column("id").to_numpy()
    if not len(ids):
        return ids, np.zeros((0, 0))
    vectors = table.column("v").combine_chunks()
    vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
    return ids, vectors.flatten().to_numpy().reshape(len(ids), -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the best rows of ``vectors(id, v)`` for each of ``queries(id, v)``.

    Every row is a candidate for every query but one of its own id. Vectors of different
    lengths never meet: a query's candidates are the rows of its own dimension. Ties go to
    the smaller id, repeated rows count as often as they occur, of queries with one id the
    smallest vector is asked, and empty inputs give no rows. Blocks of rows meet blocks of queries, so a task holds one of each at most.
    """
    stored = materialise(vectors.withColumn("dim", F.size("v")), "vectors")
    asked = materialise(queries.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "queries")
    sizes = {(r["side"], r["dim"]): r["n"] for side, df in ((0, stored), (1, asked))
             for r in df.groupBy(F.lit(side).alias("side"), "dim").count().withColumnRenamed("count", "n").collect()}
    rows_of = {d: n for (side, d), n in sizes.items() if side == 0 and (1, d) in sizes}
    if not rows_of:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")

    def blocks(df: DataFrame, side: int, block: int) -> tuple[DataFrame, dict[int, int]]:
        count = {d: -(-sizes[side, d] // block) for d in rows_of}
        number = F.element_at(F.create_map(*[F.lit(x) for pair in count.items() for x in pair]), F.col("dim"))
        # Rows are dealt by their place in the stored table, so repeated rows spread as well.
        place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), number)
        return df.where(F.col("dim").isin(list(rows_of))).withColumn("own", place), count

    left, left_blocks = blocks(stored, 0, BLOCK_ROWS)
    right, right_blocks = blocks(asked, 1, BLOCK_QUERIES)

    def repeated(df: DataFrame, count: dict[int, int], own: str, other: str) -> DataFrame:
        number = F.element_at(F.create_map(*[F.lit(x) for pair in count.items() for x in pair]), F.col("dim"))
        return df.withColumnRenamed("own", own).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), (number - 1).cast("bigint"))))

    left = repeated(left, right_blocks, "block", "ask").select("dim", "block", "ask", "id", "v")
    right = repeated(right, left_blocks, "ask", "block").select("dim", "block", "ask", "id", "v")

    def meet(rows: pa.Table, questions: pa.Table) -> pa.Table:
        ids, matrix = _matrix(rows)
        query_ids, weights = _matrix(questions)
        if not len(ids) or not len(query_ids):
            found = (np.zeros(0, np.int64),) * 3
        elif not matrix.shape[1]:  # vectors without components: every score is 0
            found = search(build(ids, np.zeros((len(ids), 1))), query_ids, np.zeros((len(query_ids), 1)), k)
        else:
            found = search(build(ids, matrix), query_ids, weights, k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    keys = ["dim", "block", "ask"]
    local = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        meet, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")

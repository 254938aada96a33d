"""Near duplicates by BagMinHash: weighted-Jaccard signatures of word 5-grams, bands, exact overlap.

A text is the multiset of its runs of five lower-cased words. A signature register holds
the first arrival of a Poisson process that runs over all shingles and weight levels, so
two registers agree with exactly the weighted Jaccard similarity as probability. Weights
are discretised to whole occurrences and handled in doubling intervals, each with one
process of its width; an arrival counts if its level is below the weight. A process is
followed only until its arrivals come later than everything the text has so far.

Texts that share a band of registers are candidates, and the exact overlap decides. Instead
of all pairs of a bucket, every member is compared with one leader, and what is linked
becomes one component. Buckets that still hold several components try other leaders from
their largest one. What is left is a few texts beside a component, whose pairs are
compared unless the distances to a leader rule them out, or a bucket of many texts that
only share a passage. Those texts meet again by their rarest shingles only, as many as any
similar text must share one of (prefix filter), and what is left is compared. Copies of one
text are one member throughout.

With 64 bands of 8 registers a pair at similarity 0.8 shares no band with probability 8e-6.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from riskloom.llm.common import buffer_of, fingerprints, in_parts, mix, only, set_aside, uniform, windows, words
from riskloom.plans.components import components
from riskloom.plans.lineage import materialise

#: Words of a shingle, and the least similarity of a link (fixed values).
SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 64, 8
#: Texts whose shingles are handled at once: at most so many shingles, unless one text has more.
BATCH_SHINGLES, BATCH_TEXTS = 1 << 17, 512
#: Links in a file of joined components.
FILE_ROWS = 200_000
#: Further leaders that an unsettled bucket tries, as long as they link anything.
TURNS = 1
#: A bucket with at most so many pairs across components per member is settled by comparing those pairs.
LISTED = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of the texts as two columns, and hash and text of every shingle."""
    buffer, offsets = buffer_of(texts)
    found = words(buffer, offsets)
    first, second = fingerprints(found, len(texts))
    hashes, at = windows(found.hashes, found.docs, SHINGLE)
    counts = np.bincount(found.docs, minlength=len(texts))
    return np.c_[first, second], counts, hashes, found.docs[at]


def _bags(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their weights, by text."""
    order = np.lexsort((hashes, docs))
    h, d = hashes[order], docs[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return h[at], np.diff(np.r_[at, len(h)]), d[at]


def signatures(hashes: np.ndarray, weights: np.ndarray, docs: np.ndarray, n: int, size: int, seed: int = 0) -> np.ndarray:
    """One row of ``size`` registers for each of ``n`` texts; infinite where a text has no shingle."""
    levels = np.ones(len(weights), np.int64)
    levels[weights > 1] = np.ceil(np.log2(weights[weights > 1])).astype(np.int64) + 1
    each = np.repeat(np.arange(len(hashes)), levels)
    level = np.arange(len(each)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)
    key = mix(hashes[each] + mix((level + 64 * (seed + 1)).astype(np.uint64) * _STEP))
    doc, weight = docs[each].astype(np.int64), weights[each]
    registers = np.full(n * size, np.inf)
    latest, now = np.full(n, np.inf), np.zeros(len(each))
    alive, step = np.arange(len(each)), 0
    while len(alive):
        texts = len(np.unique(doc[alive])) if step == 0 else max(1, len(np.unique(doc[alive])))
        many = int(np.clip(-(-2 * size * texts // len(alive)), 1, max(1, (1 << 20) // len(alive))))
        draw = mix(key[alive][:, None] + np.arange(step + 1, step + 1 + many, dtype=np.uint64)[None, :] * _STEP)
        arrival = -np.log(uniform(draw)) / (size * width[alive])[:, None]
        arrival[:, 0] += now[alive]
        np.cumsum(arrival, axis=1, out=arrival)  # one by one, so the sums do not depend on ``many``
        place = mix(draw ^ np.uint64(0xA0761D6478BD642F))
        at = low[alive][:, None] + ((place >> np.uint64(32)).astype(np.int64) % width[alive][:, None])
        counts = (arrival < latest[doc[alive]][:, None]) & (at < weight[alive][:, None])
        register = (place & np.uint64(0xFFFFFFFF)).astype(np.int64) % size + doc[alive][:, None] * size
        np.minimum.at(registers, register[counts], arrival[counts])
        now[alive] = arrival[:, -1]
        latest = registers.reshape(n, size).max(axis=1) if n else latest
        alive = alive[now[alive] < latest[doc[alive]]]
        step += many
    return registers.reshape(n, size)


def band_keys(registers: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per band; equal registers give equal keys."""
    n, size = registers.shape
    bits = np.ascontiguousarray(registers).view(np.uint64).reshape(n, size // rows, rows)
    key = np.broadcast_to(np.arange(size // rows, dtype=np.uint64) * _STEP, (n, size // rows)).copy()
    for i in range(rows):
        key = mix(key * _STEP + bits[:, :, i])
    return key.view(np.int64)


def _batches(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of texts with at least one shingle, similar sizes together."""
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    start = 0
    total = np.cumsum(sizes[order])
    while start < len(order):
        base = total[start] - sizes[order[start]]
        end = max(start + 1, int(np.searchsorted(total, base + BATCH_SHINGLES, "right")))
        end = min(end, start + BATCH_TEXTS)
        yield order[start:end]
        start = end


def bands_of(hashes: np.ndarray, weights: np.ndarray, docs: np.ndarray, n: int, bands: int = BANDS,
             rows: int = ROWS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts with shingles, and their band keys."""
    starts = np.searchsorted(docs, np.arange(n + 1))
    texts, keys = [np.zeros(0, np.int64)], [np.zeros((0, bands), np.int64)]
    for group in _batches(np.diff(starts)):
        counts = starts[group + 1] - starts[group]
        at = np.repeat(starts[group] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        local = np.repeat(np.arange(len(group)), counts)
        registers = signatures(hashes[at], weights[at], local, len(group), bands * rows, seed)
        texts.append(group)
        keys.append(band_keys(registers, rows))
    return np.concatenate(texts), np.concatenate(keys)


def _binary(pairs: np.ndarray, mask: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(pairs).tobytes()
    return pa.array([None if m else data[16 * i:16 * i + 16] for i, m in enumerate(mask)], pa.binary())


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, node, bands`` of ``docs(doc_id, text)``.

    ``node`` identifies the sequence of lower-cased words and is null without words; a text
    of fewer than five words has no bands, as only copies can equal it.
    """
    slim = only(docs, "doc_id", "text")
    schema = StructType([slim.schema["doc_id"], StructField("node", BinaryType()),
                         StructField("bands", ArrayType(LongType()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, "text"):
            n = batch.num_rows
            prints, counts, hashes, owners = shingles(batch.column("text"))
            texts, keys = bands_of(*_bags(hashes, owners), n, bands, rows)
            lengths = np.zeros(n, np.int64)
            lengths[texts] = bands
            row = np.argsort(texts)
            lists = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(keys[row].reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), _binary(prints, counts == 0), lists], schema.names)

    return slim.mapInArrow(sign, schema)


def shingle_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, elements`` of the texts in ``wanted(node, doc_id)``; the k-th occurrence of a shingle is its own element."""
    slim = only(docs, "doc_id", "text")
    named = slim.where("doc_id IS NOT NULL").join(
        wanted.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi")
    schema = StructType([StructField("node", BinaryType()), StructField("elements", ArrayType(LongType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, "text"):
            n = batch.num_rows
            prints, counts, hashes, owners = shingles(batch.column("text"))
            order = np.lexsort((hashes, owners))
            h, d = hashes[order], owners[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            again = np.arange(len(h)) - np.repeat(at, np.diff(np.r_[at, len(h)]))
            elements = mix(h + again.astype(np.uint64) * _STEP).view(np.int64)
            bounds = np.searchsorted(d, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [_binary(prints, counts == 0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(elements))],
                schema.names)

    found = named.unionByName(slim.where("doc_id IS NULL")).mapInArrow(cut, schema)
    return found.join(wanted.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])


def compared(pairs: DataFrame, elements: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``pairs(a, b)`` with ``distance``, one less the weighted Jaccard similarity, and whether they are ``linked``."""
    left = elements.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = elements.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(left, "a").join(right, "b").select(
        "a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("all"))
    union = F.col("all") - F.col("both")
    return joined.select("a", "b", (1 - F.col("both") / union).alias("distance"),
                         (F.col("both") >= similar * union).alias("linked"))


def _placed(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """``bucket, node, n, place``: the elements that ``nodes`` share, and where each stands in its text.

    Texts have their elements in one order, rarest first, so that a passage that many texts share comes
    last. ``place`` counts from 1 and ``n`` is the number of all elements; those of one text only come first
    of all, but lead nowhere. Places beyond any prefix that decides are left out.
    """
    own = elements.join(nodes, "node", "left_semi")
    rows = own.select("node", F.size("elements").alias("n"), F.explode("elements").alias("bucket"))
    common = rows.groupBy("bucket").agg(F.count("*").alias("texts")).where("texts > 1")
    by_node = Window.partitionBy("node")
    shared = rows.join(common, "bucket").withColumn("place", F.row_number().over(by_node.orderBy("texts", "bucket"))
                                                    + F.col("n") - F.count("*").over(by_node))
    return shared.where(F.col("place") <= _prefix("n", SIMILAR)).select("bucket", "node", "n", "place")


def _prefix(n: str, share: float) -> Column:
    """Elements of which a text must share one with any text that has at least ``share`` of its elements in common with it."""
    return F.col(n) - F.ceil(F.col(n) * share - 1e-9) + 1


def _possible(placed: DataFrame, components: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Pairs ``a, b`` of different ``components(node, component)`` that their prefixes do not rule out; none that is similar is lost.

    Of two similar texts the larger one, with n elements, shares at least similar * n of them, and the smaller one at
    least 2 * similar / (1 + similar) of its own, so their first common element lies in the longer prefix of the larger
    and in the shorter prefix of the smaller text. From there on, no more can be common than either
    text has left.
    """
    joint = similar / (1 + similar)
    named = placed.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    small = named.where(F.col("place") <= _prefix("n", 2 * joint)).select(
        "bucket", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "place", "component")])
    # An element that only one text has in its short prefix, and none in its long one besides, can meet nothing.
    met = small.groupBy("bucket").agg(F.count("*").alias("texts"))
    large = named.join(met, "bucket").select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "place", "component")])
    order = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    left = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    meets = order & (F.col("n_a") >= similar * F.col("n_b") - 1e-9) & (F.col("component_a") != F.col("component_b")) & (
        left >= F.ceil(joint * (F.col("n_a") + F.col("n_b")) - 1e-9))
    return small.join(large, (small["bucket"] == large["bucket"]) & meets).select(
        F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _release(spark) -> None:
    """Lets Spark drop the shuffle files of plans whose results are stored."""
    gc.collect()
    spark._jvm.System.gc()


def _crowded(members: DataFrame) -> DataFrame:
    """``bucket, node, leader`` of the buckets with several members."""
    crowded = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1").drop("n")
    return members.join(crowded, "bucket")


def _unsettled(members: DataFrame, named: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with their component, the bucket's largest one,
    its number of members and of pairs across components."""
    own = members.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = own.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    open_buckets = sizes.groupBy("bucket").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("square"),
        F.max(F.struct("c", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    pairs = ((F.col("n") * F.col("n") - F.col("square")) / 2).alias("pairs")
    return materialise(own.join(open_buckets.select("bucket", "n", "main", pairs), "bucket"), "unsettled")


def _labelled(docs: DataFrame, bands: int, rows: int, listed: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, node`` of every row, and ``node, exact_id, copies, component`` of every text with words."""
    marks = materialise(signed(docs, bands, rows), "signed")
    texts = materialise(marks.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("exact_id"), F.count("*").alias("copies"), F.min("bands").alias("bands")), "texts")
    members = texts.select("node", F.explode("bands").alias("bucket"))
    candidates = materialise(_crowded(members), "candidates")
    elements = materialise(shingle_table(docs, candidates.select("node").distinct().join(
        texts.select("node", F.col("exact_id").alias("doc_id")), "node")), "shingles")
    none = marks.sparkSession.createDataFrame([], "a binary, b binary, distance double, linked boolean")
    done = none
    _release(marks.sparkSession)

    def compare(pairs: DataFrame) -> bool:
        """Compares new pairs; whether any of them is linked."""
        nonlocal done
        new = materialise(compared(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(
            done, ["a", "b"], "left_anti"), elements), "new")
        if new.isEmpty():
            return False
        done = materialise(done.unionByName(new), "compared")
        _release(marks.sparkSession)
        return not new.where("linked").isEmpty()

    def join_links() -> DataFrame:
        found = components(done.where("linked").select("a", "b"))
        return materialise(found.coalesce(max(1, -(-found.count() // FILE_ROWS))), "named")

    def other_leaders(members: DataFrame, named: DataFrame) -> DataFrame:
        """Components after the members outside a bucket's largest one have met leaders from it."""
        for turn in range(TURNS):
            # Buckets of one component mostly agree on its leader, so a text meets a few new ones a turn.
            rest = _unsettled(members, named)
            best = F.min(F.when(F.col("component") == F.col("main"), F.struct(
                F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("leader"))))
            leaders = rest.groupBy("bucket").agg(best.alias("s")).select("bucket", "s.leader")
            if not compare(rest.where("component <> main").join(leaders, "bucket").select(
                    F.col("node").alias("a"), F.col("leader").alias("b"))):
                break
            named = join_links()
        return named

    def across(rest: DataFrame, members: DataFrame) -> None:
        """Compares the members of different components that distances to a leader do not rule out."""
        shared = members.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))
        rest = materialise(rest.select("bucket", "node", "component", "distance").join(
            rest.select("node").distinct().join(shared, "node"), "node"), "listed")
        left = rest.select("bucket", *[F.col(c).alias(f"{c}_a") for c in ("node", "component", "distance", "buckets")])
        right = rest.select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("node", "component", "distance", "buckets")])
        near = F.abs(F.col("distance_a") - F.col("distance_b")) <= 1 - SIMILAR + 1e-9
        # Two texts may share many buckets; the first of them names the pair.
        first = F.col("bucket") == F.array_min(F.array_intersect("buckets_a", "buckets_b"))
        compare(left.join(right, "bucket").where((F.col("component_a") < F.col("component_b")) & near & first).select(
            F.col("node_a").alias("a"), F.col("node_b").alias("b")))

    compare(candidates.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")))
    # The distance to the leader bounds that of two members from below, as it is a metric.
    known = done.select(F.col("a").alias("low"), F.col("b").alias("high"), "distance")
    members = materialise(candidates.withColumns(
        {"low": F.least("node", "leader"), "high": F.greatest("node", "leader")}).join(
        known, ["low", "high"], "left").select("bucket", "node", F.coalesce("distance", F.lit(0.0)).alias("distance")), "measured")
    named = other_leaders(members, join_links())
    rest = _unsettled(members, named)
    few = F.col("pairs") <= listed * F.col("n")
    # A pair whose first common bucket is crowded is left to the prefixes.
    many = materialise(rest.where(~few).select("node").distinct(), "many")
    across(rest.where(few), members)
    if not many.isEmpty():
        named = join_links()
        placed = materialise(_placed(many, elements), "placed")
        members = materialise(_crowded(placed.select("bucket", "node")).select(
            "bucket", "node", F.lit(0.0).alias("distance")), "prefixes")
        named = other_leaders(members, named)
        compare(_possible(placed, named))
    named = join_links()
    label = materialise(texts.select("node", "exact_id", "copies").join(named, "node", "left").withColumn(
        "component", F.coalesce("component", "node")), "labelled")
    return marks.select("doc_id", "node"), label


def groups(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, listed: int = LISTED) -> DataFrame:
    """``doc_id, exact_id, group_id, copies`` for every row of ``docs(doc_id, text)``.

    ``group_id`` is the smallest id of all texts that links join to the row's text, and
    ``exact_id`` the smallest of those with the same lower-cased words, of which there are
    ``copies``. Texts without words, null ones too, equal nothing: their ids stand for
    themselves. Null ids are never the smallest; a group of null ids only has a null id.
    """
    marks, label = _labelled(docs, bands, rows, listed)
    first = label.groupBy("component").agg(F.min("exact_id").alias("group_id"))
    label = materialise(label.join(first, "component").select("node", "exact_id", "group_id", "copies"), "groups")
    with_words = marks.where("node IS NOT NULL").select("doc_id", "node").join(label, "node").drop("node")
    without = marks.where("node IS NULL").select(
        "doc_id", F.col("doc_id").alias("exact_id"), F.col("doc_id").alias("group_id"), F.lit(1).cast("bigint").alias("copies"))
    return with_words.select("doc_id", "exact_id", "group_id", "copies").unionByName(without)


def deduplicate(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, listed: int = LISTED) -> DataFrame:
    """One row of each group of ``groups``, with all columns; that with the smallest id, null ids last.

    Rows without words are kept. Of repeated rows one stays. Columns may have any names.
    """
    docs, back = set_aside(docs, "_node", "_id")
    marks, label = _labelled(docs, bands, rows, listed)
    best = F.min(F.struct(F.col("exact_id").isNull().alias("none"), "exact_id", "node"))
    kept = materialise(label.groupBy("component").agg(best.alias("s")).select(
        F.col("s.node").alias("_node"), F.col("s.exact_id").alias("_id")), "kept")
    schema = StructType([*docs.schema.fields, StructField("_node", BinaryType())])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, "text"):
            found = words(*buffer_of(batch.column("text")))
            counts = np.bincount(found.docs, minlength=batch.num_rows)
            node = _binary(np.stack(fingerprints(found, batch.num_rows), axis=1), counts == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, node], schema.names)

    named = docs.mapInArrow(name, schema)
    # The id is a key of the join too, so the copies of one text spread over the tasks.
    found = named.where("_node IS NOT NULL").join(
        kept, (named["_node"] == kept["_node"]) & named["doc_id"].eqNullSafe(kept["_id"]), "left_semi")
    repeated = marks.where("node IS NOT NULL").groupBy("node", "doc_id").count().where("count > 1")
    if not repeated.isEmpty():
        found = found.dropDuplicates(["_node"])
    return found.unionByName(named.where("_node IS NULL")).drop("_node").withColumnsRenamed(back)

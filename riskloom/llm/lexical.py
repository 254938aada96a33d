"""Ranked lexical search by a document FP-tree with branch-and-bound.

Every document is restricted to the terms that any item asks for, and its terms are ordered
by document frequency, most frequent first. Blocks of documents sorted by these sequences are
tries: documents with a common beginning share a path. Each subtree knows the largest
frequency of every term in it and the smallest ``m`` (length normalisation), so the score of
the best imaginable document bounds all its documents. A depth-first walk goes on, for each
item, only into subtrees whose bound reaches the item's k-th best score so far, and scores
documents exactly where few are left. A task keeps one list of best documents per item over
all its blocks, so later blocks start with a high bar and a task returns at most k rows an
item.

All numbers are integers and sums stay far below 2**53, or else are summed as 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import dataset
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from riskloom.llm.common import buffer_of, in_parts, only, terms
from riskloom.plans.lineage import file_system, materialise, scratch_path

#: Best documents of an item (fixed value of the registered query).
TOP = 20
#: Pairs of item and term that one pass over the documents serves, and that a walk serves at once.
PASS_PAIRS, WALK_PAIRS = 1 << 20, 4096
#: Documents and term entries of one trie, and documents that are scored without a further look at bounds.
TREE_DOCS, TREE_ENTRIES, FEW_DOCS = 8192, 1 << 21, 32
#: Scored candidates that wait before they are merged into the lists of the best.
WAITING = 1 << 14


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds: grows with ``tf``, falls with ``m``."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _load(path: str) -> pa.Table:
    fs, folder = file_system(path)
    return dataset.dataset(folder, filesystem=fs, format="parquet", exclude_invalid_files=False).to_table()


def _stored(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term, repeats`` of ``items(item_id, text)``; a term is its hash.

    Rows without an id or text ask nothing; of rows with one id the smallest text counts.
    """
    one = only(items, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(
        F.min("text").alias("text"))
    schema = StructType([one.schema["item_id"], StructField("term", LongType()), StructField("repeats", LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, "text"):
            found = terms(*buffer_of(batch.column("text")))
            pairs, counts = np.unique(np.c_[found.docs.view(np.uint64), found.hashes], axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([
                batch.column("item_id").take(pa.array(pairs[:, 0].astype(np.int64))),
                pa.array(pairs[:, 1].view(np.int64)), pa.array(counts)], schema.names)

    return one.mapInArrow(cut, schema)


def restricted(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document with a term: its length, and its terms of the stored vocabulary.

    ``terms`` are places in the vocabulary sorted by hash, ascending.
    """
    slim = only(docs, "doc_id", "text")
    schema = StructType([slim.schema["doc_id"], StructField("n", LongType()),
                         StructField("terms", ArrayType(IntegerType())), StructField("tfs", ArrayType(IntegerType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in in_parts(batches, "text"):
            if known is None:
                known = np.unique(_load(vocabulary).column("term").to_numpy())
            found = terms(*buffer_of(batch.column("text")))
            n = np.bincount(found.docs, minlength=batch.num_rows)
            place = np.searchsorted(known, found.hashes.view(np.int64))
            place[place == len(known)] = 0
            asked = known[place] == found.hashes.view(np.int64)
            pairs, tfs = np.unique(found.docs[asked] * len(known) + place[asked], return_counts=True)
            bounds = pa.array(np.searchsorted(pairs // len(known), np.arange(batch.num_rows + 1)).astype(np.int32))
            out = pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n),
                pa.ListArray.from_arrays(bounds, pa.array((pairs % len(known)).astype(np.int32))),
                pa.ListArray.from_arrays(bounds, pa.array(tfs.astype(np.int32)))], schema.names)
            yield out.filter(pa.array(n > 0))

    return slim.mapInArrow(cut, schema)


def document_frequencies(vectors: DataFrame) -> DataFrame:
    """``place, df``, summed up in every task before the exchange."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(batch.column("terms").flatten().to_numpy())
            total, own = (total, own) if len(total) >= len(own) else (own.astype(np.int64), total)
            total[:len(own)] += own
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(total[place])], ["place", "n"])

    return vectors.select("terms").mapInArrow(count, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("df"))


@dataclass
class Node:
    """A subtree of documents ``first`` to ``last``, in the order of the trie."""

    first: int
    last: int
    children: list["Node"] = field(default_factory=list)
    number: int = -1


def trie(sequences: list[bytes], few: int) -> tuple[np.ndarray, Node]:
    """The order of documents in the trie of their term sequences, and its root.

    ``sequences`` hold four big-endian bytes a term. A branch with more than half of its
    parent's documents is opened in place, so the tree is about log(documents) deep however
    long common paths are; neighbouring branches of at most ``few`` documents are one node.
    """
    order = np.array(sorted(range(len(sequences)), key=sequences.__getitem__), np.int64)
    shared = np.zeros(len(order), np.int64)
    for i in range(1, len(order)):
        a, b = sequences[order[i - 1]], sequences[order[i]]
        n = min(len(a), len(b))
        x, y = np.frombuffer(a, ">u4", n // 4), np.frombuffer(b, ">u4", n // 4)
        differ = x != y
        at = int(differ.argmax()) if n else 0
        shared[i] = at if n and differ[at] else n // 4

    def branches(first: int, last: int) -> list[tuple[int, int]]:
        out, largest = [], (first, last)
        while largest:
            a, b = largest
            inner = shared[a + 1:b]
            cuts = np.r_[a, np.flatnonzero(inner == inner.min()) + a + 1, b].tolist()
            largest, own = None, list(zip(cuts, cuts[1:]))
            for x, y in own:
                if y - x > few and 2 * (y - x) > last - first:
                    largest = (x, y)
                else:
                    out.append((x, y))
        return sorted(out)

    root = Node(0, len(order))
    todo = [root]
    while todo:
        node = todo.pop()
        if node.last - node.first <= few:
            continue
        for a, b in branches(node.first, node.last):
            before = node.children[-1] if node.children else None
            if before and before.last == a and b - before.first <= few:
                before.last = b
            else:
                node.children.append(Node(a, b))
        todo += node.children
    return order, root


def _numbered(root: Node) -> list[Node]:
    """All nodes with their numbers set: parents before children, children of one node in a row."""
    nodes, root.number = [root], 0
    for node in nodes:
        for child in node.children:
            child.number = len(nodes)
            nodes.append(child)
    return nodes


class Best:
    """The ``k`` best documents of every item so far: highest scores, ties to smaller ids."""

    def __init__(self, items: int, k: int):
        self.k, self.items = k, np.zeros(0, np.int64)
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.zeros(items, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, items: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        good = (scores > 0) & (scores >= self.floor[items])
        self.waiting.append((items[good], ids[good], scores[good]))
        self.count += int(good.sum())
        if self.count > WAITING:
            self.merge()

    def merge(self) -> None:
        items, ids, scores = (np.concatenate(x) for x in zip((self.items, self.ids, self.scores), *self.waiting))
        order = np.lexsort((ids, -scores, items))
        items, ids, scores = items[order], ids[order], scores[order]
        place = np.arange(len(items)) - np.searchsorted(items, items)
        keep = place < self.k
        self.items, self.ids, self.scores = items[keep], ids[keep], scores[keep]
        full = place == self.k - 1
        self.floor[items[full]] = scores[full]
        self.waiting, self.count = [], 0


@dataclass
class Asked:
    """Items that walk together: their numbers, their terms, and weight times repeats of each term and item."""

    items: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


def asked_groups(items: np.ndarray, places: np.ndarray, repeats: np.ndarray, weight: np.ndarray,
                 pairs: int = WALK_PAIRS) -> list[Asked]:
    """Groups of whole items with about ``pairs`` pairs of item and term; ``items`` are sorted numbers."""
    bounds = np.flatnonzero(np.r_[True, items[1:] != items[:-1]]) if len(items) else np.zeros(0, np.int64)
    ends, out, i = np.r_[bounds[1:], len(items)], [], 0
    while i < len(bounds):
        j = max(i + 1, int(np.searchsorted(ends, bounds[i] + pairs, "right")))
        a, b = bounds[i], ends[j - 1]
        own, item = np.unique(items[a:b], return_inverse=True)
        used, term = np.unique(places[a:b], return_inverse=True)
        value = weight[places[a:b]] * repeats[a:b]
        exact = np.bincount(item, value.astype(float)).max() * 1e6 < 2**53
        weights = np.zeros((len(used), len(own)), np.float64 if exact else np.int64)
        weights[term, item] = value
        out.append(Asked(own, used, weights))
        i = j
    return out


def walk(ids: np.ndarray, m: np.ndarray, starts: np.ndarray, places: np.ndarray, tfs: np.ndarray, rank: np.ndarray,
         groups: list[Asked], best: Best, few: int) -> int:
    """Adds one block of documents to ``best`` and returns how many it scored for some item.

    ``starts`` are where the terms of each document begin in ``places`` and ``tfs``; ``rank``
    is the place of each term in the order by document frequency.
    """
    owner = np.repeat(np.arange(len(ids)), np.diff(starts))
    by_rank = np.lexsort((rank[places], owner))
    places, tfs = places[by_rank], tfs[by_rank].astype(np.int64)
    raw = rank[places].astype(">u4").tobytes()
    order, root = trie([raw[4 * a:4 * b] for a, b in zip(starts, starts[1:])], few)
    nodes = _numbered(root)
    # Everything in the order of the trie.
    counts = np.diff(starts)[order]
    begins = np.r_[0, np.cumsum(counts)]
    at = np.repeat(starts[:-1][order] - begins[:-1], counts) + np.arange(begins[-1])
    places, tfs, ids, m = places[at], tfs[at], ids[order], m[order]
    owner = np.repeat(np.arange(len(ids)), counts)
    least = np.array([m[n.first:n.last].min() for n in nodes])
    leaf = np.zeros(len(ids), np.int64)
    for n in nodes:
        if not n.children:
            leaf[n.first:n.last] = n.number
    scored = 0
    for group in groups:
        own = np.full(len(rank), -1, np.int64)
        own[group.terms] = np.arange(len(group.terms))
        column = own[places]
        most = np.zeros((len(nodes), len(group.terms)), np.int32)
        here = column >= 0
        np.maximum.at(most, (leaf[owner[here]], column[here]), tfs[here].astype(np.int32))
        for n in reversed(nodes):
            if n.children:
                most[n.number] = most[n.children[0].number:n.children[-1].number + 1].max(axis=0)
        stack = [(root, np.arange(len(group.items)))]
        while stack:
            node, active = stack.pop()
            terms_here = np.flatnonzero(most[node.number])
            bound = impact(most[node.number, terms_here].astype(np.int64), least[node.number])
            weights = group.weights[np.ix_(terms_here, active)]
            bound = bound.astype(weights.dtype) @ weights
            active = active[(bound > 0) & (bound >= best.floor[group.items[active]])]
            if not len(active):
                continue
            if node.children:
                # The branch with the shortest documents, which score most, comes off the stack first.
                stack += [(c, active) for c in sorted(node.children, key=lambda c: -least[c.number])]
                continue
            a, b = begins[node.first], begins[node.last]
            some = np.flatnonzero(here[a:b]) + a
            dense = np.zeros((node.last - node.first, len(group.terms)), np.int64)
            dense[owner[some] - node.first, column[some]] = impact(tfs[some], m[owner[some]])
            scores = dense[:, terms_here].astype(weights.dtype) @ group.weights[np.ix_(terms_here, active)]
            doc, item = np.nonzero(scores > 0)
            best.add(group.items[active[item]], ids[node.first + doc], scores[doc, item].astype(np.int64))
            scored += node.last - node.first
    return scored


def _one_pass(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Best documents of the items in ``asked``, whose terms fit in a task."""
    item_type = asked.schema["item_id"]
    wanted = _stored(asked, "items")
    vectors = materialise(restricted(docs, wanted), "vectors")
    n, length = vectors.agg(F.count("*"), F.sum("n")).first()
    frequencies = _stored(document_frequencies(vectors), "frequencies")
    schema = StructType([item_type, StructField("doc_id", LongType()), StructField("score", LongType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if best is None:
                pairs, counted = _load(wanted), _load(frequencies)
                known = np.unique(pairs.column("term").to_numpy())
                df = np.zeros(len(known), np.int64)
                df[counted.column("place").to_numpy()] = counted.column("df").to_numpy()
                weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
                rank = np.empty(len(known), np.int64)
                rank[np.lexsort((np.arange(len(known)), -df))] = np.arange(len(known))
                names = pairs.column("item_id").combine_chunks().dictionary_encode()
                names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
                item = names.indices.to_numpy().astype(np.int64)
                order = np.argsort(item, kind="stable")
                groups = asked_groups(item[order], np.searchsorted(known, pairs.column("term").to_numpy())[order],
                                      pairs.column("repeats").to_numpy()[order], weight)
                best = Best(len(names.dictionary), k)
            starts = np.r_[0, np.cumsum(batch.column("terms").value_lengths().to_numpy())]
            places, tfs = (batch.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
            ids = batch.column("doc_id").to_numpy().astype(np.int64)
            m = 75 + (25 * batch.column("n").to_numpy() * n) // length
            usable = np.flatnonzero(np.diff(starts) > 0)
            while len(usable):
                many = max(1, int(np.searchsorted(starts[usable + 1], starts[usable[0]] + TREE_ENTRIES, "right")))
                part, usable = usable[:min(many, TREE_DOCS)], usable[min(many, TREE_DOCS):]
                counts = np.diff(starts)[part]
                own = np.r_[0, np.cumsum(counts)]
                at = np.repeat(starts[part] - own[:-1], counts) + np.arange(own[-1])
                walk(ids[part], m[part], own, places[at], tfs[at], rank, groups, best, FEW_DOCS)
        if best is not None:
            best.merge()
            yield pa.RecordBatch.from_arrays([
                names.dictionary.take(pa.array(best.items)), pa.array(best.ids), pa.array(best.scores)], schema.names)

    return vectors.where("doc_id IS NOT NULL").mapInArrow(search, schema)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best of ``docs(doc_id, text)`` for each of ``items(item_id, text)``.

    The weight of a term is ``floor(1000 * ln((2N + 2) / (2df + 1)))``, ``m`` of a document
    ``75 + (25 * n * N) div L``, and its score the sum over the item's terms, repeats
    included, of weight times ``(10^9 * tf) div (1000 * tf + 12 * m)``. Only scores above 0
    count; equal scores are ranked by id.

    Null and empty texts have no terms; such documents do not count in N, and such items
    find nothing. Documents without an id count in all statistics but are not found, as they
    cannot be named; items without an id ask nothing, and of items with one id the smallest
    text counts. Repeated rows are documents of their own. Other columns are ignored. Empty
    tables give an empty result.
    """
    pairs = materialise(item_terms(items), "pairs")
    passes, found = -(-pairs.count() // PASS_PAIRS), None
    if not passes:
        kind = pairs.schema["item_id"].dataType.simpleString()
        return pairs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for i in range(passes):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i) if passes > 1 else pairs
        part = _one_pass(docs, own, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score")

"""Conflict-constrained best-fit packing of documents into bins of fixed length.

A document longer than a bin is cut: every full piece has a bin of its own and the rest is
packed. Pieces are taken from long to short. A bin carries the sources and the duplicate
clusters of its pieces as a bitmap and takes no second piece of either. Open bins are
ordered by what they have left; the search starts at the least room that is enough and
goes on to the next until a compatible bin is found. Every node of the search tree knows
which bits all bins below it share, so whole stretches that conflict are passed over.

Pieces are dealt to packs of bounded size, which are packed apart from each other.
"""

from __future__ import annotations

from collections import Counter, deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from riskloom.llm.common import buffer_of, fingerprints, in_parts, only, words
from riskloom.plans.lineage import materialise

#: Words of a bin, and documents of a pack on average.
CAPACITY, PACK_ROWS = 2_048, 8_192


class Bins:
    """Open bins by room left, in a search tree over all possible rooms."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        #: Bits that all bins below a node share; -1, all bits, where there is no bin.
        self.shared = [-1] * (2 * self.leaves)
        #: Bins with the same room and bitmap are alike: ``bitmap -> bins``, oldest first.
        self.at: dict[int, dict[int, deque[int]]] = {}

    def _update(self, room: int) -> None:
        common = -1
        for bits in self.at.get(room, ()):
            common &= bits
        node = room + self.leaves
        self.shared[node] = common
        while node > 1:
            node >>= 1
            common = self.shared[2 * node] & self.shared[2 * node + 1]
            if self.shared[node] == common:
                return
            self.shared[node] = common

    def put(self, room: int, bits: int, bin_number: int) -> None:
        self.at.setdefault(room, {}).setdefault(bits, deque()).append(bin_number)
        self._update(room)

    def take(self, size: int, bits: int) -> tuple[int, int, int] | None:
        """Removes the tightest bin with room for ``size`` and none of ``bits``; its room, bitmap and number."""
        node = size + self.leaves
        while True:
            # Down to the first leaf below this node whose bins may be compatible.
            while node < self.leaves and not self.shared[node] & bits:
                node = 2 * node if not self.shared[2 * node] & bits else 2 * node + 1
            if node >= self.leaves and not self.shared[node] & bits:
                room = node - self.leaves
                found = next((b for b in self.at[room] if not b & bits), None)
                if found is not None:
                    numbers = self.at[room][found]
                    number = numbers.popleft()
                    if not numbers:
                        del self.at[room][found]
                    self._update(room)
                    return room, found, number
            # On to the next stretch on the right.
            while node & 1:
                node >>= 1
            if node == 0:
                return None
            node += 1


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of every piece of 1 to ``capacity`` words, given from long to short.

    Null clusters conflict with nothing; null is a source like any other.
    """
    source_bit = {s: i for i, (s, _) in enumerate(Counter(sources).most_common())}
    shared = [c for c, n in Counter(c for c in clusters if c is not None).most_common() if n > 1]
    cluster_bit = {c: len(source_bit) + i for i, c in enumerate(shared)}
    bins, opened, out = Bins(capacity), 0, []
    for size, source, cluster in zip(sizes, sources, clusters):
        bits = 1 << source_bit[source] | (1 << cluster_bit[cluster] if cluster in cluster_bit else 0)
        found = bins.take(size, bits)
        if found is None:
            found, opened = (capacity, 0, opened), opened + 1
        room, carried, number = found
        out.append((number, capacity - room))
        bins.put(room - size, carried | bits, number)
    return out


def pack(rows: DataFrame, capacity: int = CAPACITY, pack_rows: int = PACK_ROWS) -> DataFrame:
    """A row per piece of ``rows(doc_id, source, cluster, size)``.

    Returns ``doc_id, piece, start, words, bin, offset, whole_bin``: words ``start`` to ``start +
    words`` of the document stand at ``offset`` of ``bin``. A document without words has one
    row without a bin. Repeated rows are packed like different documents that share a
    cluster, if they have one. Null sizes count as 0; empty input gives no rows.
    """
    stored = materialise(rows.select(
        "doc_id", "source", "cluster", F.coalesce(F.col("size"), F.lit(0)).cast("bigint").alias("size")), "to_pack")
    packs = max(1, -(-stored.where("size > 0").count() // pack_rows))
    doc_type = stored.schema["doc_id"].dataType
    schema = StructType([
        StructField("doc_id", doc_type), StructField("piece", LongType()), StructField("start", LongType()),
        StructField("words", LongType()), StructField("bin", LongType()), StructField("offset", LongType()),
        StructField("whole_bin", BooleanType())])

    def one(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["pack"].iloc[0]) << 32
        group = group.assign(rest=group["size"] % capacity).sort_values(
            ["rest", "row"], ascending=[False, True], kind="stable")
        some = group[group["rest"] > 0]
        none = lambda values: [None if pd.isna(v) else v for v in values]
        places = best_fit(some["rest"].tolist(), none(some["source"]), none(some["cluster"]), capacity)
        out = [(d, s // capacity, s - r, r, number + b, o, False) for d, s, r, (b, o) in
               zip(none(some["doc_id"]), some["size"], some["rest"], places)]
        used = max((b for b, _ in places), default=-1) + 1
        for d, s in zip(none(group["doc_id"]), group["size"]):
            for piece in range(s // capacity):
                out.append((d, piece, piece * capacity, capacity, number + used, 0, True))
                used += 1
        frame = pd.DataFrame(out, columns=schema.names)
        frame["doc_id"] = frame["doc_id"].astype("Int64") if isinstance(doc_type, LongType) else frame["doc_id"]
        return frame

    # Dealt by place in the stored table, so repeated rows and ids spread as well.
    dealt = stored.where("size > 0").withColumn("row", F.monotonically_increasing_id()).withColumn(
        "pack", F.pmod(F.xxhash64("row"), F.lit(packs)))
    empty = stored.where("size = 0").select(
        "doc_id", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("start"),
        F.lit(0).cast("bigint").alias("words"), F.lit(None).cast("bigint").alias("bin"),
        F.lit(None).cast("bigint").alias("offset"), F.lit(False).alias("whole_bin"))
    return dealt.groupBy("pack").applyInPandas(one, schema).unionByName(empty)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, source, cluster, size`` of ``docs(doc_id, text, source)``.

    The cluster of a document is a hash of its lower-cased words, so copies share it; a
    document without words has none.
    """
    rows = only(docs, "doc_id", "source", "text")
    schema = StructType([rows.schema["doc_id"], rows.schema["source"], StructField("cluster", LongType()),
                         StructField("size", LongType())])

    def measure(batches):
        for batch in in_parts(batches, "text"):
            buffer, offsets = buffer_of(batch.column("text"))
            found = words(buffer, offsets)
            size = np.bincount(found.docs, minlength=batch.num_rows)
            cluster = fingerprints(found, batch.num_rows)[0].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(cluster, mask=size == 0), pa.array(size)],
                schema.names)

    return rows.mapInArrow(measure, schema)

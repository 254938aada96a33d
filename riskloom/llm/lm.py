"""Language-model scores from a weighted backoff automaton.

States are the n-grams seen in training that can be a history; a state has an arc for every
word seen after it, weighted with the smoothed log probability, and one failure arc to the
state of its history without the first word, weighted with what smoothing leaves to unseen
words. A text is scored in one pass from left to right: while the state has no arc for the
next word the failure arc is followed, then the arc, and all weights are summed up.

Smoothing gives a history h of count c(h) the probabilities
``p(w | h) = (c(h w) + K * p(w | shorter h)) / (c(h) + K)``, a proper distribution at every
order, down to the add-one unigram model of known words and one unknown word.

The counts never come together in one place. Texts are cut into blocks; each block asks for
the counts of its own distinct n-grams, and brings those of its training texts along, as
sorted arrays per range of hashes. Spark shuffles the arrays by range, each range is summed
up and answered in the same order, and the answers are shuffled back to the blocks, which
build the part of the automaton that their texts can reach. So what is gathered grows with
the corpus, and a task holds one range or one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from riskloom.llm.common import buffer_of, in_parts, mix, only, words
from riskloom.plans.lineage import materialise

#: Length of the longest n-gram.
ORDER = 2
#: Counts that the shorter history's distribution is worth.
STRENGTH = 200.0
#: Bytes of text of a block, and of all texts per range of hashes and order.
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 32 << 20
#: Stands for the end of a text, and before its first word.
END = np.uint64(0xE7037ED1A0B428DB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, each text followed by the end; where each text begins."""
    buffer, offsets = buffer_of(texts)
    found = words(buffer, offsets)
    counts = np.bincount(found.docs, minlength=len(texts))
    starts = np.r_[0, np.cumsum(counts + 1)]
    out = np.full(starts[-1], END, np.uint64)
    place = np.arange(len(found.docs)) + found.docs
    out[place] = found.hashes
    return out, starts


def grams(stream: np.ndarray, starts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length the distinct n-grams, sorted, and the number of the one that ends at each token.

    Before its first word a text has the end mark once; an n-gram that would begin before
    that has number -1.
    """
    place = np.arange(len(stream)) - np.repeat(starts[:-1], np.diff(starts))
    out = []
    for n in range(1, order + 1):
        usable = place >= n - 2 if n > 1 else np.ones(len(stream), bool)
        key = np.zeros(len(stream), np.uint64)
        at = np.flatnonzero(usable)
        for back in range(n - 1, -1, -1):
            before = at - back
            word = np.where(place[at] >= back, stream[np.maximum(before, 0)], END)
            key[at] = word if n == 1 else mix(key[at] * _STEP + word)
        codes, values = pd.factorize(key[at])
        by_key = np.argsort(values)
        rank = np.empty(len(values), np.int64)
        rank[by_key] = np.arange(len(values))
        number = np.full(len(stream), -1, np.int64)
        number[at] = rank[codes]
        out.append((values[by_key], number))
    return out


def _packed(values: np.ndarray) -> bytes:
    """Counts with their width in the first byte; most blocks need four bytes a count."""
    kind = np.uint32 if values.max(initial=0) < 1 << 32 else np.uint64
    return bytes([kind().itemsize]) + values.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint32 if data[0] == 4 else np.uint64, offset=1).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Blocks of the task's texts with numbers that a second pass over the same input gives again."""
    task = TaskContext.get().partitionId()
    for i, batch in enumerate(in_parts(batches, "text", BLOCK_BYTES)):
        yield (task << 32) + i, batch


def requests(texts: DataFrame, order: int, ranges: int) -> DataFrame:
    """``block, part, length, keys, counts``: what each block asks, with its training counts."""
    shift = np.uint64(64 - int(math.log2(ranges)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in _blocks(batches):
            stream, starts = tokens(batch.column("text"))
            held = batch.column("held_out").fill_null(False).to_numpy(zero_copy_only=False)
            learnt = np.repeat(~held, np.diff(starts))
            rows = []
            for length, (keys, number) in enumerate(grams(stream, starts, order), 1):
                counts = np.bincount(number[learnt & (number >= 0)], minlength=len(keys))
                part = (keys >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(keys), np.int64)
                bounds = np.searchsorted(part, np.arange(ranges + 1))
                rows += [(block, p, length, keys[a:b].tobytes(), _packed(counts[a:b]))
                         for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if a < b]
            yield pa.RecordBatch.from_pydict(
                dict(zip(("block", "part", "length", "keys", "counts"), map(list, zip(*rows)))),
                pa.schema([("block", pa.int64()), ("part", pa.int32()), ("length", pa.int32()),
                           ("keys", pa.binary()), ("counts", pa.binary())]))

    return texts.mapInArrow(ask, "block bigint, part int, length int, keys binary, counts binary")


def answers(asked: DataFrame) -> DataFrame:
    """``block, part, length, totals, n_tokens, n_words`` for every request; sums over all blocks.

    The last two have the training tokens and distinct training words of a range, once per range.
    """
    def total(rows: pa.Table) -> pa.Table:
        out = []
        for length in sorted(set(rows.column("length").to_pylist())):
            own = rows.filter(pc.equal(rows.column("length"), length))
            keys = [np.frombuffer(k, np.uint64) for k in own.column("keys").to_pylist()]
            counts = [_unpacked(c) for c in own.column("counts").to_pylist()]
            sizes = np.array([len(k) for k in keys])
            codes, values = pd.factorize(np.concatenate(keys))
            sums = np.bincount(codes, np.concatenate(counts), len(values)).astype(np.int64)
            each = np.split(sums[codes], np.cumsum(sizes)[:-1])
            once = (int(sums.sum()), int((sums > 0).sum())) if length == 1 else (0, 0)
            for i, (block, part) in enumerate(zip(own.column("block").to_pylist(), own.column("part").to_pylist())):
                out.append((block, part, length, _packed(each[i]), *(once if i == 0 else (0, 0))))
        return pa.Table.from_pydict(
            dict(zip(("block", "part", "length", "totals", "n_tokens", "n_words"), map(list, zip(*out)))),
            pa.schema([("block", pa.int64()), ("part", pa.int32()), ("length", pa.int32()), ("totals", pa.binary()),
                       ("n_tokens", pa.int64()), ("n_words", pa.int64())]))

    return asked.groupBy("part").applyInArrow(
        total, "block bigint, part int, length int, totals binary, n_tokens bigint, n_words bigint")


class Automaton:
    """The part of the automaton that a block can reach.

    Arcs and failure arcs are arrays per length of the state's history, found by the token
    that a traversal stands at, so no table of states is searched.
    """

    def __init__(self, stream: np.ndarray, starts: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]],
                 totals: list[np.ndarray], n_tokens: int, n_words: int, strength: float = STRENGTH):
        self.starts, self.longest = starts, len(found) - 1
        # How often the n-gram of each length that ends at a token occurs in training.
        seen = [np.where(number >= 0, np.r_[total, 0][number], 0) for (_, number), total in zip(found, totals)]
        ends = np.flatnonzero(stream == END)
        start_count = seen[0][ends[0]] if len(ends) else 0
        first = np.zeros(len(stream), bool)
        first[starts[:-1]] = True
        chance = (seen[0] + 1.0) / (n_tokens + n_words + 1.0)
        self.base, self.known = np.log10(chance), seen[0] > 0
        #: By length of the history: whether the state has an arc for the token, its weight, and the failure arc's.
        self.has, self.arc, self.fail = [np.ones(len(stream), bool)], [np.log10(chance)], [np.zeros(len(stream))]
        for length in range(1, len(found)):
            history = np.r_[0, seen[length - 1][:-1]]
            # One token into a text the history is the mark before it; longer ones do not exist there.
            history = np.where(first, start_count if length == 1 else 0, history)
            has = (seen[length] > 0) & (history > 0)
            chance = np.where(history > 0, (seen[length] + strength * chance) / (history + strength), chance)
            self.has.append(has)
            self.arc.append(np.log10(chance))
            self.fail.append(np.log10(strength / (history + strength)))
        self.start = 1 if self.longest >= 1 and start_count > 0 else 0

    def score(self, text: int) -> float:
        """One traversal over a text of the block."""
        a, b = self.starts[text], self.starts[text + 1]
        has, arc, fail = ([x[a:b].tolist() for x in xs] for xs in (self.has, self.arc, self.fail))
        known, longest = self.known[a:b].tolist(), self.longest
        state, total = self.start, 0.0
        for i in range(b - a):
            while not has[state][i]:
                total += fail[state][i]
                state -= 1
            total += arc[state][i]
            # The history grows by the word that was read; an unknown word leads to the root.
            state = min(state + 1, longest) if known[i] else 0
        return total


def score(docs: DataFrame, order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """Scores for every row of ``docs(doc_id, text, held_out)``; rows that are not held out are learnt from.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. A null text
    is empty and consists of its end; a null ``held_out`` is false; repeated rows are counted
    and scored each. Without training texts every probability is 1. ``docs`` is read twice
    and must give the same rows in the same order to the same tasks, as stored tables do; a
    difference is an error.
    """
    texts = only(docs, "doc_id", "text", "held_out")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << max(0, math.ceil(math.log2(max(size * order / RANGE_BYTES, 1))))
    replies = materialise(answers(requests(texts, order, ranges)), "counts")
    n_tokens, n_words = (int(x or 0) for x in replies.agg(F.sum("n_tokens"), F.sum("n_words")).first())
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in _blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_pydict(
                {"block": [block], "part": [-1], "length": [0], "totals": [sink.getvalue().to_pybytes()]},
                pa.schema([("block", pa.int64()), ("part", pa.int32()), ("length", pa.int32()), ("totals", pa.binary())]))

    sent = texts.mapInArrow(send, "block bigint, part int, length int, totals binary")

    def finish(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "ascending"), ("part", "ascending")])
        lengths, data = rows.column("length").to_pylist(), rows.column("totals").to_pylist()
        if lengths[:2].count(0) != 1:
            raise ValueError("the input changed between two reads; store it before scoring")
        batch = pa.ipc.open_stream(data[0]).read_all().combine_chunks()
        column = batch.column("text").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        stream, starts = tokens(column)
        found = grams(stream, starts, order)
        # Ranges follow the order of the keys, so the answers stand in the order of the n-grams.
        totals = []
        for length, (keys, _) in enumerate(found, 1):
            wide = np.concatenate([_unpacked(p) for p, n in zip(data, lengths) if n == length] or [np.zeros(0, np.int64)])
            if len(wide) != len(keys):
                raise ValueError("the input changed between two reads; store it before scoring")
            totals.append(wide)
        automaton = Automaton(stream, starts, found, totals, n_tokens, n_words, strength)
        n = len(starts) - 1
        return pa.table({
            "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out").fill_null(False),
            "n_tokens": np.diff(starts), "n_known": np.add.reduceat(automaton.known.astype(np.int64), starts[:-1]),
            "train_tokens": np.full(n, n_tokens), "base_score": np.add.reduceat(automaton.base, starts[:-1]),
            "score": np.array([automaton.score(i) for i in range(n)])})

    return sent.unionByName(replies.select("block", "part", "length", "totals")).groupBy("block").applyInArrow(
        finish, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                "base_score double, score double")

"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained in numpy.

A word is the mean of the embeddings of its marked byte n-grams, hashed into one table, so
a misspelling or an unseen form shares most of its vectors with the words it stands for.
A passage is the mean of its distinct words, and a softmax layer reads that mean; table
and layer are trained together.

A mean over a whole long text would drown a few insults, so a text is read as overlapping
passages that cover all of it and is as toxic as its most toxic passage. As labels are per
text, training alternates between choosing the strongest passages of each text and
learning from them; every passage of a sampled text takes part. The last fifth of the sample is kept out of training and maps the
strongest passage's logit to the probability of the text.

Once trained, a passage's logit is a mean of one number per word, so scoring computes one
number for every distinct word of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pyspark.sql.types import DoubleType, StructType

from riskloom.llm.common import PIECE, buffer_of, in_parts, mix, only, pieces, running, words
from riskloom.plans.lineage import materialise

#: Most labelled rows of either class that a model is fitted on: those with the smallest hashes of their id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3_000, 5_000
#: Rows of the embedding table, and their width.
BUCKETS, SIZE = 1 << 18, 8
SHORTEST, LONGEST = 3, 6
#: Words in a passage; passages overlap by half.
PASSAGE = 60
#: Punctuation that does not count at either end of a word.
MARKS = np.zeros(256, bool)
MARKS[list(b".,;:!?\"'()[]{}|#*$%&<>")] = True


def _stripped(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds without punctuation at the ends; a word of punctuation alone keeps its last mark."""
    starts, ends = starts.copy(), ends.copy()
    while True:
        last = (ends - starts > 1) & MARKS[buffer[ends - 1]]
        ends -= last
        first = (ends - starts > 1) & MARKS[buffer[starts]]
        starts += first
        if not (last | first).any():
            return starts, ends


def subwords(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Buckets of the n-grams of the words at these bounds, some words at a time.

    Yields the number of the first word, the buckets of all its and its followers' n-grams,
    and how many each word has. A word's n-grams are those of ``<word>`` and ``<word>`` itself.
    """
    starts, ends = _stripped(buffer, starts, ends)
    offsets = np.r_[0, np.cumsum(ends - starts + 2)]
    for first, last in pieces(offsets, PIECE):
        size = int(offsets[last] - offsets[first])
        local = offsets[first:last + 1] - offsets[first]
        lengths = np.diff(local)
        marked = np.empty(size, np.uint8)
        inside = np.ones(size, bool)
        inside[local[:-1]] = False
        inside[local[1:] - 1] = False
        take = np.repeat(starts[first:last] - local[:-1] - 1, lengths) + np.arange(size)
        marked[inside] = buffer[take[inside]]
        marked[local[:-1]], marked[local[1:] - 1] = 60, 62
        total, back = running(marked)
        owner = np.repeat(np.arange(last - first), lengths)
        end = np.repeat(local[1:], lengths)
        found, of = [], []
        for n in range(SHORTEST, LONGEST + 1):
            at = np.flatnonzero(np.arange(size) + n <= end)
            found.append((total[at + n] - total[at]) * back[at])
            of.append(owner[at])
        whole = np.flatnonzero(lengths > LONGEST)
        found.append((total[local[1:]] - total[local[:-1]])[whole] * back[local[:-1][whole]])
        of.append(whole)
        of = np.concatenate(of)
        order = np.argsort(of, kind="stable")
        buckets = (mix(np.concatenate(found)) % np.uint64(BUCKETS)).astype(np.int32)[order]
        yield first, buckets, np.bincount(of, minlength=last - first)


@dataclass
class Bags:
    """Passages as sets of word numbers; ``starts`` has where each passage begins in ``ids``."""

    ids: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    docs: np.ndarray

    def means(self, logits: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0)
        return np.add.reduceat(logits[self.ids], self.starts) / np.maximum(self.sizes, PASSAGE // 2)


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, Bags]:
    """The buffer of ``texts``, the bounds of its distinct words, and its passages."""
    buffer, offsets = buffer_of(texts)
    found = words(buffer, offsets)
    codes, values = pd.factorize(found.hashes)
    first = np.zeros(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    bounds = found.starts[first], found.ends[first]
    counts = np.bincount(found.docs, minlength=len(texts))
    place = np.arange(len(codes)) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)
    step = PASSAGE // 2
    per_text = np.maximum(-(-(counts - PASSAGE) // step), 0) + 1
    base = np.r_[0, np.cumsum(per_text)]
    late = np.minimum(place // step, per_text[found.docs] - 1)
    early = place // step - 1
    both = np.flatnonzero((early >= 0) & (early < late))
    passage = np.r_[base[found.docs] + late, base[found.docs[both]] + early[both]]
    key = np.sort(passage * np.int64(max(len(values), 1)) + np.r_[codes, codes[both]])
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    passage, ids = np.divmod(key, max(len(values), 1))
    starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(ids)])
    docs = np.searchsorted(base, passage[starts], "right") - 1
    lowered = np.where((buffer >= 65) & (buffer <= 90), buffer + 32, buffer).astype(np.uint8)
    return lowered, *bounds, Bags(ids, starts, sizes, docs)


@dataclass
class Model:
    """Embeddings, the difference of both classes' output vectors, bias, and calibration."""

    table: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, SIZE), np.float32))
    output: np.ndarray = field(default_factory=lambda: np.zeros(SIZE, np.float32))
    bias: float = 0.0
    slope: float = 0.0
    offset: float = -7.0

    def flat(self) -> "Scorer":
        return Scorer((self.table @ self.output).astype(np.float32), self.bias, self.slope, self.offset)


@dataclass
class Scorer:
    """What scoring needs of a model: one number per bucket."""

    buckets: np.ndarray
    bias: float
    slope: float
    offset: float

    def passage_logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The logit of each passage, and the text it is in."""
        buffer, starts, ends, found = bags(texts)
        logits = np.zeros(len(starts))
        for first, grams, counts in subwords(buffer, starts, ends):
            places = np.r_[0, np.cumsum(counts)[:-1]]
            logits[first:first + len(counts)] = np.add.reduceat(self.buckets[grams].astype(np.float64), places) / counts
        return found.means(logits) + self.bias, found.docs

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probabilities; a text without words has that of an average passage that says nothing."""
        top = np.full(len(texts), -np.inf)
        logits, docs = self.passage_logits(texts)
        np.maximum.at(top, docs, logits)
        z = self.slope * np.where(np.isinf(top), self.bias, top) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(found: Bags, grams: np.ndarray, counts: np.ndarray, toxic: np.ndarray, share: float, turns: int = 4,
          epochs: int = 12, rate: float = 0.02, ridge: float = 1e-7, seed: int = 7) -> Model:
    """Fits a model to passages; ``found.docs`` numbers the text of each, ``toxic`` labels the texts.

    ``grams`` are the buckets of all words, one word after the other, and ``counts`` how many each has.

    ``share`` is the part of toxic rows in the whole training data, which the probabilities
    follow. Without both classes every text gets that share. Steps are divided by each
    bucket's curvature, so rare n-grams learn as fast as frequent ones.
    """
    model = Model()
    share = float(np.clip(share, 1e-3, 1 - 1e-3))
    model.offset = float(np.log(share / (1 - share)))
    fit = np.arange(len(toxic)) % 5 != 4
    if not len(found.starts) or len(set(toxic[fit].tolist())) < 2:
        return model
    rng = np.random.default_rng(seed)
    places = np.r_[0, np.cumsum(counts)[:-1]]
    owner = found.docs
    model.output = np.full(SIZE, 1 / np.sqrt(SIZE)) + rng.uniform(-0.05, 0.05, SIZE)
    model.table = np.zeros((BUCKETS, SIZE))
    ids_end = found.starts + found.sizes

    def word_logits() -> np.ndarray:
        return np.add.reduceat((model.table @ model.output)[grams], places) / counts

    def by_bucket(words: np.ndarray) -> np.ndarray:
        return np.bincount(grams, np.repeat(words, counts), BUCKETS)

    usable = np.flatnonzero(fit[owner])
    for turn in range(turns):
        if turn == 0:
            chosen = usable  # it is not known yet which ones matter
        else:
            strength = found.means(word_logits())[usable]
            order = usable[np.lexsort((-strength, owner[usable]))]
            rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
            chosen = order[rank < np.where(toxic[owner[order]] > 0, 1, 3)]
        target = toxic[owner[chosen]].astype(np.float64)
        per_text = np.bincount(owner[chosen], minlength=len(toxic))
        positive = max(len(set(owner[chosen][target > 0].tolist())), 1)
        negative = max(len(set(owner[chosen][target == 0].tolist())), 1)
        weight = np.where(target > 0, 0.5 / positive, 0.5 / negative) / per_text[owner[chosen]]
        sizes = found.sizes[chosen]
        ids = found.ids[np.repeat(ids_end[chosen] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())]
        starts = np.cumsum(sizes) - sizes
        part = 1 / np.maximum(sizes, PASSAGE // 2)
        # Gradients go from passages to words and from words to buckets, so n-grams are held once a word.
        curvature = by_bucket(np.bincount(ids, np.repeat(part * part * weight, sizes), len(counts)) / counts ** 2) + ridge
        momentum, momentum_out, momentum_bias = np.zeros((BUCKETS, SIZE)), np.zeros(SIZE), 0.0
        for _ in range(epochs):
            z = np.add.reduceat(word_logits()[ids], starts) * part + model.bias
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
            pull = by_bucket(np.bincount(ids, np.repeat(part * error, sizes), len(counts)) / counts)
            momentum = 0.9 * momentum + (pull / curvature)[:, None] * model.output
            momentum_out = 0.9 * momentum_out + pull @ model.table
            momentum_bias = 0.9 * momentum_bias + error.sum()
            model.table -= rate * momentum
            model.output -= 0.01 * rate * momentum_out
            model.bias -= 0.2 * momentum_bias
    top = np.full(len(toxic), -np.inf)
    np.maximum.at(top, owner, found.means(word_logits()) + model.bias)
    top = np.where(np.isinf(top), model.bias, top)
    kept = ~fit if len(set(toxic[~fit].tolist())) == 2 else fit
    prior = np.where(toxic[kept] > 0, share / max(toxic[kept].mean(), 1e-9),
                     (1 - share) / max(1 - toxic[kept].mean(), 1e-9))
    model.slope, model.offset = _logistic(top[kept], toxic[kept], prior)
    return model


def _logistic(x: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic regression on one number, by Newton's method."""
    centre, spread = x.mean(), x.std() or 1.0
    data = np.c_[(x - centre) / spread, np.ones(len(x))]
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(data @ beta, -30, 30)))
        curve = (data * (weight * p * (1 - p))[:, None]).T @ data + 1e-1 * np.eye(2)
        beta -= np.clip(np.linalg.solve(curve, data.T @ (weight * (p - labels)) + 1e-1 * beta), -2, 2)
    slope = max(float(beta[0]), 0.0)
    return slope / spread, float(beta[1]) - slope * centre / spread


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each passage as the numbers of its words, and each word of a batch with its n-grams."""
    schema = pa.schema([("key", pa.int64()), ("toxic", pa.int32()), ("place", pa.int64()),
                        ("words", pa.list_(pa.int64())), ("grams", pa.list_(pa.int32()))])
    for batch in in_parts(batches, "text"):
        buffer, starts, ends, found = bags(batch.column("text"))
        grams, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for _, some, each in subwords(buffer, starts, ends):
            grams.append(some)
            counts.append(each)
        grams, counts = np.concatenate(grams), np.concatenate(counts)
        # A word is numbered by its n-grams, as words with the same ones have the same logit.
        at = np.r_[0, np.cumsum(counts)]
        total, back = np.zeros(len(counts), np.uint64), np.arange(len(grams)) - np.repeat(at[:-1], counts)
        if len(counts):
            total = np.add.reduceat(mix(grams.astype(np.uint64) + mix(back.astype(np.uint64) + np.uint64(1))), at[:-1])
        number = total.view(np.int64)
        first = np.r_[True, found.docs[1:] != found.docs[:-1]] if len(found.docs) else np.zeros(0, bool)
        heads = np.flatnonzero(first)
        place = np.arange(len(found.docs)) - np.repeat(heads, np.diff(np.r_[heads, len(found.docs)]))
        owner = pa.array(found.docs)
        lists = pa.ListArray.from_arrays(
            pa.array(np.r_[found.starts, len(found.ids)].astype(np.int32)), pa.array(number[found.ids]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key").take(owner).cast(pa.int64()), batch.column("toxic").take(owner).cast(pa.int32()),
             pa.array(place, pa.int64()), lists, pa.nulls(len(place), pa.list_(pa.int32()))], schema=schema)
        blank = pa.array(np.setdiff1d(np.arange(batch.num_rows), found.docs))  # no passage, but a label
        n = len(blank)
        yield pa.RecordBatch.from_arrays(
            [batch.column("key").take(blank).cast(pa.int64()), batch.column("toxic").take(blank).cast(pa.int32()),
             pa.array(np.zeros(n, np.int64)), pa.array([[]] * n, pa.list_(pa.int64())),
             pa.nulls(n, pa.list_(pa.int32()))], schema=schema)
        alone = pa.ListArray.from_arrays(pa.array(np.arange(len(number) + 1, dtype=np.int32)), pa.array(number))
        each = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(grams))
        n = len(number)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), alone, each], schema=schema)


def fit(docs: DataFrame, labels: DataFrame, learnable: Column | None = None) -> Model:
    """A model of ``labels(doc_id, toxic)`` for ``docs(doc_id, text)``.

    ``learnable`` limits the label rows that are used. At most ``SAMPLE_TOXIC`` and
    ``SAMPLE_CLEAN`` ids are taken, by hash of the id; an id with several labels counts as
    toxic if any says so; null ids and labels are left out. All passages of the sample come to
    the driver, as numbers of words, and the n-grams of every word once.
    """
    rows = only(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if learnable is not None:
        rows = rows.where(learnable)
    marked = rows.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    key = F.xxhash64("doc_id")
    sample = marked.where("toxic = 1").orderBy(key, "doc_id").limit(SAMPLE_TOXIC).unionByName(
        marked.where("toxic = 0").orderBy(key, "doc_id").limit(SAMPLE_CLEAN))
    texts = only(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id")
    found = materialise(texts.select(key.alias("key"), "toxic", "text").mapInArrow(
        _passages, "key bigint, toxic int, place bigint, words array<bigint>, grams array<int>"), "passages")
    got = found.where("key IS NOT NULL").select("key", "toxic", "place", "words").orderBy(
        "key", "place", "words").toArrow().combine_chunks()
    known = found.where("key IS NULL").select(F.col("words")[0].alias("word"), "grams").dropDuplicates(
        ["word"]).orderBy("word").toArrow().combine_chunks()
    listed = lambda column: column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    passages, grams = listed(got["words"]), listed(known["grams"])
    text_of, keys = pd.factorize(got["key"].to_numpy())
    toxic = np.zeros(len(keys), np.int64)
    np.maximum.at(toxic, text_of, got["toxic"].to_numpy())
    counts = grams.value_lengths().to_numpy().astype(np.int64)
    sizes_of = passages.value_lengths().to_numpy().astype(np.int64)
    ids = np.searchsorted(known["word"].to_numpy(), passages.flatten().to_numpy()).astype(np.int32)
    some = sizes_of > 0
    bag = Bags(ids, (np.cumsum(sizes_of) - sizes_of)[some], sizes_of[some], text_of[some])
    share = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    return train(bag, grams.flatten().to_numpy(), counts, toxic, share)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability that the text is toxic.

    Null and empty texts get the score of a passage without any n-gram. A column named ``score``
    is replaced.
    """
    docs = docs.drop("score")
    weights = docs.sparkSession.sparkContext.broadcast(vars(model.flat()))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(**weights.value)
        for batch in in_parts(batches, text):
            values = scorer.score(batch.column(text))
            rest = [batch.column(c) for c in batch.schema.names if c != text]
            names = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(values)], [*names, "score"])

    schema = StructType([f for f in docs.schema.fields if f.name != text]).add("score", DoubleType())
    return docs.mapInArrow(add, schema)

"""Secret scans: fixed patterns, and probabilistic automata inferred from what they find.

Grammar inference (state merging in the manner of ALERGIA): the values of a bounded sample
of labelled credentials form a prefix tree over character classes; states whose
continuations agree within a Hoeffding bound are merged, and the merged tree is a
probabilistic automaton of that kind of credential. Every run of key-like characters that
no pattern has claimed is scored by each automaton and by one inferred from ordinary runs.
A run is a secret of a kind if the automaton finds it as likely, per character, as it finds
most labelled credentials, and more likely than the ordinary one does.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from riskloom.llm.common import in_parts, set_aside
from riskloom.plans.lineage import materialise

KINDS = ["assign", "access", "hex"]
#: Patterns and least lengths of the base scan (fixed values).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS, ACCESS_LEAST = r"AKIA[A-Z0-9]+", 20
HEX, HEX_LEAST = r"[0-9a-f]+", 24
#: A candidate: a run of key-like characters with a digit and a letter.
CANDIDATE = r"[A-Za-z0-9+/_.=-]{16,}"
#: Most labelled credentials of a kind, and most ordinary runs, that an automaton is inferred from.
SAMPLE = 1_000
#: Confidence of the merge test; smaller values merge more.
ALPHA = 0.05
#: The threshold is this much below the score that all but this part of the labelled credentials reach.
SLACK, MISSED = 0.5, 0.02
#: Log2 units per character by which a credential's automaton must beat the ordinary one.
MARGIN = 0.5


def shape(value: str) -> str:
    """Character classes: digits, hexadecimal letters and other letters by case; the rest as it is."""
    return "".join(
        "0" if "0" <= c <= "9" else "a" if "a" <= c <= "f" else "g" if "g" <= c <= "z" else
        "A" if "A" <= c <= "F" else "G" if "G" <= c <= "Z" else c for c in value)


@dataclass
class Automaton:
    """Arcs ``(state, class) -> (state, log2 probability)``, end probabilities, and the acceptance threshold."""

    arcs: list[dict[str, tuple[int, float]]]
    ends: list[float]
    threshold: float = -math.inf

    #: Log2 probability of a step that was never seen; the traversal then starts over.
    UNSEEN = -12.0

    def likelihood(self, value: str) -> float:
        """Log2 probability per character of the value's shape."""
        state, total = 0, 0.0
        for symbol in shape(value):
            arc = self.arcs[state].get(symbol)
            if arc is None:
                state, total = 0, total + self.UNSEEN
            else:
                state, total = arc[0], total + arc[1]
        return (total + self.ends[state]) / (len(value) + 1)


class _Tree:
    """A prefix tree with counts, whose states can be merged."""

    def __init__(self, values: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.seen, self.ended = [0], [0]
        for value in values:
            state = 0
            self.seen[0] += 1
            for symbol in shape(value):
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.next)
                    self.next.append({})
                    self.seen.append(0)
                    self.ended.append(0)
                state = self.next[state][symbol]
                self.seen[state] += 1
            self.ended[state] += 1

    def agree(self, a: int, b: int) -> bool:
        """Whether all continuations of two states agree within the Hoeffding bound."""
        waiting = [(a, b)]
        factor = math.sqrt(0.5 * math.log(2 / ALPHA))
        while waiting:
            a, b = waiting.pop()
            if a == b:
                continue
            n, m = self.seen[a], self.seen[b]
            bound = factor * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ended[a] / n - self.ended[b] / m) > bound:
                return False
            if bound >= 1:
                continue  # nothing below can differ by more
            for symbol in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(symbol), self.next[b].get(symbol)
                p = self.seen[x] / n if x is not None else 0.0
                q = self.seen[y] / m if y is not None else 0.0
                if abs(p - q) > bound:
                    return False
                if x is not None and y is not None:
                    waiting.append((x, y))
        return True

    def fold(self, into: int, state: int) -> None:
        """Adds the subtree below ``state`` to ``into``."""
        waiting = [(into, state)]
        while waiting:
            a, b = waiting.pop()
            if a == b:
                continue
            self.seen[a] += self.seen[b]
            self.ended[a] += self.ended[b]
            for symbol, child in self.next[b].items():
                if symbol in self.next[a]:
                    waiting.append((self.next[a][symbol], child))
                else:
                    self.next[a][symbol] = child


def infer(values: list[str]) -> Automaton | None:
    """The automaton of some credentials, or None without any.

    The successors of kept states are taken one by one; each is merged into the first kept
    state it agrees with, or else kept.
    """
    values = sorted(v for v in values if v)
    if not values:
        return None
    tree, kept = _Tree(values), [0]
    while True:
        edge = next(((p, s) for p in kept for s in sorted(tree.next[p]) if tree.next[p][s] not in kept), None)
        if edge is None:
            break
        state = tree.next[edge[0]][edge[1]]
        for old in kept:
            if tree.agree(old, state):
                tree.next[edge[0]][edge[1]] = old
                tree.fold(old, state)
                break
        else:
            kept.append(state)
    number = {s: i for i, s in enumerate(kept)}
    arcs = [{s: (number[c], 0.0) for s, c in tree.next[state].items()} for state in kept]
    ends = [0.0] * len(kept)
    # Merged states share their counts, so arc probabilities are counted by walking the sample again.
    arc_counts = [dict.fromkeys(a, 0) for a in arcs]
    end_counts = [0] * len(arcs)
    for value in values:
        state = 0
        for symbol in shape(value):
            arc_counts[state][symbol] += 1
            state = arcs[state][symbol][0]
        end_counts[state] += 1
    for state, counts in enumerate(arc_counts):
        total = sum(counts.values()) + end_counts[state] + len(counts) + 1
        arcs[state] = {s: (arcs[state][s][0], math.log2((n + 1) / total)) for s, n in counts.items()}
        ends[state] = math.log2((end_counts[state] + 1) / total)
    out = Automaton(arcs, ends)
    out.threshold = float(np.quantile([out.likelihood(v) for v in values], MISSED)) - SLACK
    return out


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """``start, kind, end`` of every base match, and the bounds of its value, by start and kind."""
    out = []
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= ASSIGN_LEAST:
            out.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    for kind, pattern in ((1, _ACCESS), (2, _HEX)):
        out += [(m.start(), kind, m.end(), m.start(), m.end()) for m in pattern.finditer(text)]
    return sorted(out)


_ASSIGN = re.compile(ASSIGN, re.ASCII)
# Runs are maximal, so asking for the least length at once finds the same matches.
_ACCESS = re.compile(f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")
_HEX = re.compile(f"[0-9a-f]{{{HEX_LEAST},}}")
_CANDIDATE = re.compile(CANDIDATE)
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def candidates(text: str, base: list[tuple[int, int, int, int, int]]) -> list[tuple[int, str]]:
    """Start and value of every key-like run that touches no base span."""
    out, i = [], 0
    spans = sorted((s, e) for s, _, e, _, _ in base)
    for m in _CANDIDATE.finditer(text):
        value = m.group().rstrip(".=-")
        start, end = m.start(), m.start() + len(value)
        if len(value) < 16 or not _DIGIT.search(value) or not _LETTER.search(value):
            continue
        while i < len(spans) and spans[i][1] <= start:
            i += 1
        if not any(s < end and e > start for s, e in spans[i:i + 8]):
            out.append((start, value))
    return out


def _span_type(*names: str) -> ArrayType:
    return ArrayType(StructType([StructField(n, StringType() if n == "value" else LongType()) for n in names]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``base`` and ``candidates`` of every text; null is empty."""
    passed = [f for f in docs.schema.fields if f.name != text]
    schema = StructType([*passed, StructField("base", _span_type("start", "kind", "end", "from", "to", "value")),
                         StructField("candidates", _span_type("start", "value"))])

    arrow = to_arrow_schema(schema)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, text):
            base, rest = [], []
            for value in batch.column(text).to_pylist():
                value = value or ""
                found = base_spans(value)
                base.append([(*s, value[s[3]:s[4]]) for s in found])
                rest.append(candidates(value, found))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in passed], pa.array(base, arrow.field("base").type),
                 pa.array(rest, arrow.field("candidates").type)], schema.names)

    return docs.mapInArrow(find, schema)


def learn(scanned: DataFrame) -> dict[int, Automaton]:
    """Automata of each kind that occurs, and of ordinary runs under -1.

    At most ``SAMPLE`` distinct values of each are used, by hash of the value.
    """
    def sample(values: DataFrame, kind: int) -> DataFrame:
        return values.distinct().orderBy(F.xxhash64("value"), "value").limit(SAMPLE).select(
            F.lit(kind).alias("kind"), "value")

    found = scanned.select(F.explode("base").alias("s")).select("s.kind", "s.value")
    rows = sample(scanned.select(F.explode("candidates").alias("s")).select("s.value"), -1)
    for kind in range(len(KINDS)):
        rows = rows.unionByName(sample(found.where(F.col("kind") == kind).select("value"), kind))
    values: dict[int, list[str]] = {}
    for row in rows.collect():
        values.setdefault(row["kind"], []).append(row["value"])
    automata = {kind: automaton for kind, some in values.items() if kind >= 0 and (automaton := infer(some))}
    # Runs that look like credentials say nothing about ordinary ones.
    plain = [v for v in values.get(-1, []) if not any(a.likelihood(v) >= a.threshold for a in automata.values())]
    ordinary = infer(plain)
    return automata | ({-1: ordinary} if ordinary else {})


def classify(value: str, automata: dict[int, Automaton]) -> int | None:
    """The kind whose automaton finds a candidate most likely, if it accepts it."""
    ordinary = automata[-1].likelihood(value) if -1 in automata else -math.inf
    best = None
    for kind, automaton in automata.items():
        if kind >= 0:
            score = automaton.likelihood(value)
            if score >= automaton.threshold and score >= ordinary + MARGIN and (best is None or score > best[0]):
                best = (score, kind)
    return best[1] if best else None


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, joined where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def redact(docs: DataFrame, automata: dict[int, Automaton], text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with ``mark`` in place of the value of every secret; null stays null."""
    names = docs.columns

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, text):
            out = []
            for value in batch.column(text).to_pylist():
                if value:
                    base = base_spans(value)
                    spans = [s[3:] for s in base] + [
                        (at, at + len(run)) for at, run in candidates(value, base) if classify(run, automata) is not None]
                    for a, b in reversed(merged(spans)):
                        value = value[:a] + mark + value[b:]
                out.append(value)
            columns = [pa.array(out, pa.string()) if n == text else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(cover, docs.schema)


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with counts of base matches by kind, their digest, all spans, and ``mask``.

    ``mask`` has the bounds of the secret values in order, joined where they overlap. Null
    and empty texts have no span. Texts are read once; the spans are stored, and the
    automata score the stored candidates. Columns of the added names are replaced; all others
    are kept, whatever their names.
    """
    docs, back = set_aside(docs.drop(*[f"n_{k}" for k in KINDS], "base_sha256", "spans", "mask"), "base", "candidates")
    passed = [f for f in docs.schema.fields if f.name != text]
    found = materialise(scan(docs, text), "spans")
    automata = learn(found)
    added = [StructField(f"n_{k}", LongType()) for k in KINDS] + [
        StructField("base_sha256", StringType()), StructField("spans", StringType()),
        StructField("mask", _span_type("start", "end"))]

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for base, rest in zip(batch["base"], batch["candidates"]):
                spans = [(s["start"], s["kind"], s["end"]) for s in base]
                values = [(s["from"], s["to"]) for s in base]
                counts = [sum(k == i for _, k, _ in spans) for i in range(len(KINDS))]
                digest = hashlib.sha256(_joined(spans).encode()).hexdigest()
                for c in rest:
                    kind = classify(c["value"], automata)
                    if kind is not None:
                        spans.append((c["start"], kind, c["start"] + len(c["value"])))
                        values.append(spans[-1][::2])
                rows.append((*counts, digest, _joined(spans), merged(values)))
            out = pd.DataFrame(rows, columns=[f.name for f in added], index=batch.index)
            yield pd.concat([batch.drop(columns=["base", "candidates"]), out], axis=1)

    return found.mapInPandas(finish, StructType([*passed, *added])).withColumnsRenamed(back)

"""Secrets by pattern, and by a probabilistic automaton inferred from found credentials.

The automaton is a prefix tree of the credentials' character classes whose
compatible states are merged: two states are compatible when the frequencies of
their endings and of each symbol differ by less than the Hoeffding bound allows, and so do
the states that follow. All runs over the credentials' alphabet (CANDIDATE) are then scored by the mean log
likelihood per symbol, less that of five equally likely classes; runs above MARGIN that
touch no base span are spans of the kind "format". A run with dots that is none is scored part by part.

All distinct credentials are counted by class pattern. A format is a length and a set of classes; the inference reads
all formats, of each at most MAX_LABELLED patterns, those with the smallest hash, which stand for the others by weight.

Positions are code points. Defined results: null and empty texts have no spans; repeated rows are rows
each; with no credentials nothing is added; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, texts

MAX_LABELLED = 2000
#: Parts in which a format's patterns are ranked before all of it is.
PARTS = 32
#: Nats per symbol by which the automaton must explain a candidate better than its classes do.
MARGIN = 0.15
ALPHA = 0.05
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
_PART = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
_CLASSES = str.maketrans({**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "U"), **dict.fromkeys("+/_.=-", "s")})


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, credential) in order."""
    out = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


class Automaton:
    """States with counts of arrivals, endings and (symbol, next state) pairs."""

    def __init__(self, samples: list[str], alpha: float = ALPHA, weights: list[int] | None = None):
        self.arrive, self.end, self.next = [0], [0], [{}]
        self.alpha = alpha
        for text, n in zip(samples, weights or [1] * len(samples), strict=True):
            self._add(text, n)
        self._merge_all()

    def _add(self, text: str, n: int = 1) -> None:
        at = 0
        self.arrive[0] += n
        for c in text:
            if c not in self.next[at]:
                self.next[at][c] = [len(self.arrive), 0]
                self.arrive.append(0)
                self.end.append(0)
                self.next.append({})
            step = self.next[at][c]
            step[1] += n
            at = step[0]
            self.arrive[at] += n
        self.end[at] += n

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        return abs(f / n - g / m) > math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        seen = set()
        while stack:
            a, b = stack.pop()
            if a == b or (a, b) in seen or not self.arrive[a] or not self.arrive[b]:
                continue
            seen.add((a, b))
            n, m = self.arrive[a], self.arrive[b]
            if self._differ(self.end[a], n, self.end[b], m):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(c, [None, 0]), self.next[b].get(c, [None, 0])
                if self._differ(x[1], n, y[1], m):
                    return False
                if x[0] is not None and y[0] is not None:
                    stack.append((x[0], y[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """State b, whose followers are a tree, into a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.arrive[a] += self.arrive[b]
            self.end[a] += self.end[b]
            for c, (to, n) in self.next[b].items():
                if c in self.next[a]:
                    self.next[a][c][1] += n
                    stack.append((self.next[a][c][0], to))
                else:
                    self.next[a][c] = [to, n]

    def _merge_all(self) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        while blue:
            parent, c = blue.pop(0)
            state = self.next[parent][c][0]
            if state in red:
                continue
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][c][0] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
            known = set(red)
            blue = [(r, x) for r in red for x in sorted(self.next[r]) if self.next[r][x][0] not in known]

    def likelihood(self, text: str) -> float:
        """Mean log likelihood per symbol above that of five equally likely classes; minus infinity for a string it cannot make."""
        at, total = 0, 0.0
        for c in text:
            step = self.next[at].get(c)
            if step is None:
                return -math.inf
            total += math.log(step[1] / self.arrive[at]) - math.log(1 / 5)
            at = step[0]
        return total / max(1, len(text))


def _explained(m: re.Match, base: list, model: Automaton) -> bool:
    free = all(s >= m.end() or m.start() >= e for s, _, e, _ in base)
    return free and model.likelihood(m[0].translate(_CLASSES)) >= MARGIN


def spans_of(text: str, model: Automaton | None) -> tuple[list, list]:
    base = base_spans(text)
    more = []
    if model is not None:
        for m in CANDIDATE.finditer(text):
            if _explained(m, base, model):
                more.append((m.start(), len(KINDS), m.end(), m[0]))
            elif "." in m[0]:
                more += [(p.start(), len(KINDS), p.end(), p[0]) for p in _PART.finditer(text, m.start(), m.end()) if _explained(p, base, model)]
    return base, more


def infer(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> Automaton | None:
    """The automaton of the credentials that the patterns find."""

    def credentials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted({s[3] for t in batch.column(1).to_pylist() for s in base_spans(t)})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["value"])

    values = texts(docs).mapInArrow(credentials, "value string").distinct()
    pattern = F.translate("value", "".join(map(chr, _CLASSES)), "".join(_CLASSES.values()))
    patterns = values.select(pattern.alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    classes = F.concat(*(F.when(F.col("pattern").contains(c), c).otherwise("") for c in "dhlUs"))
    patterns = cut(patterns.withColumns({"length": F.length("pattern"), "classes": classes, "hash": F.xxhash64("pattern")}), "patterns")
    total = patterns.groupBy("length", "classes").agg(F.sum("n").alias("total"))
    rank = lambda *keys: F.row_number().over(Window.partitionBy("length", "classes", *keys).orderBy("hash", "pattern"))
    first = patterns.withColumn("part", F.pmod("hash", F.lit(PARTS))).withColumn("rank", rank("part")).where(F.col("rank") <= max_labelled)
    rows = first.withColumn("rank", rank()).where(F.col("rank") <= max_labelled).join(total, ["length", "classes"]).select("length", "classes", "pattern", "n", "total").collect()
    held = Counter()
    for r in rows:
        held[r.length, r.classes] += r.n
    # counts of the patterns that were read are raised to their format's
    found = sorted((r.pattern, max(1, round(r.n * r.total / held[r.length, r.classes]))) for r in rows)
    return Automaton([p for p, _ in found], weights=[n for _, n in found]) if found else None


def scan(docs: DataFrame, model: Automaton | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format) per row."""
    names = (*KINDS, "format")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, more = spans_of(text, model)
                joined = [",".join(f"{names[k]}:{s}:{e}" for s, k, e, _ in part) for part in (base, sorted(base + more))]
                rows.append((*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(joined[0].encode()).hexdigest(), joined[1], len(more)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"])

    return texts(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, infer(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_secrets": op8_secrets}
SQL: dict[str, str] = {}

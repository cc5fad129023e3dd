"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of byte kinds, word shapes and
repetitions, of the line itself and of both neighbours; a 2 by 2 matrix scores
neighbouring labels. The field is fitted by gradient ascent on the conditional likelihood, the lines of a
labelled document taking its label. Forward-backward gives each line's marginal; the
mean weighted by line length is the document's score.

The fit reads at most MAX_LABELLED labelled documents, those with the smallest hash of doc_id.

Defined results: null and empty texts are one empty line; repeated rows are scored each; repeated labels
of one document count once, the smallest; without labels of both kinds the score is 0.5;
an empty table gives no rows; only doc_id and text are read, never labels, lang or source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_view, chunks, prefix_hash, span_hash, table, texts

#: Labelled documents that the fit reads at most; more change accuracy little.
MAX_LABELLED = 2000
THRESHOLD = 0.7
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "%$&*#", "|", "!", ".,;:?", "<>{}[]()=\\/_+-\"'`~^@")
_KIND = np.full(256, len(_KINDS), dtype=np.int64)
for _k, _s in enumerate(_KINDS):
    _KIND[[ord(c) for c in _s]] = _k
WIDTH = len(_KINDS) + 1 + 6


def line_features(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features per line, lines before each document, line lengths in bytes); a line feed ends a line."""
    feed = np.flatnonzero(flat == 10)
    begin = np.unique(np.concatenate((at[:-1], feed + 1)))
    # an empty document still has one line: starts are kept per document
    doc_of = np.searchsorted(at[1:], begin, side="right")
    inside = begin < at[-1]
    starts, docs = begin[inside], doc_of[inside]
    empty = np.flatnonzero(np.diff(at) == 0)
    starts, docs, void = np.concatenate((starts, at[empty])), np.concatenate((docs, empty)), np.concatenate((np.zeros(len(starts), bool), np.ones(len(empty), bool)))
    order = np.lexsort((starts, docs))
    starts, docs, void = starts[order], docs[order], void[order]
    nxt = np.append(starts[1:], at[-1])
    ends = np.where(void, starts, np.minimum(nxt, at[docs + 1]))
    last = np.maximum(ends - 1, 0)
    if len(flat):
        ends = np.where((ends > starts) & (flat[last] == 10), ends - 1, ends)
    size = ends - starts
    n = len(starts)
    x = np.zeros((n, WIDTH))
    kind = _KIND[flat]
    whole = np.maximum(size, 1)
    for k in range(len(_KINDS) + 1):
        c = np.concatenate(([0], np.cumsum(kind == k)))
        x[:, k] = (c[ends] - c[starts]) / whole
    # words: their number, length, distinct share in the line, and repeated lines of a document
    blank = (kind == 3) | (flat == 10)
    edge = np.diff(np.concatenate(([1], blank, [1])).astype(np.int8))
    cut = np.isin(np.arange(len(flat) + 1), at)  # words end with their document
    w0 = np.flatnonzero((edge == -1) | (cut & np.concatenate((~blank, [False]))))
    w1 = np.flatnonzero((edge == 1) | (cut & np.concatenate(([False], ~blank))))
    prefix = prefix_hash(flat)
    line = np.searchsorted(starts, w0, side="right") - 1
    words = np.bincount(line, minlength=n)[:n]
    spans = span_hash(prefix, w0, w1)
    if len(w0):
        distinct = np.unique(np.stack((line.astype(np.uint64), spans), axis=1), axis=0)[:, 0]
        different = np.bincount(distinct.astype(np.int64), minlength=n)[:n]
    else:
        different = words
    hashes = span_hash(prefix, starts, ends)
    _, back, times = np.unique(np.stack((docs.astype(np.uint64), hashes), axis=1), axis=0, return_inverse=True, return_counts=True)
    base = len(_KINDS) + 1
    x[:, base] = np.log1p(size) / 6
    x[:, base + 1] = np.log1p(words) / 4
    x[:, base + 2] = np.minimum(size / np.maximum(words, 1), 30) / 10
    x[:, base + 3] = different / np.maximum(words, 1)
    x[:, base + 4] = (times[back.reshape(-1)] > 1) & (size > 0)
    x[:, base + 5] = size == 0
    return x, np.searchsorted(docs, np.arange(len(at))), size


def with_neighbours(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each line's features, its neighbours' (zero beyond the document), and 1."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[offsets[:-1]] = 0
    after[offsets[1:] - 1] = 0
    return np.concatenate((x, before, after, np.ones((len(x), 1))), axis=1)


def marginals(emission: np.ndarray, offsets: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of good per line, expected neighbouring label pairs) for emission scores of good against bad."""
    n = len(emission)
    local = np.stack((np.zeros(n), emission), axis=1)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    sizes = size[order]
    for t in range(int(sizes[0]) if len(sizes) else 0):
        on = offsets[:-1][order[: np.searchsorted(-sizes, -t, side="left")]] + t
        forward[on] = local[on]
        if t:
            z = forward[on - 1][:, :, None] + transition[None]
            forward[on] += np.logaddexp(z[:, 0], z[:, 1])
    for t in range(int(sizes[0]) - 1 if len(sizes) else 0, 0, -1):
        on = offsets[:-1][order[: np.searchsorted(-sizes, -t, side="left")]] + t
        z = transition[None] + (local[on] + backward[on])[:, None, :]
        backward[on - 1] = np.logaddexp(z[:, :, 0], z[:, :, 1])
    both = forward + backward
    norm = np.logaddexp(both[:, 0], both[:, 1])
    follow = np.ones(n, bool)
    follow[offsets[:-1]] = False
    i = np.flatnonzero(follow)
    pair = forward[i - 1][:, :, None] + transition[None] + (local[i] + backward[i])[:, None, :] - norm[i][:, None, None]
    return np.exp(both[:, 1] - norm), np.exp(pair).sum(axis=0)


def fit(x: np.ndarray, offsets: np.ndarray, good: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 1e-3) -> dict:
    """Weights of the field by Adam; good: a label per document. Documents weigh the same in the emission part whatever their length."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[-1], spread[-1] = 0, 1
    z = (x - mean) / spread
    size = np.diff(offsets)
    y = np.repeat(good.astype(float), size)
    share = np.repeat(1 / size, size) / len(size)
    pairs = np.maximum(size - 1, 0)
    seen = np.diag([float(pairs[good == 0].sum()), float(pairs[good == 1].sum())])
    theta = np.zeros(z.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        p, expected = marginals(z @ theta[:-4], offsets, theta[-4:].reshape(2, 2))
        grad = np.concatenate((z.T @ ((y - p) * share), ((seen - expected) / max(1.0, pairs.sum())).reshape(-1))) - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"mean": mean, "spread": spread, "weights": theta[:-4], "transition": theta[-4:].reshape(2, 2)}


def document_scores(model: dict | None, column: pa.Array) -> np.ndarray:
    flat, at = byte_view(column)
    if model is None:
        return np.full(len(column), 0.5)
    x, offsets, size = line_features(flat, at)
    z = (with_neighbours(x, offsets) - model["mean"]) / model["spread"]
    p, _ = marginals(z @ model["weights"], offsets, model["transition"])
    weight = size + 1.0
    return np.clip(np.add.reduceat(p * weight, offsets[:-1]) / np.add.reduceat(weight, offsets[:-1]), 0, 1)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict | None:
    """The field fitted on labelled documents that are not held out."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    kinds = "doc_id long, quality int, n int, x array<double>"

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                x, offsets, _ = line_features(*byte_view(batch.column(1)))
                z = with_neighbours(x, offsets)
                held = [z[a:b].reshape(-1) for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(np.diff(offsets), pa.int32()), pa.array(held, pa.list_(pa.float64()))], names=["doc_id", "quality", "n", "x"])

    found = sorted(rows.mapInArrow(features, kinds).collect(), key=lambda r: (r.doc_id, r.n))
    good = np.array([r.quality for r in found])
    if len(set(good.tolist())) < 2:
        return None
    x = np.concatenate([np.array(r.x).reshape(r.n, -1) for r in found])
    return fit(x, np.concatenate(([0], np.cumsum([r.n for r in found]))), good)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def score(docs: DataFrame, model: dict | None, name: str = "score") -> DataFrame:
    """docs with the score under name, in place of a column of that name if there is one; other columns stay, null texts count as empty."""
    rest = docs.drop(*(c for c in docs.columns if c.lower() == name.lower()))
    schema = T.StructType([*rest.schema.fields, T.StructField(name, T.DoubleType())])
    at = rest.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(document_scores(model, batch.column(at)))], names=[*batch.schema.names, name])

    return rest.mapInArrow(run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents"))
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_quality": op9_quality}
SQL: dict[str, str] = {}

"""Best-fit packing of token sequences under several capacities at once.

A bin has residual capacities for tokens, documents and attention cost (the sum of
squared piece lengths). Pieces are taken longest first; of the open bins in which a piece
fits under every capacity, the one whose weighted residual after placement has the
smallest norm takes it ("norm"), or the one whose weighted residuals have the largest dot
product with the piece ("dot"); if it fits nowhere, a bin is opened.

Shards of SHARD_PIECES pieces are packed each by one task, so that no task's work grows with the
input; a shard ends with at most a few bins that are not full.

Defined results: null or empty text is a document of the end id alone; repeated rows are
packed each; an empty table gives no rows; only doc_id and text of the input are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, table, texts
from .tokens import encoder

#: Pieces that one task packs: enough that bins left open at the end do not count.
SHARD_PIECES = 20_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, max_tokens: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of at most max_tokens tokens of each document's ids with end_id after them."""

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for whole in batches:
            for batch in chunks(whole, limit=8 << 20):
                ids, at = encode(batch.column(1))
                sizes = np.diff(at) + 1
                each = -(-sizes // max_tokens)
                row = np.repeat(np.arange(len(sizes)), each)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                start = piece * max_tokens
                length = np.minimum(sizes[row] - start, max_tokens)
                last = start + length == sizes[row]
                # the end id is no part of ids: the last piece has it after what it takes from them
                begin = at[:-1][row] + start
                wide = ids.astype("<u4")
                tail = np.array([end_id], dtype="<u4").tobytes()
                crc = [
                    zlib.crc32(tail, zlib.crc32(wide[b : b + n - 1])) if e else zlib.crc32(wide[b : b + n])
                    for b, n, e in zip(begin.tolist(), length.tolist(), last.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return texts(docs).mapInArrow(cut_batches, PIECE_SCHEMA)


def best_fit(lengths: list[int], max_tokens: int, max_docs: int, max_attention: int, weights: tuple[float, float, float], rule: str) -> tuple[list[int], list[int]]:
    """The bin of each length and the place in it. Bins with equal residuals are interchangeable and held as one state with a count of them."""
    capacity = np.array([max_tokens, max_docs, max_attention], dtype=np.float64)
    weight = np.array(weights) / capacity**2
    where, offset = [0] * len(lengths), [0] * len(lengths)
    states: dict[tuple[int, int, int], list[int]] = {}
    keys = np.zeros((16, 3), dtype=np.int64)  # the states that have bins, in rows below `used`
    names: list[tuple[int, int, int]] = []
    row_of: dict[tuple[int, int, int], int] = {}
    bins = 0
    filled: list[int] = []

    def add(state: tuple[int, int, int], b: int) -> None:
        nonlocal keys
        if state not in row_of:
            if len(names) == len(keys):
                keys = np.concatenate((keys, np.zeros_like(keys)))
            row_of[state] = len(names)
            keys[len(names)] = state
            names.append(state)
            states[state] = []
        heapq.heappush(states[state], b)

    def take(state: tuple[int, int, int]) -> int:
        b = heapq.heappop(states[state])
        if not states[state]:  # the last row moves into its place
            i, moved = row_of.pop(state), names.pop()
            del states[state]
            if moved != state:
                names[i], row_of[moved], keys[i] = moved, i, keys[len(names)]
        return b

    for i in sorted(range(len(lengths)), key=lambda j: (-lengths[j], j)):
        n = lengths[i]
        if n > max_tokens or n * n > max_attention or max_docs < 1:
            raise ValueError("a piece exceeds a capacity of an empty bin")
        need = np.array([n, 1, n * n])
        left = keys[: len(names)] - need
        fits = np.flatnonzero((left >= 0).all(axis=1))
        if len(fits):
            if rule == "dot":
                score = -(keys[fits] * (need * weight)).sum(axis=1)
            else:
                score = (left[fits].astype(np.float64) ** 2 * weight).sum(axis=1)
            state = names[fits[int(np.argmin(score))]]
            b = take(state)
        else:
            state, b = (max_tokens, max_docs, max_attention), bins
            bins += 1
            filled.append(0)
        where[i], offset[i] = b, filled[b]
        filled[b] += n
        rest = (state[0] - n, state[1] - 1, state[2] - n * n)
        if min(rest) > 0:
            add(rest, b)
    return where, offset


def pack(
    pieces: DataFrame, max_tokens: int = 2048, max_docs: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.25, 0.25), rule: str = "norm"
) -> DataFrame:
    """pieces with sequence_id and offset. Without max_docs and max_attention those capacities are as large as they can matter."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    docs_cap = max_tokens if max_docs is None else max_docs
    attention_cap = max_tokens**2 if max_attention is None else max_attention
    pieces = cut(pieces, "pieces")
    n = pieces.count()
    shards = max(1, -(-n // SHARD_PIECES))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long"
    dealt = pieces.withColumn("_shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))

    def pack_shard(key, whole):
        whole = whole.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        where, offset = best_fit(whole.column("length").to_pylist(), max_tokens, docs_cap, attention_cap, weights, rule)
        base = key[0].as_py() << 32
        out = whole.drop_columns(["_shard"])
        return out.append_column("sequence_id", pa.array([base + b for b in where], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("_shard").applyInArrow(pack_shard, schema)


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    keep = {k: options.pop(k) for k in ("tokenizer", "end_id") if k in options}
    return pack(cut_pieces(docs, max_tokens=options.get("max_tokens", 2048), **keep), **options)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_best_fit_packing": op4_best_fit_packing}
SQL: dict[str, str] = {}

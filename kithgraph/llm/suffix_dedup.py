"""Repeated byte strings across and inside documents by suffix arrays of shards.

Texts are dealt to shards so that equal windows of LENGTH bytes meet in one, and each shard is
sorted by induction:

1. In each window the GRAM-byte string of least hash is its anchor (the leftmost of equal ones), so equal
   windows have equal anchors at equal places. The windows of one anchor are a region, of at
   most 2 * LENGTH - GRAM bytes. Anchors that occur once cannot repeat and go no further.
2. Equal regions are one region with a count, summed before any text is moved. Regions
   whose anchor has no other region need no sorting: all their windows are repeated.
3. The others are dealt by anchor to shards of about SHARD_BYTES. A shard classifies its suffixes,
   sorts the leftmost-smaller substrings by induction, names them, orders the string of names, and
   induces its suffix array from that. Permuted common prefixes tell which windows
   equal their neighbour in the array; these are compared byte by byte.
4. An anchor with more than UNIT regions is split over shards. What its shards find is merged
   by the hash of windows, one row per shard and different window.

Induction steps through the array a bucket of one first symbol at a time, so that each step is an array
operation. The string of names has too many symbols for that: it is ordered by doubling, up to LENGTH bytes,
which is as far as the order matters.

Defined results: null and empty texts have nothing to remove; shorter texts than a window stay
whole; repeated rows are copies of each other; an empty table gives no rows; columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_view, chunks, cut, discard, mix64, powers, prefix_hash, span_hash, table, texts

LENGTH, GRAM = 200, 64
SHARD_BYTES = 2 << 20
#: Regions of one anchor that are sorted together.
UNIT = 2000
#: Low bits of a key that hold a place in the chunk; the others are the hash.
_PLACE = 32
#: A shard's symbols: its end, the end of a region, and the bytes.
_SYMBOLS = 258
_SYMBOL_HASH = mix64(np.arange(1, _SYMBOLS + 1, dtype=np.uint64))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(flat: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash prefix, window starts, the anchor's place per window, hash of each gram); no window crosses documents."""
    prefix = prefix_hash(flat)
    if len(flat) < length:
        none = np.zeros(0, np.int64)
        return prefix, none, none, np.zeros(0, np.uint64)
    place = np.arange(len(flat) - gram + 1)
    hashes = span_hash(prefix, place, place + gram)
    low = np.uint64((1 << _PLACE) - 1)
    least = sliding_least((hashes & ~low) | place.astype(np.uint64), length - gram + 1)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + length <= at[doc + 1])
    return prefix, start, (least[start] & low).astype(np.int64), hashes


def smaller_types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; t ends with its least symbol, which occurs there only."""
    step = np.diff(t.astype(np.int32))
    change = np.flatnonzero(step)
    out = np.ones(len(t), dtype=bool)
    out[:-1] = step[change[np.searchsorted(change, np.arange(len(step)))]] > 0
    return out


def _rank(symbols: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The place of each of the sorted symbols among its equals."""
    return np.arange(len(symbols)) - (np.cumsum(count) - count)[symbols]


def induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that follows from leftmost-smaller suffixes in the order given."""
    total = np.bincount(t, minlength=_SYMBOLS)
    tail = np.cumsum(total)
    head = tail - total
    out = np.empty(len(t), dtype=np.int64)
    first = t[lms]
    order = np.argsort(first, kind="stable")
    given = np.bincount(first, minlength=_SYMBOLS)
    out[(tail - given)[first[order]] + _rank(first[order], given)] = lms[order]
    front, back = head.copy(), tail.copy()

    def before(seen: np.ndarray, of: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        j = seen[seen > 0] - 1
        j = j[smaller[j] == of]
        order = np.argsort(t[j], kind="stable")
        j = j[order]
        return j, t[j], np.bincount(t[j], minlength=_SYMBOLS)

    used = np.flatnonzero(total).tolist()
    for c in used:
        at = int(head[c])
        while at < front[c]:
            at, seen = int(front[c]), out[at : front[c]]
            j, symbol, count = before(seen, False)
            out[front[symbol] + _rank(symbol, count)] = j
            front += count
        j, symbol, count = before(out[tail[c] - given[c] : tail[c]], False)
        out[front[symbol] + _rank(symbol, count)] = j
        front += count
    for c in reversed(used):
        at = int(tail[c])
        while at > back[c]:
            at, seen = int(back[c]), out[back[c] : at][::-1]
            j, symbol, count = before(seen, True)
            out[back[symbol] - 1 - _rank(symbol, count)] = j
            back -= count
        j, symbol, count = before(out[head[c] : front[c]][::-1], True)
        out[back[symbol] - 1 - _rank(symbol, count)] = j
        back -= count
    return out


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """The order of all suffixes of t by their first depth symbols at least."""
    smaller = smaller_types(t)
    leftmost = np.concatenate(([False], smaller[1:] & ~smaller[:-1]))
    lms = np.flatnonzero(leftmost)
    found = induce(t, smaller, lms)
    found = found[leftmost[found]]
    # substrings from one leftmost-smaller place to the next, that place included, get equal names when equal
    prefix = np.zeros(len(t) + 1, dtype=np.uint64)
    np.cumsum(_SYMBOL_HASH[t] * powers("up", len(t) + 1)[: len(t)], out=prefix[1:])
    number = np.empty(len(t), dtype=np.int64)
    number[lms] = np.arange(len(lms))
    which = number[found]
    hashes = span_hash(prefix, lms, np.append(lms[1:] + 1, len(t)))[which]
    name = np.empty(len(lms), dtype=np.int64)
    name[which] = np.concatenate(([0], np.cumsum(hashes[1:] != hashes[:-1])))
    reach = 1
    # a name stands for two symbols at least
    while 2 * reach < 2 * depth and name.max() + 1 < len(name):
        key = name * (len(name) + 1)
        key[:-reach] += name[reach:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        name[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        reach *= 2
    return induce(t, smaller, lms[np.argsort(name, kind="stable")])


def equal_to_neighbour(flat: np.ndarray, order: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """By place in order: whether the suffix shares length bytes with the one before it, that is whether its permuted common prefix reaches length."""
    padded = np.concatenate((flat, np.zeros(8, np.uint8)))
    words = np.ndarray((len(flat),), dtype="<u8", buffer=padded.data, strides=(1,))
    i = 1 + np.flatnonzero(valid[order[1:]] & valid[order[:-1]])
    for step in [*range(0, length - 8, 8), length - 8]:
        i = i[words[order[i] + step] == words[order[i - 1] + step]]
    out = np.zeros(len(order) + 1, dtype=bool)
    out[i] = True
    return out


def repeated_windows(regions: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(flat, region starts, valid, repeated, first of its equals) of the regions' bytes, each region with an end after it."""
    size = np.array([len(r) for r in regions], dtype=np.int64)
    flat = np.frombuffer(b"".join(r + b"\0" for r in regions) + b"\0", dtype=np.uint8)
    starts = np.cumsum(size + 1) - (size + 1)
    t = flat.astype(np.int16) + 2
    t[starts + size] = 1
    t[-1] = 0
    room = np.repeat(starts + size, size + 1) - np.arange(len(flat) - 1)
    valid = np.append(room >= length, False)
    order = suffix_array(t, length)
    same = equal_to_neighbour(flat, order, valid, length)
    repeated, first = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    repeated[order] = same[:-1] | same[1:]
    first[order] = ~same[:-1]
    return flat, starts, valid, repeated, first & valid


def _region_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(_row, s, e, h, rh): each region with the hashes of its anchor and of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                flat, at = byte_view(batch.column("text"))
                prefix, start, place, hashes = anchors(flat, at, length, gram)
                new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else place
                s, p = start[new], place[new]
                e = np.append(start[new[1:] - 1], start[-1:]) + length if len(new) else s
                doc = np.searchsorted(at[1:], s, side="right")
                rows = batch.column("_row").take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.array(s - at[doc], pa.int64()), pa.array(e - at[doc], pa.int64()), pa.array(hashes[p].view(np.int64)), pa.array(span_hash(prefix, s, e).view(np.int64))], names=["_row", "s", "e", "h", "rh"]
                )

    return docs.select("_row", "text").mapInArrow(run, "_row long, s long, e long, h long, rh long")


def _region_bytes(asked: DataFrame) -> DataFrame:
    """(h, rh, n, data) of the regions that each text is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                out = []
                for text, regions in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                    data = text.encode()
                    out += [(r["h"], r["rh"], r["n"], data[r["s"] : r["e"]]) for r in regions]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["h", "rh", "n", "data"])

    return asked.select("text", "asked").mapInArrow(run, "h long, rh long, n long, data binary")


def _sorted_shards(regions: DataFrame, length: int) -> DataFrame:
    """(h, rh, s, e, wh) by region: the runs of repeated windows, and for split anchors (parts > 1) the windows with their hash wh that are to be merged."""

    def run(shard: pa.Table) -> pa.Table:
        data, split, n = shard.column("data").to_pylist(), shard.column("parts").to_numpy() > 1, shard.column("n").to_numpy()
        flat, starts, valid, repeated, first = repeated_windows(data, length)
        region = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(flat) - 1)))
        region = np.append(region, len(starts) - 1)
        repeated |= valid & (n > 1)[region]
        edge = np.diff(np.concatenate(([0], repeated.astype(np.int8))))
        s = np.flatnonzero(edge == 1)
        e = np.flatnonzero(edge == -1) - 1 + length
        # of a window that several regions of the shard hold, the first stands for all
        open_ = np.flatnonzero(split[region] & first)
        wh = span_hash(prefix_hash(flat), open_, open_ + length).view(np.int64)
        place = np.concatenate((s, open_))
        of = region[place]
        begin = place - starts[of]
        end = np.concatenate((e - starts[region[s]], np.where(repeated[open_], -1, begin[len(s) :] + length)))
        hashes = pa.array(np.concatenate((np.zeros(len(s), np.int64), wh)), mask=np.arange(len(place)) < len(s))
        return pa.table([shard.column("h").take(pa.array(of)), shard.column("rh").take(pa.array(of)), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), hashes], names=["h", "rh", "s", "e", "wh"])

    return regions.groupBy("shard").applyInArrow(run, "h long, rh long, s long, e long, wh long")


def _covered(n: int, spans: list[dict]) -> np.ndarray:
    """For each of n + 1 places, how far the spans reach that begin there or before."""
    reach = np.zeros(n + 1, dtype=np.int64)
    for s in spans or ():
        reach[s["s"]] = max(reach[s["s"]], s["e"])
    return np.maximum.accumulate(reach)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, unit: int = UNIT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes): kept_bytes is what is left."""
    held = cut(texts(docs).withColumn("_row", F.monotonically_increasing_id()), "texts")
    found = cut(_region_rows(held, length, gram), "regions")
    anchor = found.groupBy("h").agg(F.count("*").alias("n"), F.min("rh").alias("x"), F.max("rh").alias("y"))
    anchor = cut(anchor.where("n > 1").select("h", (F.col("x") == F.col("y")).alias("alone")), "repeated-anchors")
    busy = cut(found.join(anchor, "h"), "busy")
    discard(found)
    mixed = busy.where("NOT alone")
    different = mixed.groupBy("h", "rh").agg(F.count("*").alias("n"), F.min(F.struct("_row", "s", "e")).alias("at"))
    asked = different.groupBy(F.col("at._row").alias("_row")).agg(F.collect_list(F.struct("h", "rh", "n", "at.s", "at.e")).alias("asked"))
    regions = cut(_region_bytes(held.join(asked, "_row")), "different-regions")
    parts = cut(regions.groupBy("h").agg(F.ceil(F.count("*") / unit).alias("parts")), "parts")
    n_bytes = regions.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("h", F.pmod("rh", "parts")), F.lit(max(1, -(-n_bytes // shard_bytes))))
    result = cut(_sorted_shards(regions.join(parts, "h").withColumn("shard", shard), length), "sorted")
    discard(regions)
    runs = result.where("wh IS NULL").select("h", "rh", "s", "e")
    # windows of split anchors that several shards hold; those with e = -1 are marked already where they are repeated in their shard
    windows = result.where("wh IS NOT NULL")
    across = cut(windows.groupBy("h", "wh").agg(F.count("*").alias("n")).where("n > 1").select("h", "wh"), "across")
    runs = runs.unionByName(windows.where("e > 0").join(across, ["h", "wh"], "left_semi").select("h", "rh", "s", "e"))
    per_region = runs.groupBy("h", "rh").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    per_region = cut(per_region, "runs")
    moved = F.transform("runs", lambda r: F.struct((F.col("s") + r["s"]).alias("s"), (F.col("s") + r["e"]).alias("e")))
    marks = mixed.join(per_region, ["h", "rh"]).select("_row", F.inline(moved))
    marks = marks.unionByName(busy.where("alone").select("_row", "s", "e")).groupBy("_row").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    final = held.join(cut(marks, "marks"), "_row", "left").select("doc_id", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                out = []
                for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                    data = text.encode()
                    reach = _covered(len(data), spans)
                    gone = reach[:-1] > np.arange(len(data))
                    n_spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(data) else 0
                    kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                    out.append((len(data), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    return final.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_bytes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_suffix_dedup": op1_suffix_dedup}
SQL: dict[str, str] = {}

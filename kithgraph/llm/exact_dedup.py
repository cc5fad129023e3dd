"""Exact duplicates by counting quotient filters that merge without loss.

A text's fingerprint is 64 bits of its normalised form. Each partition builds a counting quotient
filter of its fingerprints: the leading bits (the quotient) name a run, a run holds the
remaining bits (the remainders) in order, each with a count. The filter is cut into blocks by leading bits; the
filters of one block merge by their sorted remainders, counts added, into the filter that a single pass
would have built. A text that one partition holds a million times is one remainder there. Only
fingerprints with a count above one go to verification, where rows are grouped by the bytes of the whole
normalised text, so that texts which share no more than a fingerprint stay apart; copies
are summed before they are shuffled.

Defined results: null is an empty text; empty texts are equal to each other; repeated rows with one
doc_id are rows of their own, and all rows with the smallest doc_id are kept; a null doc_id is larger than all others; an
empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, table, texts

#: Fingerprints that a partition counts in one filter; a larger partition builds several.
FILTER_ROWS = 1 << 20
#: Fingerprints that one merge task holds, about; the number of blocks follows from it.
BLOCK_ROWS = 1 << 21


class QuotientFilter:
    """Counts of 64-bit fingerprints as runs of sorted remainders: ends[q] is where the run of quotient q ends."""

    def __init__(self, ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.ends, self.remainders, self.counts = ends, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> "QuotientFilter":
        """The filter of fingerprints in any order, repeated ones counted."""
        order = np.argsort(fingerprints, kind="stable")
        f = fingerprints[order]
        new = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1]))) if len(f) else np.zeros(0, np.int64)
        counts = np.ones(len(f), np.int64) if counts is None else counts[order]
        f, total = f[new], np.add.reduceat(counts, new) if len(f) else counts
        bits = max(1, len(f).bit_length())
        ends = np.searchsorted(f >> np.uint64(64 - bits), np.arange(1 << bits, dtype=np.uint64), side="right")
        return cls(ends.astype(np.int32), f & np.uint64((1 << 64 - bits) - 1), total.astype(np.int64))

    @property
    def bits(self) -> int:
        return len(self.ends).bit_length() - 1

    def fingerprints(self) -> np.ndarray:
        quotient = np.repeat(np.arange(len(self.ends), dtype=np.uint64), np.diff(self.ends, prepend=0))
        return quotient << np.uint64(64 - self.bits) | self.remainders

    def count(self, fingerprint: int) -> int:
        q = fingerprint >> 64 - self.bits
        start, end = int(self.ends[q - 1]) if q else 0, int(self.ends[q])
        at = start + int(np.searchsorted(self.remainders[start:end], np.uint64(fingerprint & (1 << 64 - self.bits) - 1)))
        return int(self.counts[at]) if at < end and int(self.remainders[at]) == fingerprint & (1 << 64 - self.bits) - 1 else 0

    @classmethod
    def merged(cls, filters: list["QuotientFilter"]) -> "QuotientFilter":
        """Sorted runs are merged whatever the filters' quotient bits are: the order of (quotient, remainder) is that of fingerprints."""
        return cls.of(np.concatenate([x.fingerprints() for x in filters]), np.concatenate([x.counts for x in filters]))

    def to_bytes(self) -> bytes:
        return np.array([self.bits, len(self.counts)], "<i4").tobytes() + self.ends.astype("<i4").tobytes() + self.remainders.astype("<u8").tobytes() + self.counts.astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "QuotientFilter":
        bits, n = np.frombuffer(data, "<i4", 2).tolist()
        at = 8 + (4 << bits)
        return cls(np.frombuffer(data, "<i4", 1 << bits, 8), np.frombuffer(data, "<u8", n, at), np.frombuffer(data, "<i8", n, at + 8 * n))


def normalised(text: Column) -> Column:
    """Each run of blanks as one space; single spaces stay as they are."""
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]{2,}|[\\x09-\\x0D]", " ")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, whole, text_sha256, fingerprint) of every row; whole is the normalised text."""
    held = texts(docs).select("doc_id", normalised(F.col("text")).alias("whole"))
    return held.select("doc_id", "whole", F.sha2(F.col("whole").cast("binary"), 256).alias("text_sha256"), F.xxhash64("whole").alias("fingerprint"))


def filters(prints: DataFrame, block_bits: int) -> DataFrame:
    """(block, filter): what each partition counts, cut by the leading block_bits of the fingerprints, which all of a block share."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            f = np.concatenate(held)
            block = (f >> np.uint64(64 - block_bits)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            f, block = f[order] << np.uint64(block_bits), block[order]
            names, starts = np.unique(block, return_index=True)
            parts = [QuotientFilter.of(x).to_bytes() for x in np.split(f, starts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(parts, pa.binary())], names=["block", "filter"])

        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += batch.num_rows
            if n >= FILTER_ROWS:
                yield emit()
                held, n = [], 0
        if n:
            yield emit()

    return prints.select("fingerprint").mapInArrow(build, "block int, filter binary")


def repeated_fingerprints(prints: DataFrame, block_bits: int) -> DataFrame:
    """(fingerprint): those that the merged filters count more than once."""

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        whole = QuotientFilter.merged([QuotientFilter.from_bytes(x) for x in rows.column("filter").to_pylist()])
        f = whole.fingerprints()[whole.counts > 1] >> np.uint64(block_bits) | np.uint64(key[0].as_py() << 64 - block_bits)
        return pa.table({"fingerprint": pa.array(f.view(np.int64), pa.int64())})

    return filters(prints, block_bits).groupBy("block").applyInArrow(merge, "fingerprint long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row; _kithgraph_made has the tables written for it, to be discarded once it is read."""
    prints = cut(fingerprints(docs), "fingerprints")
    blocks = max(prints.count() // BLOCK_ROWS, partitions(docs.sparkSession), 2)
    repeated = cut(repeated_fingerprints(prints, min(20, (blocks - 1).bit_length())), "repeated")
    # verification by bytes: a group is one summed row, whatever its size
    suspects = prints.join(repeated, "fingerprint", "left_semi")
    groups = suspects.groupBy("fingerprint", "whole").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where(F.col("group_size") > 1)
    groups = cut(groups.select(F.sha2(F.col("whole").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"), "groups")
    joined = prints.select("doc_id", "text_sha256").join(groups, "text_sha256", "left")
    keep = F.coalesce("keep_id", F.col("doc_id"))
    out = joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
    out._kithgraph_made = [prints, repeated, groups]
    return out


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_exact_dedup": op3_exact_dedup}
SQL: dict[str, str] = {
    "op3_exact_dedup": r"""WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)"""
}

"""Token ids in Arrow files of fixed-size lists: equal-length sequences and their masks.

Documents in ascending doc_id order are one stream of ids, each with an end id after it.
The stream is dealt by ranges of doc_id to files; a file holds record batches of
(ids: fixed_size_list<uint16 or uint32>[length], mask: fixed_size_list<bool>[length]), uncompressed, so a
reader that maps the file takes any sequence without a copy. The mask is false on the
padding that fills a file's last sequence. A manifest table has one row per document with the file and
the place of its ids in it; it names only files of task attempts that ended well.

Defined results: null or empty text is the end id alone; repeated rows are written each, in the order of
their text's hash; an empty table gives no file and no rows; only doc_id and text are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, cut, fresh_path, partitions, table, texts
from .tokens import encoder

#: Sequences in a record batch: a few MB.
BATCH_SEQUENCES = 512
MANIFEST = "part int, file string, doc_id long, local_start long, n_tokens long, doc_no long"


class _Writer:
    """Appends ids to a file of fixed-size-list batches."""

    def __init__(self, uri: str, length: int, dtype: np.dtype):
        self.length, self.dtype = length, np.dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        where, path = fs.FileSystem.from_uri(uri)
        self.stream = where.open_output_stream(path)
        self.file = pa.ipc.new_file(self.stream, self.schema)
        self.held: list[np.ndarray] = []
        self.size = 0

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.length * BATCH_SEQUENCES:
            self._flush(self.length * BATCH_SEQUENCES)

    def _flush(self, whole: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        for i in range(0, len(ids) - len(ids) % whole, whole):
            self._write(ids[i : i + whole], whole)
        rest = ids[len(ids) - len(ids) % whole :]
        self.held, self.size = [rest], len(rest)

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.file.write_batch(
            pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)],
                schema=self.schema,
            )
        )

    def close(self) -> None:
        """What is left goes into one last batch, padded to whole sequences, so that every batch but it is full."""
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        if len(ids):
            self._write(np.concatenate((ids, np.zeros(-len(ids) % self.length, self.dtype))), len(ids))
        self.file.close()
        self.stream.close()


class SequenceFile:
    """Random access to a file: by sequence, or by range of its stream of ids. It is unmapped when the last view of it goes."""

    def __init__(self, uri: str):
        where, path = fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.held: tuple[int, np.ndarray] | None = None

    def _values(self, batch: int) -> np.ndarray:
        if self.held is None or self.held[0] != batch:
            self.held = (batch, self.file.get_batch(batch).column(0).values.to_numpy(zero_copy_only=True))
        return self.held[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the mapped file) and mask of sequence i."""
        at = i % BATCH_SEQUENCES
        mask = self.file.get_batch(i // BATCH_SEQUENCES).column(1).slice(at, 1).flatten().to_numpy(zero_copy_only=False)
        return self._values(i // BATCH_SEQUENCES)[at * self.length : (at + 1) * self.length], mask

    def span(self, start: int, size: int) -> list[np.ndarray]:
        """Views that together are the ids from start on, size of them."""
        out, step = [], BATCH_SEQUENCES * self.length
        while size > 0:
            view = self._values(start // step)[start % step :][:size]
            if not len(view):
                raise EOFError("the span ends beyond the file")
            out.append(view)
            start, size = start + len(view), size - len(view)
        return out


def write_token_files(docs: DataFrame, folder: str, length: int = 2048, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Write the files below folder (a URI that all executors see) and return the manifest, with the ids before each document in `start`."""
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        coder = encoder(tokenizer)
        writer, uri, done, count = None, "", 0, 0
        try:
            for whole in batches:
                for batch in chunks(whole, limit=8 << 20):
                    if writer is None:
                        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow"
                        writer = _Writer(uri, length, coder.dtype)
                    ids, at = coder.encode(batch.column(1))
                    ends = at[1:]
                    with_end = np.insert(ids, ends, coder.dtype(end_id))
                    writer.append(with_end)
                    sizes = np.diff(at) + 1
                    start = done + np.cumsum(sizes) - sizes
                    n = len(sizes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * n, pa.int32()), pa.array([uri] * n), batch.column(0), pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.arange(count, count + n), pa.int64())],
                        names=["part", "file", "doc_id", "local_start", "n_tokens", "doc_no"],
                    )
                    done, count = done + int(sizes.sum()), count + n
        finally:
            if writer is not None:
                writer.close()

    n = partitions(spark)
    ordered = texts(docs).withColumn("_tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    manifest = cut(ordered.mapInArrow(write, MANIFEST), "manifest")
    # one row per file: a window without a partition is small
    sizes = manifest.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    base = sizes.select("part", (F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_base"))
    return manifest.join(base, "part").withColumn("start", F.col("_base") + F.col("local_start")).drop("_base")


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, the ids read from the files that the manifest names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, SequenceFile] | None = None
        for batch in batches:
            crc, sizes = [], []
            for uri, start, n in zip(batch.column("file").to_pylist(), batch.column("local_start").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
                if opened is None or opened[0] != uri:
                    opened = (uri, SequenceFile(uri))
                value = size = 0
                for view in opened[1].span(start, n):
                    value, size = zlib.crc32(view.astype("<u4"), value), size + len(view)
                crc.append(value)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return manifest.select("doc_id", "start", "file", "local_start", "n_tokens").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_digests(write_token_files(table(spark, sf_dir, "documents"), fresh_path(spark, "token-files")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_token_files": op6_token_files}
SQL: dict[str, str] = {}

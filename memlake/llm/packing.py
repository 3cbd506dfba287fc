"""Best-fit packing of documents into sequences of bounded length.

Texts become token pieces of at most ``capacity`` tokens; only the slim piece rows move. Each
packing task takes a stream of pieces and keeps a fixed number of open bins: stacks keyed by
free space, with a bitset of the spaces in use. A piece goes to the open bin it leaves the
least space in; when a new bin would be one too many, the fullest closes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from memlake.llm.subwords import parcels, subwords
from memlake.llm.token_files import append_end
from memlake.session import cut_lineage

CAPACITY, OPEN_BINS = 1024, 512
#: Pieces in one packing task. What is lost at its end is at most its open bins' free space.
TASK_PIECES = 200_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all texts with ``end_id`` after each. Only a
    text of more than ``capacity`` tokens is cut; then its first piece takes the remainder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = subwords(vocabulary)
        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in parcels(texts):
                ids, counts = append_end(*encoder.encode(texts[i:j]), end_id)
                raw, at, rows = memoryview(ids.astype("<u4").tobytes()), 0, []
                for doc_id, n in zip(doc_ids[i:j], counts.tolist()):
                    cut = n % capacity or capacity
                    bounds = [0, *range(cut, n + 1, capacity)]
                    rows += [(doc_id, k, s, e - s, zlib.crc32(raw[4 * (at + s):4 * (at + e)])) for k, (s, e) in enumerate(zip(bounds, bounds[1:]))]
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    text = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return text.mapInArrow(work, PIECES)


class Packer:
    """Online best fit with ``open_bins`` bins at most."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
        self.spaces, self.n_open, self.n_bins = 0, 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``length`` tokens."""
        fitting = self.spaces >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            own = self._take(free)
        else:
            own, free = self.n_bins, self.capacity
            self.n_bins += 1
        left = free - length
        if left:
            if self.n_open == self.open_bins:
                self._take((self.spaces & -self.spaces).bit_length() - 1)  # closes for good
            self.stacks[left].append(own)
            self.spaces |= 1 << left
            self.n_open += 1
        return own, self.capacity - free

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        own = stack.pop()
        if not stack:
            self.spaces &= ~(1 << free)
        self.n_open -= 1
        return own


def pack_lengths(lengths: Iterable[int], packer: Packer) -> tuple[np.ndarray, np.ndarray]:
    placed = np.array([packer.place(n) for n in lengths], np.int64).reshape(-1, 2)
    return placed[:, 0], placed[:, 1]


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. A null doc_id is kept. Repeated rows are packed
    each. The pieces are dealt to tasks by hash, so no source or id decides where they go.
    """
    held = cut_lineage(pieces(docs, vocabulary, end_id, capacity))
    tasks = max(1, -(-held.count() // TASK_PIECES))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, task = Packer(capacity, open_bins), TaskContext.get().partitionId()
        for b in batches:
            own, offset = pack_lengths(b.column(3).to_pylist(), packer)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own + (task << 40)), pa.array(offset)], names=[*b.schema.names, "sequence_id", "offset"])

    dealt = held.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32"))
    return dealt.mapInArrow(work, PIECES + ", sequence_id bigint, offset bigint")

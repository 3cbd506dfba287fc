"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the benchmark's word windows. A table over blocks of two words tells how far
the search may jump when the block ends at a position; where it may not jump, the bucket of
the pattern suffix gives the windows to compare directly. The pattern set is worked off in
parts of bounded size, each sent to the tasks whole; documents stay where they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW, BLOCK = 10, 2
#: Windows in one part of the pattern set: about 10 MB in a task.
PART_WINDOWS = 100_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER)) if text else []


def windows(item: list[str], size: int = WINDOW) -> list[tuple[str, ...]]:
    """Every run of ``size`` words; a shorter item is one window; none without words."""
    if not item:
        return []
    return [tuple(item[i:i + size]) for i in range(max(1, len(item) - size + 1))]


@dataclass
class WuManber:
    """Tables for patterns of one length. A pattern of one word is a block of its own."""

    length: int
    shift: dict = field(default_factory=dict)
    buckets: dict = field(default_factory=dict)

    @classmethod
    def build(cls, length: int, patterns: dict[tuple[str, ...], list]) -> WuManber:
        own = cls(length)
        block = min(BLOCK, length)
        for pattern, items in patterns.items():
            for end in range(block, length + 1):
                key = pattern[end - block:end]
                own.shift[key] = min(own.shift.get(key, length), length - end)
            own.buckets.setdefault(pattern[length - block:], []).append((pattern, items))
        return own

    def find(self, text: list[str]) -> Iterator[tuple[int, list]]:
        """(start, items) of each occurrence."""
        m, block = self.length, min(BLOCK, self.length)
        far, shift = m - block + 1, self.shift
        end, n = m, len(text)
        while end <= n:
            key = tuple(text[end - block:end])
            jump = shift.get(key, far)
            if jump:
                end += jump
                continue
            for pattern, items in self.buckets[key]:
                if tuple(text[end - m:end]) == pattern:
                    yield end - m, items
            end += 1


def tables(items: list[tuple[object, list[str]]], size: int = WINDOW) -> list[WuManber]:
    """One search table per pattern length; equal windows of several items are one pattern."""
    by_length: dict[int, dict] = {}
    for item_id, item in items:
        for w in windows(item, size):
            by_length.setdefault(len(w), {}).setdefault(w, []).append(item_id)
    return [WuManber.build(n, patterns) for n, patterns in sorted(by_length.items())]


def parts(benchmark: DataFrame, size: int = WINDOW, limit: int = PART_WINDOWS) -> Iterator[list[tuple[object, list[str]]]]:
    """The items, streamed from the table and dealt into parts of about ``limit`` windows."""
    part, n = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        item = words(row[1])
        part.append((row[0], item))
        n += len(windows(item, size))
        if n >= limit:
            yield part
            part, n = [], 0
    if part:
        yield part


def search(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, limit: int = PART_WINDOWS) -> DataFrame:
    """``docs`` with __n_words, __spans (disjoint [start, end) runs of hit words, in order) and
    __items (distinct ids, as text) from all parts of ``benchmark``.

    Null and empty texts have no words. Items without words match nothing; a null item id
    reads as the text "null". Equal ids are one item.
    """
    spark = docs.sparkSession
    out = docs.withColumns({"__n_words": F.lit(0).cast("bigint"), "__spans": F.array().cast("array<bigint>"), "__items": F.array().cast("array<string>")})
    names, schema = out.columns, out.schema
    at_text, at_n = docs.columns.index("text"), len(docs.columns)
    for part in parts(benchmark, size, limit):
        held = spark.sparkContext.broadcast(tables(part, size))

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n_words, spans, items = [], [], []
                for text, old, ids in zip(b.column(at_text), b.column(at_n + 1), b.column(at_n + 2)):
                    text = words(text.as_py())
                    hits, found = list(zip(*[iter(old.as_py())] * 2)), set(ids.as_py())
                    for t in held.value:
                        for start, own in t.find(text):
                            hits.append((start, start + t.length))
                            found.update("null" if i is None else str(i) for i in own)
                    n_words.append(len(text))
                    spans.append(merged(hits))
                    items.append(sorted(found))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:at_n], pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=names)

        out = out.mapInArrow(work, schema)
    return out


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Disjoint spans in order, flat: start, end, start, end ..."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def n_hit(spans: str = "__spans"):
    """Words inside the flat spans: ends less starts."""
    signs = F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signs, F.lit(0).cast("bigint"), lambda a, x: a + x)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    found = search(docs.select("doc_id", "text"), benchmark, size)
    hit = n_hit()
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), F.col("__spans").alias("spans"))


def redact(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Documents without any benchmark window; those that hold one go."""
    return search(docs, benchmark, size).where(F.size("__spans") == 0).select(*[f"`{c}`" for c in docs.columns])


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()

"""Near-dedup by SimHash, with a segment-popcount embedding as the search space.

A 64-bit fingerprint is cut into 32 segments of two bits and mapped to its bit counts per
segment. The Manhattan distance of two such points never exceeds the fingerprints' Hamming
distance. Candidates meet in the grid of that space: its axes are dealt into k groups, and
four changes leave k - 4 groups untouched, so two points within four share the cell of at
least one choice of k - 4 groups, whatever k is; it grows with the number of points. Within a cell the Manhattan distance comes first and the
exact Hamming distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from memlake.llm.common import WHITE
from memlake.session import cut_lineage, settle, unsent

MAX_BITS, SHINGLE = 4, 4
#: Points that a cell may hold by chance, and the most groups beyond the changes.
BY_CHANCE, MOST_GROUPS = 16, 9
#: A cell with more points is worked on in square blocks of this side, spread over tasks.
BLOCK = 512
#: Edges, each in both directions, that a task of a round of ``components`` takes.
TASK_EDGES = 100_000
#: Labels, of two longs, that a round broadcasts at most: the driver holds several rounds' of them,
#: each some 80 bytes a label, until its garbage is collected.
FEW_LABELS = 50_000
LOW = 0x5555555555555555
_BLANKS = str.maketrans({c: " " for c in WHITE})
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the words' shingles, repeats included; none without words."""
    words = [w for w in (text or "").translate(_LOWER).translate(_BLANKS).split(" ") if w]
    if not words:
        return np.empty(0, np.uint64)
    line = " ".join(words).encode("utf-8", "surrogatepass")
    n = max(1, len(words) - shingle + 1)
    ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist() + [len(line)]
    starts = [0, *(e + 1 for e in ends[:n - 1])]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends[min(shingle, len(words)) - 1:])), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set where over half the hashes have it set."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i:i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text; 0 without words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) per row, held: fp as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return cut_lineage(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(work, "doc_id bigint, fp bigint"))


def embed(fp: Column) -> Column:
    """Bit counts of the two-bit segments, each count written in unary (00, 01, 11): the
    Manhattan distance of two embeddings is then the bit count of their xor."""
    odd = F.shiftrightunsigned(fp, 1)
    both, either = fp.bitwiseAND(odd).bitwiseAND(F.lit(LOW)), fp.bitwiseOR(odd).bitwiseAND(F.lit(LOW))
    return F.shiftleft(both, 1).bitwiseOR(either)


def group_count(n_points: int, max_bits: int = MAX_BITS) -> int:
    """Groups of the grid for so many points: the fewest, from three beyond the changes on, with
    which a cell holds few of them by chance. The count of a segment has 1.5 bits."""
    for spare in range(3, MOST_GROUPS):
        bits = 1.5 * 32 * spare / (max_bits + spare)
        if n_points <= BY_CHANCE * 2 ** bits:
            return max_bits + spare
    return max_bits + MOST_GROUPS


def group_masks(groups: int) -> list[int]:
    """Bits of the segments dealt to each group."""
    masks = [0] * groups
    for segment in range(32):
        masks[segment % groups] |= 3 << (2 * segment)
    return masks


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(fps: DataFrame, max_bits: int, groups: int) -> DataFrame:
    """(cell, fp): a row for each choice of groups that ``max_bits`` changes can leave whole."""
    masks, point = group_masks(groups), embed(F.col("fp"))
    keys = []
    for i, chosen in enumerate(combinations(range(groups), groups - max_bits)):
        mask = 0
        for g in chosen:
            mask |= masks[g]
        keys.append(F.xxhash64(F.lit(i), point.bitwiseAND(F.lit(signed(mask)))))
    return fps.select(F.explode(F.array(*keys)).alias("cell"), "fp")


def forest(left: np.ndarray, right: np.ndarray | None, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to connect what is within ``max_bits``: of one block, or between two. Both
    the distances and the union-find work on the block's own rows, so a dense block gives
    about as many links as it has points, not all its pairs."""
    xs = left if right is None else np.concatenate([left, right])
    n, k = len(xs), len(left)
    low = np.uint64(LOW)
    odd = xs >> np.uint64(1)
    points = ((xs & odd & low) << np.uint64(1)) | ((xs | odd) & low)
    a, b = (points, points) if right is None else (points[:k], points[k:])
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= max_bits)
    if right is None:
        i, j = i[i < j], j[i < j]
    else:
        j = j + k
    near = np.bitwise_count(xs[i] ^ xs[j]) <= max_bits
    i, j = i[near], j[near]
    if not len(i):
        return xs[:0], xs[:0]
    root = np.arange(n)
    while True:  # least label over links, then jumps: both ends of a link agree at the end
        before = root.copy()
        low_end = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low_end)
        np.minimum.at(root, j, low_end)
        root = root[root]
        if (root == before).all():
            break
    moved = np.flatnonzero(root != np.arange(n))
    return xs[moved], xs[root[moved]]


def links(fps: DataFrame, max_bits: int = MAX_BITS, groups: int | None = None) -> DataFrame:
    """(a, b) pairs of distinct fingerprints in one component; every pair within ``max_bits``
    is connected through them. A pair may join two points of one chain that are further apart.
    """
    grid = cells(fps, max_bits, groups or group_count(fps.count(), max_bits))
    # Almost all cells hold one point; those that are crowded are few and get blocks.
    crowded = grid.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    crowded = settle(crowded.select(F.col("cell").alias("c_cell"), F.ceil(F.col("n") / BLOCK).cast("int").alias("sides")))
    marked = grid.join(crowded, F.col("cell") == F.col("c_cell"), "left")

    calm = marked.where("sides IS NULL").select("cell", "fp").repartition("cell").sortWithinPartitions("cell")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells arrive as runs; the last run of a batch may go on in the next."""
        cell, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            cell = np.concatenate([cell, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            last = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            yield edges_batch(runs(cell[:last], fp[:last], max_bits))
            cell, fp = cell[last:], fp[last:]
        yield edges_batch(runs(cell, fp, max_bits))

    def between(t: pa.Table) -> pa.Table:
        own = t.column("side").to_numpy() == t.column("row").to_numpy()
        xs = t.column("fp").to_numpy().view(np.uint64)
        out = [forest(xs, None, max_bits)] if own.all() else [forest(xs[own], xs[~own], max_bits)]
        return pa.Table.from_batches([edges_batch(out)])

    # Block (i, j), i <= j, of a crowded cell gets the points of sides i and j: none is larger
    # than about two sides, however large the cell.
    side = F.pmod(F.xxhash64("fp", F.lit("side")), F.col("sides")).cast("int")
    dealt = marked.where("sides IS NOT NULL").select("cell", "fp", "sides", side.alias("side"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("sides") - 1), lambda o: F.struct(F.least(o, F.col("side")).alias("row"), F.greatest(o, F.col("side")).alias("col")))
    blocks = dealt.select("cell", "fp", "side", F.explode(pairs).alias("p")).select("cell", "fp", "side", "p.row", "p.col")
    schema = "a bigint, b bigint"
    return calm.mapInArrow(within, schema).union(blocks.groupBy("cell", "row", "col").applyInArrow(between, schema)).distinct()


def runs(cell: np.ndarray, fp: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of each run of equal cells; runs of one are passed over."""
    cuts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]]) if len(cell) else np.zeros(1, np.int64)
    sizes = np.diff(cuts)
    out = []
    at = cuts[:-1][sizes == 2]  # most shared cells hold two
    if len(at):
        near = np.bitwise_count(fp[at] ^ fp[at + 1]) <= max_bits
        out.append((fp[at][near], fp[at + 1][near]))
    return out + [forest(fp[s:s + n], None, max_bits) for s, n in zip(cuts[:-1][sizes > 2], sizes[sizes > 2])]


def edges_batch(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cat = lambda k: np.concatenate([np.empty(0, np.uint64), *(p[k] for p in parts)]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(cat(0)), pa.array(cat(1))], names=["a", "b"])


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(fp, root) with the least member as root, for every fingerprint of ``edges``.

    Each round takes the least root among neighbours, then jumps to that root's root; a round
    ends in a checkpoint, of as many files as the edges need, and few labels are broadcast: the
    many shuffles of small tables otherwise leave a file for each of Spark's partitions. It ends when a round changes no row, and raises at ``max_rounds``.
    """
    # Both directions come from one evaluation: another one may connect the same by other edges.
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(edges.select(F.explode(ways).alias("e")).select("e.a", "e.b"))
    tasks = max(1, -(-both.count() // TASK_EDGES))
    both = both.coalesce(tasks)
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("fp"), F.least("a", "b").alias("root")).coalesce(tasks))
    few = labels.count() <= FEW_LABELS
    small = F.broadcast if few else unsent
    for _ in range(max_rounds):
        near = both.join(small(labels), F.col("b") == F.col("fp")).groupBy("a").agg(F.min("root").alias("near"))
        step = near.join(small(labels), F.col("fp") == F.col("a")).select("fp", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("fp").alias("j_fp"), F.col("root").alias("j_root"))
        step = step.join(small(jump), F.col("next") == F.col("j_fp"), "left").select("fp", "root", F.least("next", "j_root").alias("next"))
        step = cut_lineage(step.coalesce(tasks))
        changed = not step.where("next <> root").isEmpty()
        labels = step.select("fp", F.col("next").alias("root"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (smallest doc_id reachable over links of
    ``max_bits`` or fewer differing bits).

    Null, empty and blank texts have fingerprint zero and link like any other. A null doc_id
    counts only where its component has no other. An empty table gives no rows.
    """
    rows = fingerprints(docs, shingle)
    # Equal fingerprints are one point, combined in the map tasks.
    points = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(points.select("fp"), max_bits))
    linked = cut_lineage(points.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = cut_lineage(linked.groupBy("root").agg(F.min("least").alias("component_id")))  # written, so that a hot root can be split
    named = cut_lineage(linked.join(ids, "root").select(F.col("fp").alias("p_fp"), "component_id"))
    return rows.join(named, F.col("fp") == F.col("p_fp"), "left").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

"""Conversation structure repair: the cheapest edits that make the roles alternate.

The rows of a conversation and the states of the role pattern span a lattice; keeping,
reroling, deleting or inserting a turn is an edge with a cost. A bidirectional Dijkstra search
finds the cheapest way through it: a forward and a reverse heap meet, every crossing of equal
cost is finished, and of the cheapest ways the one with the least audit string is walked.

One shuffle brings a conversation's rows together in order. A task streams them: up to
``limit`` rows are one lattice. A longer conversation is cut into chunks of turn numbers, whose
4 x 4 cost matrices are found in parallel and chained from the end, so that each chunk knows the
exact cost of every state it may leave in; the stream then searches chunk after chunk and holds
one of them. The digest of the repaired text runs along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from memlake.llm.common import WHITE
from memlake.session import settle

#: Fixed values of the contract: costs of the edits and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Of each state: the role that an inserted or reroled turn takes, and the state after it.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
DONE = {START: 0, ASSISTANT: 0}
#: Rows of one lattice, and turn numbers of a longer conversation's chunk.
LIMIT, WIDTH = 2_000, 1_000
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): the rows after damage. A dropped row stays as one
    that isn't present, so that its conversation is answered."""
    t = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(t("conv_id"), F.lit(":"), t("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(t("text"), ".!?", "")).otherwise(t("text"))
    role = F.when(kind == 4, "user").otherwise(t("role"))
    copies = F.when(kind == 0, F.array(F.lit(False))).when(kind == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("present"))


def place(turn: str = "turn") -> Column:
    """A turn's place among others, a null first."""
    return F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"))


def faults(rows: DataFrame) -> DataFrame:
    """Adds initial, blank, truncated, and ``late`` for a role and text seen at an earlier turn.
    Rows that repeat one of the same turn stand next to it and are told by the stream."""
    keyed = rows.withColumns({"initial": F.substring("role", 1, 1), "blank": F.translate("text", WHITE, "") == "", "h": F.sha2("text", 256)})
    keyed = keyed.withColumn("truncated", ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"))
    again = keyed.where("present").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("k"))
    first = again.agg(F.min(place()).alias("first"), F.max(place()).alias("last")).where("first < last")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("k"))
    return keyed.join(first, same, "left").withColumn("late", F.coalesce(place() > F.col("first"), F.lit(False))).drop("c", "r", "k", "h", "first", "last")


def edges(row: tuple | None, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(letter, rows consumed, next state, cost) of the edits from a node; row: initial,
    whether it must go, whether it is truncated."""
    yield "I", 0, NEXT[state][1], INSERT
    if row is None:
        return
    initial, bad, truncated = row
    yield "D", 1, state, DELETE
    if not bad:
        more = TRUNCATED if truncated else 0
        if (state, initial) in KEEP:
            yield "K", 1, KEEP[state, initial], more
        yield "R", 1, NEXT[state][1], REROLE + more


def reversed_edges(rows: list[tuple], i: int, state: int) -> Iterator[tuple[tuple[int, int], int]]:
    """(node, cost) of the nodes that lead to (i, state)."""
    for before in range(4):
        for _, step, after, cost in edges(rows[i - 1] if i else None, before):
            if after == state and (step == 0 or i):
                yield (i - step, before), cost


class Side:
    """One of the two searches: distances, and the nodes whose distance is final."""

    def __init__(self, sources: dict[tuple[int, int], int]):
        self.distance = dict(sources)
        self.heap = [(d, node) for node, d in sources.items()]
        self.heap.sort()
        self.final: set[tuple[int, int]] = set()

    def top(self) -> float:
        while self.heap and self.heap[0][1] in self.final:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self) -> tuple[int, int]:
        _, node = heappop(self.heap)
        self.final.add(node)
        return node

    def reach(self, node: tuple[int, int], d: int) -> None:
        if d < self.distance.get(node, 1 << 60):
            self.distance[node] = d
            heappush(self.heap, (d, node))


def search(rows: list[tuple], entry: int, ends: dict[int, int]) -> tuple[int, str, int]:
    """(cost, audit, last state) of the cheapest way from a state before the rows to one after
    them, where leaving in a state costs ``ends``; of equal ones that with the least audit."""
    n = len(rows)
    forward, backward = Side({(0, entry): 0}), Side({(n, q): d for q, d in ends.items()})
    best = float("inf")
    while (f := forward.top()) + (b := backward.top()) <= best and f + b < float("inf"):
        if f <= b:
            i, q = node = forward.settle()
            for _, step, to, cost in edges(rows[i] if i < n else None, q):
                forward.reach((i + step, to), f + cost)
        else:
            node = backward.settle()
            for before, cost in reversed_edges(rows, *node):
                backward.reach(before, b + cost)
        if node in forward.distance and node in backward.distance:
            best = min(best, forward.distance[node] + backward.distance[node])
    df, dr, known = forward.distance, backward.distance, backward.final
    # Nodes that only the forward search settled lie on a cheapest way if an edge of theirs does.
    on_way: set[tuple[int, int]] = set()

    def tight(node: tuple[int, int], spent: int, cost: int) -> bool:
        if node in known:
            return spent + cost + dr[node] == best
        return node in on_way and spent + cost == df[node]

    for i, q in sorted(forward.final - known, key=lambda x: (-x[0], -df[x])):
        arrives = i == n and df[i, q] + ends.get(q, 1 << 60) == best
        if arrives or any(tight((i + step, to), df[i, q], cost) for _, step, to, cost in edges(rows[i] if i < n else None, q)):
            on_way.add((i, q))
    i, q, spent, audit = 0, entry, 0, []
    while i < n or spent + ends.get(q, 1 << 60) != best:
        letter, step, to, cost = min(e for e in edges(rows[i] if i < n else None, q) if tight((i + e[1], e[2]), spent, e[3]))
        audit.append(letter)
        i, q, spent = i + step, to, spent + cost
    return spent, "".join(audit), q


def costs(rows: list[tuple]) -> list[int | None]:
    """4 x 4: cheapest cost from each state before the rows to each one after them."""
    out = []
    for entry in range(4):
        side = Side({(0, entry): 0})
        while side.top() < float("inf"):
            i, q = side.settle()
            for _, step, to, cost in edges(rows[i] if i < len(rows) else None, q):
                side.reach((i + step, to), side.distance[i, q] + cost)
        out += [side.distance.get((len(rows), q)) for q in range(4)]
    return out


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows that share the keys and stand together, as an iterator of each run."""
    from itertools import groupby

    every = (row for b in batches for k in range(0, b.num_rows, 512) for row in b.slice(k, 512).to_pylist())
    return groupby(every, key=lambda r: tuple(r[k] for k in keys))


def lattice_row(row: dict, before: dict | None) -> tuple[str, str, bool]:
    """(initial, first fault, truncated) of a row, with the one before it."""
    twin = before is not None and all(before[k] == row[k] for k in ("turn", "role", "text"))
    fault = "blank" if row["blank"] else "duplicate" if row["late"] or twin else "truncated" if row["truncated"] else ""
    return row["initial"], fault, fault == "truncated"


def chunk_ends(rows: DataFrame) -> DataFrame:
    """(c, k, ends) of each chunk of the long conversations: what is still to be paid after it
    in each state. Matrices are found a chunk a run, then chained from the last one back."""

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (c, k), part in runs(batches, "conv_id", "chunk"):
            held, before = [], None
            for row in part:
                initial, fault, truncated = lattice_row(row, before)
                held.append((initial, fault in ("blank", "duplicate"), truncated))
                before = row
            yield pa.RecordBatch.from_pylist([{"c": c, "k": k, "m": costs(held)}], schema=matrix_schema)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (c,), part in runs(batches, "c"):
            ends = [DONE.get(q) for q in range(4)]
            for row in part:
                yield pa.RecordBatch.from_pylist([{"c": c, "k": row["k"], "ends": ends}], schema=ends_schema)
                m = [row["m"][4 * q:4 * q + 4] for q in range(4)]
                ends = [min((x + e for x, e in zip(m[q], ends) if x is not None and e is not None), default=None) for q in range(4)]

    kind = rows.schema["conv_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    c = pa.field("c", to_arrow_type(rows.schema["conv_id"].dataType))
    matrix_schema = pa.schema([c, pa.field("k", pa.int64()), pa.field("m", pa.list_(pa.int64()))])
    ends_schema = pa.schema([c, pa.field("k", pa.int64()), pa.field("ends", pa.list_(pa.int64()))])
    long = rows.where("present AND chunk IS NOT NULL").repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", F.asc_nulls_first("turn"), "role", "text")
    found = long.mapInArrow(matrices, f"c {kind}, k long, m array<long>")
    return found.repartition("c").sortWithinPartitions("c", F.desc("k")).mapInArrow(chained, f"c {kind}, k long, ends array<long>")


def repair(conversations: DataFrame, limit: int = LIMIT, width: int = WIDTH) -> DataFrame:
    """One row per conv_id of the input: gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    A null conv_id, turn, role or text stands for one space where text is needed; null ids are
    one conversation, null turns come first. Rows of one turn are taken by role and text. Roles
    count by their first character; others than s, u and a must be reroled or deleted. A
    conversation without rows after damage has zeros, an empty audit and the digest of an empty
    text; an empty table gives no rows. Rows that share one turn number share a chunk.
    """
    rows = faults(damaged(conversations))
    long = settle(rows.groupBy(F.col("conv_id").alias("c")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("c", F.lit(True).alias("long")), row_bytes=32)
    rows = rows.join(long, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    chunk = F.when(F.col("long"), F.when(F.col("turn").isNull(), -(1 << 62)).otherwise(F.floor(F.col("turn") / width)))
    rows = rows.withColumn("chunk", chunk.cast("bigint")).drop("long")
    if long.isEmpty():
        rows = rows.withColumn("ends", F.lit(None).cast("array<bigint>"))
    else:
        ends = chunk_ends(rows)
        rows = rows.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")), "left").drop("c", "k")
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = conversations.schema["conv_id"].dataType
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([pa.field("conv_id", to_arrow_type(id_type)), *[pa.field(c, pa.int64()) for c in numbers], pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for (conv,), part in runs(batches, "conv_id"):
            out.append({"conv_id": conv, **repaired(part)})
            if len(out) == 1_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return ordered.mapInArrow(work, f"conv_id {id_type.simpleString()}, {RESULT}")


def repaired(rows: Iterator[dict]) -> dict:
    """The answer for one conversation's rows in order. Holds one chunk of them."""
    from itertools import groupby

    count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
    low = high = before = last = None
    turns, state, audit, sha, empty = 0, START, [], hashlib.sha256(), True
    for _, part in groupby((r for r in rows if r["present"]), key=lambda r: r["chunk"]):
        held, lattice = [], []
        for row in part:
            initial, fault, truncated = lattice_row(row, before)
            if fault:
                count[fault] += 1
            count["illegal"] += before is not None and before["initial"] + initial not in LEGAL
            if (t := row["turn"]) is not None:
                turns += t != last
                low, high, last = t if low is None else low, t, t
            held.append((row["role"], row["text"]))
            lattice.append((initial, fault in ("blank", "duplicate"), truncated))
            before = row
        ends = DONE if row["ends"] is None else {q: d for q, d in enumerate(row["ends"]) if d is not None}
        _, edits, _ = search(lattice, state, ends)
        k = 0
        for letter in edits:
            role, text = held[k] if letter != "I" else ("", "")
            row_of = lattice[k] if letter != "I" else None
            _, step, to, cost = next(e for e in edges(row_of, state) if e[0] == letter)
            count["cost"] += cost
            if letter != "D":
                role = role if letter == "K" else NEXT[state][0]
                sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
            k, state = k + step, to
        audit.append(edits)
    gaps = 0 if low is None else high - low + 1 - turns
    return {"gaps": gaps, **count, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

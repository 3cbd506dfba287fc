"""Conversation repair against a plain search over every edit sequence and against itself in chunks."""

import hashlib
import re
import zlib
from functools import lru_cache
from itertools import pairwise

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from memlake.llm import conversation_repair as cr
from memlake.llm.common import table
from tests.conftest import SF

SCHEMA = "conv_id bigint, turn bigint, role string, text string, present string, chunk int, c long"


def plain(rows):
    """The contract in plain Python, the cheapest audits by recursion over all edits."""
    kept = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    fault, seen = [], set()
    for _, role, text in kept:
        black = re.sub(r"[\x20\x09-\x0d]", "", text)
        fault.append("blank" if not black else "duplicate" if (role, text) in seen else "truncated" if black[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def go(i, last, inserts=0):
        """(cost, audit, repaired) from row i on after the last role's initial ("" at the start)."""
        found = [(0, "", ())] if i == len(kept) and last in ("", "a") else []
        other = "assistant" if last == "u" else "user"
        steps = [("I", 5, i, other, "")] if inserts < 2 else []
        if i < len(kept):
            _, role, text = kept[i]
            steps.append(("D", 2, i + 1, None, None))
            if fault[i] not in ("blank", "duplicate"):
                more = 5 if fault[i] == "truncated" else 0
                steps.append(("R", 1 + more, i + 1, other, text))
                if role and (last + role[:1]) in ("s", "u", "su", "ua", "au"):
                    steps.append(("K", more, i + 1, role, text))
        for letter, cost, to, role, text in steps:
            c, a, r = go(to, last if role is None else role[:1], inserts + 1 if letter == "I" else 0)
            found.append((c + cost, letter + a, r if role is None else ((role, text), *r)))
        return min(found, key=lambda x: x[:2], default=(1 << 40, "", ()))

    cost, audit, done = go(0, "")
    turns = [t for t, _, _ in kept if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{k: fault.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(kept)), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()}


def answers(df):
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


def by_conversation(rows):
    found = {}
    for r in rows:
        found.setdefault(r[0], []).append(r)
    return {c: plain(rs) for c, rs in found.items()}


def test_given_table(spark):
    df = table(spark, SF, "conversations")
    want = by_conversation([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert answers(cr.repair(df)) == want
    assert answers(cr.repair(df, limit=2, width=2)) == want


def test_odd_rows_and_chunks(spark):
    words = ["Hello there.", "And then", "", None, " \t", "Well?", "Fine!\n", "Why "]
    roles = ["user", "assistant", "system", None, "", "tool", "user", "assistant"]
    rows = [(c, None if (c + t) % 11 == 0 else t % 9, roles[(c * 5 + t * 3 + t // 3) % 8], words[(c + t * t) % 8]) for c in range(40) for t in range(c % 17)]
    rows += [(None, t, roles[t % 3], "x" * 300_000 + "." if t == 4 else words[t % 8]) for t in range(9)] + [(99, 5, "user", "Same.")] * 7 + [(98, None, "user", "Odd")] * 3
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(4)
    want = by_conversation(rows)
    assert answers(cr.repair(df)) == want
    assert answers(cr.repair(df, limit=1, width=3)) == want
    assert cr.repair(df.where(F.lit(False))).count() == 0


def test_long_conversation_in_chunks(spark):
    """One conversation of 6,000 rows: whole lattice and chunks agree."""
    rows = [(7, t, ["user", "assistant", "user", "system"][(t * t // 7) % 4], f"Turn {t % 4001}{'.' if t % 6 else ''}", "", 0, 0) for t in range(6_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    whole = answers(cr.repair(df, limit=100_000))
    assert answers(cr.repair(df)) == whole and whole[7]["cost"] > 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.booleans(), st.booleans()), max_size=9))
def test_search_against_all_ways(rows):
    @lru_cache(None)
    def ways(i, q, inserts=0):
        found = [(0, "")] if i == len(rows) and q in cr.DONE else []
        for letter, step, to, cost in cr.edges(rows[i] if i < len(rows) else None, q):
            if step or inserts < 3:
                c, a = ways(i + step, to, 0 if step else inserts + 1)
                found.append((c + cost, letter + a))
        return min(found, default=(1 << 40, ""))

    cost, audit, _ = cr.search(rows, cr.START, cr.DONE)
    assert (cost, audit) == ways(0, cr.START)
    m = cr.costs(rows)
    assert min(x for q, x in enumerate(m[:4]) if q in cr.DONE and x is not None) == cost

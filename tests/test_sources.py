"""Parsers and walks against small statements of the rules."""

import json
import random
import re

from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.operators import notes as n
from memlake.sources import exports as x, files as f


def bullets(text):
    """Items of a list export, line by line."""
    head, items, lines, i = "", [], text.split("\n"), 0
    is_h, is_b = re.compile(r"^(#{1,6})\s+(.+)$"), re.compile(r"^(\s*)([-*+]|\d+\.)\s+(.+)$")
    while i < len(lines):
        s = lines[i].strip()
        if not s:
            i += 1
        elif is_h.match(s):
            head, i = is_h.match(s).group(2).strip(), i + 1
        elif is_b.match(lines[i]):
            m = is_b.match(lines[i])
            own, kids, j = m.group(3).strip(), [], i + 1
            while j < len(lines):
                t = lines[j].strip()
                if not t:
                    j += 1
                    continue
                if is_h.match(t):
                    break
                b = is_b.match(lines[j])
                if b and len(b.group(1)) <= len(m.group(1)):
                    break
                if b:
                    kids.append(b.group(3).strip())
                elif kids:
                    kids[-1] += " " + t
                else:
                    own += " " + t
                j += 1
            lead = own.rstrip(":")
            items += [(head, k if not lead or k.lower().startswith(lead.lower()) else f"{lead}: {k}") for k in kids] or [(head, own)]
            i = j
        else:
            j = i + 1
            while j < len(lines) and lines[j].strip() and not is_h.match(lines[j].strip()) and not is_b.match(lines[j]):
                s += " " + lines[j].strip()
                j += 1
            items.append((head, s))
            i = j
    return items


DOCS = [
    "# Plans\n- Travel:\n  - Rome in May\n  - travel light\n  more\n- Solo\n\nfree text\nsecond line\n\nthird",
    "intro\n* a\n  continued\n\n  again\n  1. deep\n     - deeper\n* b\n# Next\npara\n- c:\n## Sub\n- d\n  - e",
    "- one\n- two:\n  - x\n - y\n- three",
    "\n\nplain\n# H\n\n- only",
]


def test_bullets_follow_the_line_rules(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    got = {}
    for r in n.parse_bullets(df).orderBy("doc_id", "item_no").collect():
        got.setdefault(r.doc_id, []).append((r.heading, r.text))
    assert got == {i: bullets(d) for i, d in enumerate(DOCS)}


def test_bullets_of_documents(spark, tables):
    from memlake.plans.p_sources import bullet_docs

    docs = bullet_docs(tables)
    got = {}
    for r in n.parse_bullets(docs).orderBy("doc_id", "item_no").collect():
        got.setdefault(r.doc_id, []).append((r.heading, r.text))
    want = {r.doc_id: bullets(r.text) for r in docs.collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_bullets_of_one_long_document(spark):
    """One list of 12,000 items in several chunks: the open top bullet lies chunks before its children."""
    rng = random.Random(6)
    lines = ["# Head", "- top:"] + ["  " * rng.choice([1, 1, 1, 2, 3]) + f"- item {k}" for k in range(11_000)] + ["", "loose words", "# Next"] + ["  " * rng.choice([0, 1, 2]) + f"- n {k}" for k in range(1_000)]
    text = "\n".join(lines)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r.heading, r.text) for r in n.parse_bullets(df).orderBy("item_no").collect()] == bullets(text)


def test_bullets_move_their_lines_once(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    plan = n.parse_bullets(df)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan  # no summaries of chunks go back to their lines


def test_active_path_survives_cycles(spark):
    nodes = spark.createDataFrame([("c", "a", "d"), ("c", "b", "a"), ("c", "d", "b"), ("c", "e", "d"), ("l", "1", None), ("l", "2", "1"), ("l", "3", "gone")], "conversation_id string, node_id string, parent_id string")
    leaves = spark.createDataFrame([("c", "e"), ("l", "2")], "conversation_id string, node_id string")
    got = {(r.conversation_id, r.node_id): r.position for r in x.active_path(nodes, leaves).collect()}
    assert got == {("c", "e"): 3, ("c", "d"): 2, ("c", "b"): 1, ("c", "a"): 0, ("l", "2"): 1, ("l", "1"): 0}


def test_long_chain_path(spark):
    nodes = spark.range(700).selectExpr("'c' AS conversation_id", "id AS node_id", "CASE WHEN id > 0 THEN id - 1 END AS parent_id")
    leaves = spark.createDataFrame([("c", 699)], "conversation_id string, node_id long")
    p = x.active_path(nodes, leaves)
    assert p.count() == 700 and p.where("node_id <> position").isEmpty()


def test_snippet_and_split(spark):
    text = "alpha " * 100 + "needle here " + "beta " * 200
    df = spark.createDataFrame([(text, "needle here"), (text, "needle beta"), ("short", "zzz")], "t string, q string")
    out = [r.s for r in df.select(tx.snippet(F.col("t"), F.col("q")).alias("s")).collect()]
    assert "needle here" in out[0] and out[0].startswith("...") and "beta" in out[1] and out[2] == "short"
    long = "para one. " * 30 + "\n\n" + "para two " * 60
    parts = spark.createDataFrame([(long,)], "t string").select(tx.split_to_room(F.col("t"), 400).alias("p")).first().p
    assert all(len(p) <= 400 for p in parts) and "".join("".join(parts).split()) == "".join(long.split())


def test_mail_files_and_mailbox(spark, tmp_path):
    (tmp_path / "m").mkdir()
    for i in range(3):
        (tmp_path / "m" / f"{i}.json").write_text(json.dumps({"id": f"m{i}", "subject": "s", "to": ["a"], "date": "2024-01-02T03:04:05", "body": "b"}))
    assert f.read_mail_snapshot(spark, str(tmp_path / "m")).count() == 3
    (tmp_path / "box.mbox").write_text("".join(f"From a@b Mon\nMessage-ID: <{i}>\nSubject: hi\n there\n\nbody {i}\n>From x\n\n" for i in range(4)))
    rows = {r.id: r for r in f.read_mbox(spark, str(tmp_path / "box.mbox")).collect()}
    assert len(rows) == 4 and rows["<2>"].subject == "hi there" and rows["<2>"].body == "body 2\nFrom x"


def test_scan_notes_and_report(spark, tmp_path, tables):
    root = tmp_path / "w"
    (root / "Area" / ".git").mkdir(parents=True)
    (root / "Area" / "a.md").write_text("# A\ntext")
    (root / "Area" / ".git" / "x.md").write_text("no")
    (root / "b.PDF").write_text("x")
    got = {r.path: (r.area, r.extension) for r in f.scan_assets(spark, str(root)).collect()}
    assert got == {"Area/a.md": ("Area", ".md"), "b.PDF": ("ROOT", ".pdf")}
    from memlake.operators import ledger as l

    ev = tables.f_evidence.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    rows = l.priority_order(tables.f_memory, ev)
    f.write_review_report(rows, str(tmp_path / "report"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*"))).splitlines()
    assert lines == [r.line for r in f.report_lines(rows).orderBy("best", F.desc("n_priority"), "conversation_id", "label_rank", "memory_id").collect()]


def test_append_twice_is_once(spark, tmp_path, tables):
    path = str(tmp_path / "journal")
    f.append_events(spark, path, tables.f_events)
    f.append_events(spark, path, tables.f_events.union(tables.f_events))
    assert spark.read.parquet(path).count() == tables.f_events.count()

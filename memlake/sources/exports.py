"""Rows from chat exports and agent transcripts. Everything takes a column of JSON text, so
the same code serves files, tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from memlake.functions import identity, text as tx
from memlake.operators.scan import first_per
from memlake.session import cut_lineage

TREE = (
    "conversation_id STRING, title STRING, current_node STRING, is_do_not_remember BOOLEAN, "
    "mapping MAP<STRING, STRUCT<parent: STRING, message: STRUCT<id: STRING, author: STRUCT<role: STRING>, create_time: DOUBLE, "
    "content: STRUCT<parts: ARRAY<STRING>>>>>"
)
ACTIVITY = "title STRING, time STRING, titleUrl STRING, subtitles ARRAY<STRUCT<name: STRING, url: STRING>>, safeHtmlItem ARRAY<STRUCT<html: STRING>>"
BLOCKS = "ARRAY<STRUCT<type: STRING, text: STRING>>"
PROJECT = "uuid STRING, name STRING, description STRING, updated_at STRING, docs ARRAY<STRUCT<filename: STRING, content: STRING>>"
MEMORY = "account_uuid STRING, conversations_memory STRING, project_memories MAP<STRING, STRING>, memory_files ARRAY<STRUCT<path: STRING, content: STRING>>"


def read_chat_tree(docs: DataFrame, json: str = "json") -> DataFrame:
    """One row per tree node: ids, parent, role, time, text and whether it is the open leaf.
    Conversations marked not to be remembered are left out."""
    d = docs.select(F.from_json(json, TREE).alias("d")).where("d IS NOT NULL AND NOT coalesce(d.is_do_not_remember, false)")
    n = d.select("d.conversation_id", "d.title", "d.current_node", F.explode("d.mapping").alias("node_id", "node"))
    parts = F.coalesce(F.col("node.message.content.parts"), F.array().cast("array<string>"))
    return n.select(
        "conversation_id", "title", "node_id", F.col("node.parent").alias("parent_id"), (F.col("node_id") == F.col("current_node")).alias("is_leaf"),
        F.col("node.message.author.role").alias("role"), F.col("node.message.create_time").alias("create_time"), tx.strip(F.array_join(parts, " ")).alias("text"))


def newest_leaf(nodes: DataFrame) -> DataFrame:
    """Open leaf of a parent-pointer export: the newest node that is nobody's parent."""
    parents = nodes.where(F.col("parent_id").isNotNull()).select("conversation_id", F.col("parent_id").alias("node_id")).distinct()
    leaves = nodes.join(parents, ["conversation_id", "node_id"], "left_anti")
    return leaves.groupBy("conversation_id").agg(F.max_by("node_id", F.struct(F.coalesce(F.col("created_at").cast("string"), F.lit("")), "node_id")).alias("node_id"))


def active_path(nodes: DataFrame, leaves: DataFrame, max_depth: int = 1 << 20) -> DataFrame:
    """Nodes from root to leaf with ``position`` from 0 at the root.

    Ancestors are found by doubling: after round i every path node knows all ancestors up to
    2^i steps away, so a chain of a million turns takes twenty joins. A cycle only yields
    nodes already held, which end the walk where it first repeats.
    """
    jump = nodes.where(F.col("parent_id").isNotNull()).select("conversation_id", "node_id", F.col("parent_id").alias("to"))
    known = nodes.select("conversation_id", F.col("node_id").alias("to"))
    jump = jump.join(known, ["conversation_id", "to"], "left_semi").select("conversation_id", "node_id", "to")
    path = leaves.select("conversation_id", "node_id", F.lit(0).cast("bigint").alias("steps"))
    step, size = 1, 0
    while step <= max_depth:
        up = path.join(jump, ["conversation_id", "node_id"]).select("conversation_id", F.col("to").alias("node_id"), (F.col("steps") + step).alias("steps"))
        path = cut_lineage(path.union(up).groupBy("conversation_id", "node_id").agg(F.min("steps").alias("steps")))
        now = path.count()
        if now == size:
            break
        size = now
        far = jump.select("conversation_id", F.col("node_id").alias("to"), F.col("to").alias("far"))
        jump = cut_lineage(jump.join(far, ["conversation_id", "to"]).select("conversation_id", "node_id", F.col("far").alias("to")))
        step *= 2
    else:
        raise RuntimeError(f"a path is longer than {max_depth} nodes")
    depth = path.groupBy("conversation_id").agg(F.max("steps").alias("deepest"))
    return path.join(depth, "conversation_id").select("conversation_id", "node_id", (F.col("deepest") - F.col("steps")).alias("position"))


def path_counts(nodes: DataFrame, path: DataFrame) -> DataFrame:
    """Active and discarded nodes per conversation."""
    on = path.select("conversation_id", "node_id", F.lit(True).alias("on"))
    return nodes.join(on, ["conversation_id", "node_id"], "left").groupBy("conversation_id").agg(
        F.count("on").alias("active"), F.count_if(F.col("on").isNull()).alias("discarded"))


def message_text(text: Column, blocks: Column) -> Column:
    """Own text, else the text blocks joined by spaces."""
    own = tx.strip(F.coalesce(text, F.lit("")))
    parts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != "")), lambda b: b["text"])
    return F.when(own != "", own).otherwise(tx.strip(F.coalesce(F.array_join(parts, " "), F.lit(""))))


def flatten_activity(records: DataFrame, json: str = "json") -> DataFrame:
    """A prompt event and, where there is one, a response event linked to it per record."""
    d = records.select("record_no", F.from_json(json, ACTIVITY).alias("r")).withColumn("title", tx.strip("r.title"))
    at = F.col("r.time").try_cast("timestamp").cast("timestamp_ntz")
    d = d.withColumn("at", at).where("title <> '' AND at IS NOT NULL")
    conv = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("r.titleUrl", F.lit("")), r"/app/([A-Za-z0-9_-]+)", 1), F.lit("")), F.concat(F.lit("unlinked-"), F.col("record_no").cast("string")))
    prompt = F.regexp_replace("title", r"^(?i)prompted\s+", "")
    html = F.get(F.col("r.safeHtmlItem"), F.lit(0))["html"]
    answer = tx.strip(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))
    d = d.withColumns({"conv": conv, "prompt": prompt, "answer": answer})

    def eid(text: Column, suffix: str) -> Column:
        return identity.event_id(F.lit("activity"), identity.content_hash({"text": text}), F.lit(None).cast("string"), F.lit(None).cast("string"), F.concat(F.lit("apps:"), F.col("conv"), F.lit(suffix)))

    d = d.withColumns({"pid": eid(F.col("prompt"), ""), "rid": eid(F.col("answer"), ":response")})
    none = F.lit(None).cast("string")
    rows = F.array(F.struct(F.col("pid").alias("event_id"), F.lit("user").alias("actor_type"), F.col("prompt").alias("text"), none.alias("parent_event_id")),
                   F.struct(F.col("rid").alias("event_id"), F.lit("assistant").alias("actor_type"), F.col("answer").alias("text"), F.col("pid").alias("parent_event_id")))
    return d.select(F.col("conv").alias("conversation_id"), F.col("at").alias("observed_at"), F.explode(rows).alias("e")).select("e.*", "conversation_id", "observed_at").where(
        F.coalesce("text", F.lit("")) != "")


def read_projects(docs: DataFrame, json: str = "json") -> DataFrame:
    """Project snapshots as events, one row per project document (or one for none)."""
    p = docs.select(F.from_json(json, PROJECT).alias("p")).where("p.uuid IS NOT NULL AND p.updated_at IS NOT NULL")
    return p.select(
        F.concat_ws(":", F.lit("export"), F.lit("project"), "p.uuid", "p.updated_at").alias("event_id"), F.lit("project.snapshot").alias("event_type"),
        F.col("p.name").alias("name"), F.explode_outer("p.docs").alias("doc")).select("event_id", "event_type", "name", "doc.filename", F.col("doc.content").alias("text"))


def read_memories(docs: DataFrame, snapshot: str, json: str = "json") -> DataFrame:
    """Memory summaries of an account: the overall one, one per project, one per file."""
    m = docs.select(F.from_json(json, MEMORY).alias("m"))
    s = F.lit(snapshot)
    row = lambda i, kind, text, scope: F.struct(i.alias("event_id"), F.lit(kind).alias("memory_kind"), tx.strip(text).alias("text"), scope.alias("scope"))
    nul = F.lit(None).cast("string")
    own = F.array(row(F.concat_ws(":", F.lit("export:memory:conversations_memory"), "m.account_uuid", s), "conversations_memory", F.col("m.conversations_memory"), nul))
    proj = F.transform(F.map_entries(F.coalesce("m.project_memories", F.create_map().cast("map<string,string>"))),
                       lambda e: row(F.concat_ws(":", F.lit("export:memory:project"), e["key"], s), "project_memory", e["value"], e["key"]))
    files = F.transform(F.filter(F.coalesce("m.memory_files", F.array().cast("array<struct<path:string,content:string>>")), lambda f: f["path"].isNotNull()),
                        lambda f: row(F.concat_ws(":", F.lit("export:memory_file"), f["path"], s), "memory_file", f["content"], f["path"]))
    return m.select(F.explode(F.concat(own, proj, files)).alias("e")).select("e.*").where(F.coalesce("text", F.lit("")) != "")


# --- agent transcripts ------------------------------------------------------------------

# Line types kept and the cut for tool results, per transcript dialect.
BLOCK_CHARS = 1000
_SESSION = (
    "type STRING, uuid STRING, parentUuid STRING, timestamp STRING, isMeta BOOLEAN, isCompactSummary BOOLEAN, entrypoint STRING, "
    "message STRUCT<role: STRING, model: STRING, text: STRING, content: STRING>"
)
_ROLLOUT = (
    "type STRING, timestamp STRING, ordinal BIGINT, model STRING, "
    "payload STRUCT<type: STRING, role: STRING, id: STRING, call_id: STRING, name: STRING, message: STRING, output: STRING, arguments: STRING, content: ARRAY<STRUCT<type: STRING, text: STRING>>>"
)
_STEPS = "source STRING, type STRING, step_index BIGINT, created_at STRING, model STRING, content STRING"


def parse_agent_lines(lines: DataFrame, kind: str, line: str = "line") -> DataFrame:
    """Transcript lines (conversation_id, line) to events. Lines that are not JSON, or of a
    type that carries no turn, are dropped; ``agent_line_stats`` counts them.

    Kinds: ``session`` (typed messages with blocks), ``rollout`` (response items and tool
    calls) and ``steps`` (numbered planner steps).
    """
    e = _classified(lines, kind, line).where("status = 'kept'")
    return e.select(F.concat_ws(":", F.lit(kind), "conversation_id", "turn_id").alias("event_id"), "conversation_id", "turn_id", "actor_type", "content_kind",
                    tx.redact(F.col("text")).alias("text"), tx.redact(F.col("blocks_text")).alias("blocks_text"), "model", "parent_id", F.col("at").try_cast("timestamp").cast("timestamp_ntz").alias("observed_at"))


def agent_line_stats(lines: DataFrame, kind: str, line: str = "line") -> DataFrame:
    return _classified(lines, kind, line).groupBy("status").agg(F.count(F.lit(1)).alias("lines"))


def _classified(lines: DataFrame, kind: str, line: str) -> DataFrame:
    raw = tx.strip(line)
    schema, extract = {"session": (_SESSION, _session), "rollout": (_ROLLOUT, _rollout), "steps": (_STEPS, _steps)}[kind]
    d = lines.select("conversation_id", raw.alias("__raw"), F.from_json(raw, schema).alias("r"))
    # A broken line gives a row of nulls in permissive mode.
    broken = ~F.col("__raw").rlike(r"^\{.*\}$") | F.try_parse_json("__raw").isNull()
    known, fields = extract(F.col("r"))
    d = d.withColumns(fields)
    empty = (tx.strip(F.concat(F.coalesce("text", F.lit("")), F.coalesce("blocks_text", F.lit("")))) == "") | F.col("turn_id").isNull()
    status = (F.when(F.col("__raw") == "", "empty").when(broken, "unparseable").when(~F.coalesce(known, F.lit(False)), "skipped").when(empty, "empty").otherwise("kept"))
    return d.withColumn("status", status).drop("r", "__raw")


def _cut(text: Column) -> Column:
    t = tx.strip(text)
    return F.when(F.length(t) > BLOCK_CHARS, F.concat(F.left(t, F.lit(BLOCK_CHARS)), F.lit("...[truncated]"))).otherwise(t)


def _session(r: Column):
    m, user = r["message"], r["type"] == "user"
    blocks = F.from_json(m["content"], "ARRAY<STRUCT<type: STRING, text: STRING, thinking: STRING, name: STRING, input: STRING, content: STRING>>")

    def joined(kinds: list[str], value, sep: str) -> Column:
        kept = F.filter(blocks, lambda b: b["type"].isin(*kinds) & (F.coalesce(value(b), F.lit("")) != ""))
        return F.coalesce(F.array_join(F.transform(kept, value), sep), F.lit(""))

    plain = F.when(user & ~m["content"].startswith("["), tx.strip(m["content"]))
    said = joined(["text"], lambda b: b["text"], " ")
    thought = joined(["text", "thinking"], lambda b: F.coalesce(b["text"], b["thinking"]), "\n\n")
    outs = joined(["tool_result"], lambda b: _cut(b["content"]), "\n")
    calls = joined(["tool_use"], lambda b: F.concat_ws(" ", b["name"], _cut(b["input"])), "\n")
    text = F.when(user, F.coalesce(plain, said)).otherwise(thought)
    content_kind = F.when(~user, "assistant_turn").when(text == "", "tool_result").otherwise("user_turn")
    known = r["type"].isin("user", "assistant") & m.isNotNull() & ~F.coalesce(r["isMeta"], F.lit(False)) & ~F.coalesce(r["isCompactSummary"], F.lit(False))
    return known, {"turn_id": r["uuid"], "actor_type": r["type"], "content_kind": content_kind, "text": text, "blocks_text": F.when(user, outs).otherwise(calls),
                   "model": F.when(~user, m["model"]), "parent_id": r["parentUuid"], "at": r["timestamp"]}


def _rollout(r: Column):
    p = r["payload"]
    said = F.array_join(F.transform(F.filter(p["content"], lambda b: b["text"].isNotNull()), lambda b: b["text"]), "\n")
    item, call = r["type"] == "response_item", p["type"].isin("function_call", "custom_tool_call")
    out = p["type"].isin("function_call_output", "custom_tool_call_output")
    summary = r["type"] == "compacted"
    talk = item & (p["type"] == "message") & p["role"].isin("user", "assistant")
    text = (F.when(summary, tx.strip(p["message"])).when(call, F.concat(F.lit("[tool] "), p["name"])).when(out, _cut(p["output"])).otherwise(said))
    content_kind = (F.when(summary, "compaction_summary").when(call, "tool_use").when(out, "tool_result").when(p["role"] == "user", "user_turn").otherwise("assistant_turn"))
    known = talk | (item & (call | out)) | (summary & (F.coalesce(tx.strip(p["message"]), F.lit("")) != ""))
    turn = F.coalesce(r["ordinal"].cast("string"), p["id"], p["call_id"])
    return known, {"turn_id": turn, "actor_type": F.when(talk & (p["role"] == "user"), "user").otherwise("assistant"), "content_kind": content_kind, "text": text, "blocks_text": F.lit(""),
                   "model": r["model"], "parent_id": F.lit(None).cast("string"), "at": r["timestamp"]}


def _steps(r: Column):
    user = (r["source"] == "USER_EXPLICIT") & (r["type"] == "USER_INPUT")
    model = (r["source"] == "MODEL") & r["type"].isin("PLANNER_RESPONSE", "GENERIC")
    return user | model, {"turn_id": r["step_index"].cast("string"), "actor_type": F.when(user, "user").otherwise("assistant"),
                          "content_kind": F.when(user, "user_turn").when(r["type"] == "GENERIC", "tool_result").otherwise("assistant_turn"),
                          "text": F.when(r["type"] == "GENERIC", _cut(r["content"])).otherwise(r["content"]),
                          "blocks_text": F.lit(""), "model": F.when(model, r["model"]), "parent_id": F.lit(None).cast("string"), "at": r["created_at"]}

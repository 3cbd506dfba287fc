"""Journal scans, predicates and status aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import rules, text as tx
from memlake.operators import journal as j
from memlake.plans.registry import Tables, query
from memlake.plans.sqltext import q, redact, words

AS_OF = "2024-01-20 00:00:00"


def as_of(text: str = AS_OF):
    return F.lit(text).cast("timestamp_ntz")


@query("S1_read_events", """SELECT event_id, conversation_id, observed_at, event_type FROM f_events
    WHERE harness = 'src1' AND observed_at >= '2024-01-05' AND observed_at <= '2024-01-25' """)
def _s1(t: Tables):
    return j.read_events(t.f_events, "src1", None, "2024-01-05", "2024-01-25").select("event_id", "conversation_id", "observed_at", "event_type")


_INCOMING = "(SELECT event_id FROM f_events WHERE event_id % 3 = 0 UNION ALL SELECT event_id + 5000000 FROM f_events WHERE event_id % 4 = 0 UNION ALL SELECT event_id + 5000000 FROM f_events WHERE event_id % 8 = 0)"


def _incoming(t: Tables):
    e = t.f_events.select("event_id")
    late = e.where("event_id % 4 = 0").select((F.col("event_id") + 5000000).alias("event_id"))
    return e.where("event_id % 3 = 0").union(late).union(late.where("event_id % 8 = 0"))


@query("S2_append_events", f"SELECT DISTINCT event_id FROM {_INCOMING} WHERE event_id NOT IN (SELECT event_id FROM events)")
def _s2(t: Tables):
    return j.new_events(t.f_events, _incoming(t))


@query("S2_append_counts", f"""WITH i AS (SELECT event_id FROM {_INCOMING}),
    n AS (SELECT count(DISTINCT event_id) AS c FROM i WHERE event_id NOT IN (SELECT event_id FROM events))
    SELECT (SELECT count(*) FROM i) AS offered, c AS inserted, (SELECT count(*) FROM i) - c AS deduped FROM n""")
def _s2c(t: Tables):
    return j.append_counts(t.f_events, _incoming(t))


_LINE = """'{"conversation_id":' || conversation_id || ',"event_id":' || event_id || ',"event_type":"' || event_type || '","harness":"' || harness || '"}'"""


@query("S3_export_events", f"SELECT event_id, {_LINE} AS line FROM f_events WHERE harness = 'src2' ")
def _s3(t: Tables):
    cols = ["event_id", "harness", "event_type", "conversation_id"]
    return j.as_json_lines(j.read_events(t.f_events, "src2"), cols).select("event_id", "line")


@query("S4_replay_events", f"SELECT observed_at, event_id, {_LINE} AS line FROM f_events ORDER BY observed_at, event_id")
def _s4(t: Tables):
    e = t.f_events
    line = F.to_json(F.struct("conversation_id", "event_id", "event_type", "harness")).alias("line")
    return e.select("observed_at", "event_id", line).orderBy("observed_at", "event_id")


@query("S17_get_event", """SELECT event_id, event_type, harness AS source_harness, conversation_id AS source_conversation, actor_type, observed_at
    FROM f_events WHERE event_id = (SELECT max(event_id) FROM events)""")
def _s17(t: Tables):
    newest = t.events.agg(F.max("event_id").alias("event_id"))
    env = t.f_events.withColumn("source", F.struct("harness", "conversation_id"))
    return env.join(newest, "event_id").select(
        "event_id", "event_type", F.col("source.harness").alias("source_harness"), F.col("source.conversation_id").alias("source_conversation"),
        "actor_type", "observed_at")


_INJECT = "text || CASE doc_id % 4 WHEN 0 THEN ' sk-ABCDEFGHIJKLMNOPQRSTUVWX' WHEN 1 THEN ' AIzaABCDEFGHIJKLMNOPQRSTUVWXYZ012345678' ELSE '' END"


@query("P1_redact_patterns", f"SELECT doc_id, md5({redact('body')}) AS clean_md5, {redact('body')} <> body AS changed FROM (SELECT doc_id, {_INJECT} AS body FROM documents)")
def _p1(t: Tables):
    body = t.documents.select("doc_id", F.expr(_INJECT).alias("body"))
    clean = tx.redact(F.col("body"))
    return body.select("doc_id", F.md5(clean).alias("clean_md5"), (clean != F.col("body")).alias("changed"))


@query("P2_redact_by_key", f"""
    WITH m AS (SELECT event_id, 'k' || event_id % 13 AS api_key, CASE WHEN event_id % 11 = 0 THEN 'see sk-ABCDEFGHIJKLMNOPQRSTUVWX' ELSE event_type END AS note, props AS detail FROM f_events)
    SELECT event_id, '[REDACTED]' AS api_key, {redact('note')} AS note, {redact('detail')} AS detail,
           CAST(1 + ({redact('note')} <> note)::INT + ({redact('detail')} <> detail)::INT AS INTEGER) AS redactions FROM m""")
def _p2(t: Tables):
    e = t.f_events.withColumn("m", F.expr("""map('api_key', concat('k', event_id % 13), 'note', CASE WHEN event_id % 11 = 0
        THEN 'see sk-ABCDEFGHIJKLMNOPQRSTUVWX' ELSE event_type END, 'detail', props)"""))
    clean = tx.redact_map(F.col("m"))
    return e.select("event_id", *[clean[k].alias(k) for k in ("api_key", "note", "detail")], tx.redaction_count(F.col("m")).alias("redactions"))


@query("P3_apply_retention", f"""SELECT event_id, retention_class, CASE WHEN retention_class IN ('redacted', 'summarized') THEN {redact('content')} ELSE content END AS content
    FROM f_events WHERE retention_class <> 'excluded'""")
def _p3(t: Tables):
    return j.apply_retention(t.f_events).select("event_id", "retention_class", "content")


@query("P4_capture_allow", "SELECT event_id, harness, event_type AS tool FROM f_events WHERE event_type NOT IN ('click', 'error') AND harness <> 'src3'")
def _p4(t: Tables):
    calls = t.f_events.select("event_id", "harness", F.col("event_type").alias("tool"))
    tools = t.values("tool", "'click'", "'error'")
    clients = t.values("harness", "'src3'")
    return j.capture_allow(calls, tools, clients).select("event_id", "harness", "tool")


@query("P14_private_mentions", """
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(rule_no AS INTEGER) AS rule_no FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) l
    JOIN (VALUES (1, '[\\w.]+@[\\w.]+'), (2, '(?i)licen[cs]e'), (3, '\\b\\d{3}-\\d{2}-\\d{4}\\b')) r(rule_no, pattern) ON regexp_matches(line, pattern)""")
def _p14(t: Tables):
    return j.private_mentions(j.text_lines(t.documents), [(1, r"[\w.]+@[\w.]+"), (2, r"(?i)licen[cs]e"), (3, r"\b\d{3}-\d{2}-\d{4}\b")])


@query("A1_journal_stats", """SELECT CASE WHEN grouping(harness) = 0 THEN 'harness' WHEN grouping(event_type) = 0 THEN 'event_type' WHEN grouping(retention_class) = 0 THEN 'retention_class' ELSE 'total' END AS dimension,
      coalesce(harness, event_type, retention_class, 'all') AS value, count(*) AS n, min(observed_at) AS first_at, max(observed_at) AS last_at
    FROM f_events GROUP BY GROUPING SETS ((), (harness), (event_type), (retention_class))""")
def _a1(t: Tables):
    return j.journal_stats(t.f_events)


@query("A2_captured_vs_reconstructed", """SELECT harness, CAST(sum((metadata->>'$.provenance_reconstructed' = 'true')::INT) AS BIGINT) AS reconstructed,
      CAST(sum((metadata->>'$.provenance_reconstructed' <> 'true')::INT) AS BIGINT) AS captured FROM f_events GROUP BY 1""")
def _a2(t: Tables):
    return j.provenance_split(t.f_events)


@query("A3_harness_type_counts", "SELECT harness, event_type, actor_type, count(*) AS n, min(observed_at) AS earliest, max(observed_at) AS latest FROM f_events GROUP BY ALL")
def _a3(t: Tables):
    return t.f_events.groupBy("harness", "event_type", "actor_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("observed_at").alias("earliest"), F.max("observed_at").alias("latest"))


@query("A5_clients_seen", f"""SELECT harness, max(observed_at) AS last_seen, count(*) AS calls, max_by(metadata->>'$.client_version', observed_at) AS client_version FROM f_events
    WHERE event_type = 'click' AND observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND observed_at <= '{AS_OF}' AND via <> 'connector' GROUP BY 1""")
def _a5(t: Tables):
    return j.clients_seen(t.f_events, as_of(), "click")


@query("A6_connector_summary", f"""SELECT count(*) FILTER (WHERE c) AS calls, max(CASE WHEN c THEN observed_at END) AS last_seen,
      coalesce(string_agg(DISTINCT CASE WHEN c THEN harness END, ',' ORDER BY CASE WHEN c THEN harness END), '') AS names,
      count(*) FILTER (WHERE event_type = 'purchase') AS captures, max(CASE WHEN event_type = 'purchase' THEN observed_at END) AS last_capture
    FROM (SELECT *, event_type = 'click' AND observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AS c FROM f_events)
    WHERE via = 'connector' AND observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND observed_at <= '{AS_OF}'""")
def _a6(t: Tables):
    return j.connector_summary(t.f_events, as_of(), "click", "purchase").withColumn("names", F.array_join("names", ","))


@query("A7_live_captures", f"""SELECT split_part(memory_id, ':', 2) AS harness, count(*) AS captures, max(created_at) AS last_at
    FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'cowork_live:' ELSE 'other:' END || harness || ':' || event_id AS memory_id, observed_at AS created_at FROM f_events)
    WHERE memory_id LIKE 'cowork_live:%' AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND created_at <= '{AS_OF}' GROUP BY 1""")
def _a7(t: Tables):
    mem = t.f_events.select(F.expr("concat(CASE WHEN event_id % 3 = 0 THEN 'cowork_live:' ELSE 'other:' END, harness, ':', event_id)").alias("memory_id"),
                            F.col("observed_at").alias("created_at"))
    return j.live_captures(mem, as_of())


_FEATURES = """SELECT conversation_id, min(observed_at) AS first_at, count(*) AS events,
      count(*) FILTER (WHERE actor_type = 'user' AND trim(text) <> '') AS typed_turns, count(*) FILTER (WHERE actor_type = 'assistant' AND trim(text) <> '') AS real_replies,
      CAST(coalesce(sum(length(text)) FILTER (WHERE actor_type = 'assistant' AND trim(text) <> ''), 0) AS BIGINT) AS assistant_chars FROM f_conv GROUP BY 1"""


@query("A8_conversation_features", f"SELECT *, typed_turns / events AS typed_per_event, assistant_chars / events AS prose_per_event FROM ({_FEATURES})")
def _a8(t: Tables):
    return j.conversation_features(t.f_conv)


@query("O8_extraction_order", f"""SELECT conversation_id, row_number() OVER (ORDER BY events < 3, assistant_chars < 400 OR typed_turns < 2 OR real_replies < 2,
      assistant_chars / events DESC, typed_turns / events DESC, events, conversation_id) AS place FROM ({_FEATURES}) WHERE conversation_id NOT IN (SELECT conversation_id FROM f_job)""")
def _o8(t: Tables):
    from memlake.operators.scan import number_rows

    f = j.conversation_features(t.f_conv).join(t.f_job.select("conversation_id").distinct(), "conversation_id", "left_anti")
    small, thin, *_ = j.extraction_order(f, "yield")
    keys = {"o0": small.cast("int"), "o1": thin.cast("int"), "o2": -F.col("prose_per_event"), "o3": -F.col("typed_per_event"), "o4": F.col("events")}
    f = f.select(F.lit(0).alias("one"), "conversation_id", *[c.alias(n) for n, c in keys.items()])
    # One list over all conversations, numbered by chunks of its own order.
    chunk = (F.col("o0") * 2 + F.col("o1")).cast("bigint") * 1_000_000_000 + F.floor(F.col("o2") / 50)
    return number_rows(f, ["one"], [*keys, "conversation_id"], chunk, "place").select("conversation_id", "place")


_PROBES = "(SELECT conversation_id AS target, observed_at AS at_, event_type <> 'error' AS ok FROM f_events)"


@query("A21_availability", f"""SELECT target, CAST(at_ AS DATE) AS "day", count(*) AS probes, count(*) FILTER (WHERE NOT ok) AS failures,
    round(1 - count(*) FILTER (WHERE NOT ok) / count(*), 4) AS availability FROM {_PROBES} GROUP BY ALL""")
def _a21(t: Tables):
    return j.availability(t.f_events.select(F.col("conversation_id").alias("target"), F.col("observed_at").alias("at"), (F.col("event_type") != "error").alias("ok")))


@query("A25_refused_clients", f"""SELECT client, count(*) FILTER (WHERE refused) AS refusals, min(CASE WHEN refused THEN observed_at END) AS first_at, max(CASE WHEN refused THEN observed_at END) AS last_at,
      max_by(CASE WHEN refused THEN status END, CASE WHEN refused THEN observed_at END) AS last_status, max(CASE WHEN NOT refused THEN observed_at END) AS last_ok_at
    FROM (SELECT 'client-' || conversation_id AS client, observed_at, event_type = 'error' AS refused, 'S' || event_id % 5 AS status FROM f_events) WHERE observed_at <= '{AS_OF}'
    GROUP BY 1 HAVING max(CASE WHEN refused THEN observed_at END) >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY""")
def _a25(t: Tables):
    req = t.f_events.select(F.expr("concat('client-', conversation_id)").alias("client"), F.col("observed_at").alias("at"), F.col("event_id").alias("request_id"),
                            (F.col("event_type") == "error").alias("refused"), F.expr("concat('S', event_id % 5)").alias("status"))
    return j.refused_clients(req, as_of())


@query("J3_pending_conversations", """SELECT DISTINCT conversation_id FROM f_events WHERE conversation_id NOT IN
    (SELECT e.conversation_id FROM f_events e JOIN f_job j ON e.event_id = j.event_id)""")
def _j3(t: Tables):
    return j.pending_conversations(t.f_events, t.f_job)


@query("L9_retryable_writes", f"""SELECT event_id, CASE WHEN event_type = 'view' THEN 'lost' ELSE 'failed' END AS status, observed_at AS queued_at FROM f_events
    WHERE event_id % 3 <> 0 AND (event_type = 'error' OR (event_type = 'view' AND observed_at < '{AS_OF}')) ORDER BY queued_at""")
def _l9(t: Tables):
    writes = t.f_events.select("event_id", F.expr("CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'queued' ELSE 'committed' END").alias("status"),
                               F.col("observed_at").alias("queued_at"), F.expr("CASE WHEN event_id % 3 <> 0 THEN content END").alias("payload"))
    return j.retryable_writes(writes, as_of()).select("event_id", "status", "queued_at").orderBy("queued_at", "event_id")


_EP = "CASE WHEN conversation_id % 5 = 0 THEN event_type WHEN conversation_id % 5 < 4 THEN CASE conversation_id % 2 WHEN 0 THEN 'desktop' ELSE 'cli' END END"
_L13 = f"""ev AS (SELECT event_id, conversation_id, harness, {_EP} AS ep FROM f_events), mv AS (SELECT *, CASE WHEN harness = 'src0' THEN CASE ep WHEN 'desktop' THEN 'desk' WHEN 'cli' THEN 'term' WHEN 'click' THEN 'desk' ELSE 'src0' END ELSE harness END AS label FROM ev),
    wh AS (SELECT conversation_id, min(label) AS new FROM mv WHERE harness = 'src0' GROUP BY 1 HAVING min(label) = max(label) AND min(label) <> 'src0'),
    dv AS (SELECT memory_id, m.harness, coalesce(CASE WHEN m.harness = 'src0' THEN new END, m.harness) AS label FROM f_memory m LEFT JOIN wh USING (conversation_id)),
    rv AS (SELECT audit_id, d.harness, d.label FROM f_audit JOIN dv d USING (memory_id))"""


def _moves(t: Tables):
    ev = t.f_events.select("event_id", "conversation_id", "harness", F.expr(_EP).alias("entry_point"))
    memories = t.f_memory.select("memory_id", "conversation_id", "harness")
    reviews = t.f_audit.select("audit_id", "memory_id").join(memories, "memory_id")
    points = t.values("entry_point, new", "('desktop', 'desk')", "('cli', 'term')", "('click', 'desk')")
    return j.relabel_provenance(ev, {"derivations": memories, "reviews": reviews}, "src0", points)


@query("L13_relabel_provenance", f"""WITH {_L13}, al AS (SELECT 'events' AS source, harness, label FROM mv UNION ALL SELECT 'derivations', harness, label FROM dv UNION ALL SELECT 'reviews', harness, label FROM rv)
    SELECT source, harness, CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after FROM (SELECT source, harness, 1 AS b, 0 AS a FROM al UNION ALL SELECT source, label, 0, 1 FROM al) GROUP BY ALL""")
def _l13(t: Tables):
    return _moves(t)[1]


@query("L13_relabelled_derivations", f"WITH {_L13} SELECT memory_id, label AS harness FROM dv WHERE label <> harness")
def _l13b(t: Tables):
    return _moves(t)[0]["derivations"].where("harness IN ('desk', 'term')").select("memory_id", "harness")

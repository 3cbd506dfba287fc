"""Window and segmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import rules, text as tx
from memlake.operators import windows as w
from memlake.operators.scan import number_chunk
from memlake.plans.registry import Tables, query

ORD = ["observed_at", "event_id"]


def q(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


@query("W1_fixed_turn_windows", """
    SELECT conversation_id, window_no, count(*) AS n_events, min(turn) AS first_turn, max(turn) AS last_turn FROM (
      SELECT conversation_id, turn,
             CASE WHEN (pos - 1) // 3 = (n - 1) // 3 AND (n - 1) // 3 > 0 AND n - ((n - 1) // 3) * 3 < 2
                  THEN (pos - 1) // 3 - 1 ELSE (pos - 1) // 3 END AS window_no
      FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY observed_at, event_id) AS pos,
                   count(*) OVER (PARTITION BY conversation_id) AS n FROM f_conv)) GROUP BY ALL""")
def _w1(t: Tables):
    return w.fixed_turn_windows(t.f_conv.select("conversation_id", "turn", *ORD), ORD, 3, 2).groupBy("conversation_id", "window_no").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


def _gap_sql(source: str, flag: str, why: str, cap: int, low: int, end: str, cols: str = "") -> str:
    """Segmentation stated over whole-key windows."""
    return f"""
    WITH src AS ({source}),
    a AS (SELECT *, row_number() OVER k AS pos, lag(observed_at) OVER k AS prev_at{cols} FROM src WINDOW k AS (PARTITION BY conversation_id ORDER BY observed_at, event_id)),
    b AS (SELECT *, coalesce({flag}, false) AS begins FROM a),
    b2 AS (SELECT *, CASE WHEN begins THEN {why} END AS why FROM b),
    c AS (SELECT *, sum(begins::INT) OVER (PARTITION BY conversation_id ORDER BY pos) AS session FROM b2),
    d AS (SELECT *, (row_number() OVER (PARTITION BY conversation_id, session ORDER BY pos) - 1) // {cap} AS block FROM c),
    s AS (SELECT conversation_id, session, block, count(*) AS n, min(observed_at) AS start_at, max(observed_at) AS end_at,
                 CASE WHEN block > 0 THEN 'size cap' ELSE min_by(coalesce(why, ''), pos) END AS why FROM d GROUP BY conversation_id, session, block),
    s2 AS (SELECT *, coalesce(lead(why) OVER (PARTITION BY conversation_id ORDER BY session, block), {end}) AS reason,
                  row_number() OVER (PARTITION BY conversation_id ORDER BY session, block) AS seg_no FROM s),
    g AS (SELECT *, sum((seg_no = 1 OR n >= {low})::INT) OVER (PARTITION BY conversation_id ORDER BY seg_no) AS grp, (seg_no = 1 OR n >= {low}) AS head FROM s2),
    l AS (SELECT conversation_id, sum(CASE WHEN grp = 1 THEN n END) AS lead_n, max(grp) AS groups, sum(n) AS total FROM g GROUP BY 1),
    f AS (SELECT g.*, total, lead_n < {low} AND groups > 1 AND grp = 1 AS lead_fold,
                 CASE WHEN lead_n < {low} AND groups > 1 THEN greatest(grp - 2, 0) ELSE grp - 1 END AS window_no FROM g JOIN l USING (conversation_id)),
    w AS (SELECT conversation_id, CAST(window_no AS BIGINT) AS window_no, CAST(sum(n) AS BIGINT) AS n_events, min(start_at) AS start_at, max(end_at) AS end_at,
           CASE WHEN any_value(total) < {low} THEN 'short conversation' ELSE
             max(CASE WHEN head AND NOT lead_fold THEN reason END) || CASE WHEN bool_or(NOT head AND NOT lead_fold) THEN ' (+tail)' ELSE '' END END AS reason
          FROM f GROUP BY 1, 2)"""


_FMT = """CASE WHEN gap / 60 < 90 THEN CAST(CAST(round_even(gap / 60, 0) AS BIGINT) AS VARCHAR) || 'm'
    WHEN gap / 3600 < 48 THEN printf('%.1f', gap / 3600) || 'h' ELSE printf('%.1f', gap / 86400) || 'd' END"""
_GAP = _FMT.replace("gap", "(epoch_us(observed_at) - epoch_us(prev_at)) / 1e6")
_W2 = _gap_sql("SELECT conversation_id, observed_at, event_id FROM f_events", "observed_at - prev_at >= INTERVAL 12 HOUR",
               f"'time gap ' || ({_GAP})", 6, 3, "CASE WHEN n >= 6 THEN 'size cap' ELSE 'conversation end' END")


@query("W2_time_gap_windows", _W2 + " SELECT * FROM w")
def _w2(t: Tables):
    _, wins = w.time_gap_windows(t.f_events.select("conversation_id", *ORD), ORD, 12 * 3600, 6, 3)
    return wins


@query("W2_time_gap_rows", _W2 + " SELECT event_id, conversation_id, CAST(f.window_no AS BIGINT) AS window_no FROM d JOIN f USING (conversation_id, session, block)")
def _w2r(t: Tables):
    rows, _ = w.time_gap_windows(t.f_events.select("conversation_id", *ORD), ORD, 12 * 3600, 6, 3)
    return rows.select("event_id", "conversation_id", "window_no")


_W3 = _gap_sql("SELECT conversation_id, observed_at, event_id, actor_type, text FROM f_conv",
               f"prev_at IS NOT NULL AND actor_type = 'user' AND regexp_matches(left(trim(text, chr(32)), 120), {q(rules.TOPIC_CUE)})",
               "'cue: ''' || left(regexp_extract(trim(text, chr(32)), '^([^.\\n?!]*)', 1), 60) || ''''", 4, 2, "'conversation end'")


@query("W3_marker_cue_windows", _W3 + " SELECT * FROM w")
def _w3(t: Tables):
    _, wins = w.marker_cue_windows(t.f_conv.select("conversation_id", "actor_type", "text", *ORD), ORD, 4, 2)
    return wins


_COS = """(CASE WHEN prev_v IS NULL THEN NULL
    WHEN list_inner_product(prev_v, prev_v) = 0 OR list_inner_product(vector, vector) = 0 THEN 0
    ELSE list_inner_product(prev_v, vector) / (sqrt(list_inner_product(prev_v, prev_v)) * sqrt(list_inner_product(vector, vector))) END)"""
_VEC = "SELECT vec_id // 20 AS conversation_id, TIMESTAMP '2024-01-01' + vec_id * INTERVAL 1 MINUTE AS observed_at, vec_id AS event_id, embedding::DOUBLE[] AS vector FROM embeddings"
_W4 = _gap_sql(_VEC, f"{_COS} < 0.1", "'shift'", 20, 3, "'conversation end'", ", lag(vector) OVER k AS prev_v")


def _vec_turns(t: Tables):
    return t.embeddings.select(
        F.floor(F.col("vec_id") / 20).alias("conversation_id"), F.col("vec_id").alias("event_id"), F.col("embedding").alias("vector"),
        F.expr("timestampadd(MINUTE, vec_id, TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("observed_at"))


@query("W4_embedding_boundary_windows", _W4 + " SELECT conversation_id, window_no, n_events, start_at, end_at FROM w")
def _w4(t: Tables):
    _, wins = w.embedding_boundary_windows(_vec_turns(t), ORD, 0.1, 20, 3)
    return wins.drop("reason")


@query("W5_merge_runts", """
    WITH s AS (SELECT conversation_id, turn AS seg, length(text) % 5 + 1 AS n FROM f_conv),
    s2 AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY seg) AS seg_no FROM s),
    g AS (SELECT *, sum((seg_no = 1 OR n >= 3)::INT) OVER (PARTITION BY conversation_id ORDER BY seg_no) AS grp FROM s2),
    l AS (SELECT conversation_id, sum(CASE WHEN grp = 1 THEN n END) AS lead_n, max(grp) AS groups FROM g GROUP BY 1)
    SELECT conversation_id, seg, CAST(CASE WHEN lead_n < 3 AND groups > 1 THEN greatest(grp - 2, 0) ELSE grp - 1 END AS BIGINT) AS window_no
    FROM g JOIN l USING (conversation_id)""")
def _w5(t: Tables):
    segs = t.f_conv.select("conversation_id", F.col("turn").alias("seg"), (F.length("text") % 5 + 1).alias("n"))
    return w.merge_runts(segs, ["seg"], number_chunk(F.col("seg"), 3), 3).select("conversation_id", "seg", "window_no")


_SPOKEN = "(SELECT * FROM f_conv WHERE actor_type IN ('user', 'assistant') AND trim(text) <> '')"


@query("W6_preceding_assistant", f"""
    SELECT event_id, md5(coalesce(last_value(CASE WHEN actor_type = 'assistant' THEN text END IGNORE NULLS)
        OVER (PARTITION BY conversation_id ORDER BY observed_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS preceding_md5
    FROM {_SPOKEN}""")
def _w6(t: Tables):
    r = w.preceding_assistant(t.f_conv.select("conversation_id", "actor_type", "text", *ORD), ORD)
    return r.select("event_id", F.md5(F.coalesce("preceding_text", F.lit(""))).alias("preceding_md5"))


@query("W6_preceding_assistant_reset", f"""
    SELECT event_id, md5(coalesce(CASE WHEN r = 'assistant' THEN x END, '')) AS preceding_md5 FROM (
      SELECT event_id, lag(actor_type) OVER k AS r, lag(text) OVER k AS x FROM {_SPOKEN} WINDOW k AS (PARTITION BY conversation_id ORDER BY observed_at, event_id))""")
def _w6b(t: Tables):
    r = w.preceding_assistant(t.f_conv.select("conversation_id", "actor_type", "text", *ORD), ORD, reset=True)
    return r.select("event_id", F.md5(F.coalesce("preceding_text", F.lit(""))).alias("preceding_md5"))


@query("W7_failure_streaks", """
    WITH a AS (SELECT conversation_id AS target, observed_at AS "at", event_type <> 'error' AS ok, 'E' || CAST(event_id % 3 AS VARCHAR) AS error,
                      sum((event_type <> 'error')::INT) OVER (PARTITION BY conversation_id ORDER BY observed_at, event_id) AS island FROM f_events)
    SELECT target, min(a.at) AS start_at, max(a.at) AS end_at, count(*) AS probes, string_agg(DISTINCT error, ',' ORDER BY error) AS errors
    FROM a WHERE NOT ok GROUP BY target, island""")
def _w7(t: Tables):
    probes = t.f_events.select(
        F.col("conversation_id").alias("target"), F.col("observed_at").alias("at"), F.col("event_id").alias("probe_id"),
        (F.col("event_type") != "error").alias("ok"), F.concat(F.lit("E"), (F.col("event_id") % 3).cast("string")).alias("error"))
    return w.failure_streaks(probes).withColumn("errors", F.array_join("errors", ","))


_WIN = "conversation_id, window_no"


@query("P5_triage", f"""
    WITH w AS (SELECT *, turn // 4 AS window_no, trim(text, chr(32)) AS body FROM f_conv),
    a AS (SELECT {_WIN}, count(*) AS n_events, count(CASE WHEN u THEN 1 END) AS n_user, coalesce(bool_or(u AND contains(body, '?')), false) AS q,
                 bool_or(u AND regexp_matches(body, {q(rules.DELIBERATION)})) AS d, bool_or(u AND regexp_matches(body, {q(rules.TECHNICAL_SHAPE)})) AS t,
                 count(CASE WHEN u AND length(body) >= 40 THEN 1 END) AS n_long
          FROM (SELECT *, actor_type = 'user' AND body <> '' AS u FROM w) GROUP BY ALL),
    b AS (SELECT *, concat_ws(', ', CASE WHEN q THEN 'question' END, CASE WHEN d THEN 'deliberation-marker' END, CASE WHEN t THEN 'technical-shape' END) AS found FROM a)
    SELECT {_WIN}, n_events, n_user, n_events >= 3 AND n_user > 0 AND (found <> '' OR n_long >= 3) AS send,
           CASE WHEN n_events < 3 THEN 'below reasoning floor' WHEN n_user = 0 THEN 'no user turns in window'
                WHEN found <> '' THEN 'reasoning signal: ' || found WHEN n_long >= 3 THEN 'no marker but 3+ substantive user turns' ELSE 'no signal' END AS reason
    FROM b""")
def _p5(t: Tables):
    turns = t.f_conv.withColumn("window_no", F.floor(F.col("turn") / 4))
    return w.triage(turns, ["conversation_id", "window_no"]).drop("signals")


@query("W11_anchor_turns", """
    WITH m AS (SELECT *, (conversation_id * 31 + turn) % 7 = 0 AS significant,
                      CASE turn % 3 WHEN 0 THEN 'refining' WHEN 1 THEN 'deciding' ELSE 'researching' END AS stage FROM f_conv),
    a AS (SELECT *, first_value(CASE WHEN significant THEN event_id END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY observed_at, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM m)
    SELECT event_id, coalesce(CASE WHEN stage IN ('refining', 'deciding') OR significant THEN anchor END, '') AS anchor_id FROM a""")
def _w11(t: Tables):
    turns = t.f_conv.withColumn("significant", (F.col("conversation_id") * 31 + F.col("turn")) % 7 == 0).withColumn(
        "stage", F.when(F.col("turn") % 3 == 0, "refining").when(F.col("turn") % 3 == 1, "deciding").otherwise("researching"))
    return w.anchor_turns(turns, ORD).select("event_id", F.coalesce("anchor_id", F.lit("")).alias("anchor_id"))


@query("W13_pack_batch", """
    WITH c AS (SELECT conversation_id, count(*) AS events, min(observed_at) AS first_at FROM f_events GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY first_at, conversation_id) AS rn, sum(events) OVER (ORDER BY first_at, conversation_id) AS running FROM c)
    SELECT conversation_id, events FROM r WHERE rn <= 40 AND (rn = 1 OR (running <= 1500 AND running - events < 1500))""")
def _w13(t: Tables):
    ranked = t.f_events.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("events"), F.min("observed_at").alias("first_at"))
    return w.pack_batch(ranked, [F.col("first_at"), F.col("conversation_id")], "events", 1500, 40).select("conversation_id", "events")


@query("W14_turn_cap", """
    WITH l AS (SELECT conversation_id, least(length(trim(text, chr(32))), 2000) AS len FROM f_conv),
    a AS (SELECT conversation_id, sum(least(len, 200)) AS at_low, sum(len) AS at_high FROM l GROUP BY 1),
    c AS (SELECT conversation_id, cap FROM (SELECT conversation_id, cap, sum(least(len, cap)) AS s FROM l, range(200, 2001) r(cap) GROUP BY ALL) WHERE s <= 1500),
    m AS (SELECT conversation_id, max(cap) AS cap FROM c GROUP BY 1)
    SELECT conversation_id, coalesce(CASE WHEN at_low > 1500 THEN -1 ELSE m.cap END, -1) AS cap, at_low > 1500 AS too_long FROM a LEFT JOIN m USING (conversation_id)""")
def _w14(t: Tables):
    return w.turn_cap(t.f_conv, ["conversation_id"], F.lit(1500)).withColumn("cap", F.coalesce("cap", F.lit(-1).cast("bigint")))

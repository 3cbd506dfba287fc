"""Review-ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import rules
from memlake.operators import journal as j, ledger as l
from memlake.operators.scan import first_per
from memlake.plans.registry import Tables, query
from memlake.plans.sqltext import q, slug, words
from memlake.session import cut_lineage

TIER1 = f"reasoning_kind IN ({words(rules.TIER1_KINDS)})"
EXCL = f"approval_state NOT IN ({words(l.EXCLUDED)})"
N_EV = "(SELECT memory_id, count(*) AS n_evidence FROM f_evidence GROUP BY 1)"


def n_evidence(t: Tables):
    return t.f_evidence.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n_evidence"))


_PRIO = """CASE WHEN reasoning_kind IN ('decision', 'plan', 'rejected_alternative') AND n_evidence >= 3 THEN 'priority'
    WHEN (reasoning_kind IN ('decision', 'plan', 'rejected_alternative') AND n_evidence = 2) OR (reasoning_kind NOT IN ('decision', 'plan', 'rejected_alternative') AND n_evidence >= 5) THEN 'maybe' ELSE 'low' END"""


@query("P8_episode_priority", f"SELECT memory_id, {_PRIO} AS label FROM f_memory JOIN {N_EV} USING (memory_id)")
def _p8(t: Tables):
    m = t.f_memory.join(n_evidence(t), "memory_id")
    return m.select("memory_id", l.episode_priority(F.col("reasoning_kind"), F.col("n_evidence")).alias("label"))


@query("P9_tier", f"SELECT memory_id, CASE WHEN {TIER1} THEN 1 ELSE 2 END AS tier FROM f_memory")
def _p9(t: Tables):
    return t.f_memory.select("memory_id", l.tier(F.col("reasoning_kind")).alias("tier"))


@query("P10_approval_state", "SELECT memory_id, CASE WHEN category = 'non_memory' THEN 'rejected' WHEN category = 'episodic' AND confidence >= 0.8 THEN 'auto_accepted' ELSE 'queued_for_review' END AS state FROM f_memory")
def _p10(t: Tables):
    from memlake.operators.derive import approval_state

    return t.f_memory.select("memory_id", approval_state(F.col("category"), F.col("confidence"), 0.8).alias("state"))


@query("P12_queue_states", f"SELECT memory_id, approval_state FROM f_memory WHERE {EXCL}")
def _p12(t: Tables):
    return t.f_memory.where(~F.col("approval_state").isin(*l.EXCLUDED)).select("memory_id", "approval_state")


_WHY = "CASE event_id % 11 WHEN 0 THEN 'wrong project tag' WHEN 1 THEN 'Frontmatter malformed' WHEN 2 THEN 'duplicate of x' WHEN 3 THEN 'status update only' WHEN 4 THEN 'casual chatter' WHEN 5 THEN 'no answer yet' WHEN 6 THEN 'wrong person' WHEN 7 THEN 'salary data' WHEN 8 THEN 'obsolete' WHEN 9 THEN 'hm' ELSE NULL END"
_FINAL = "CASE event_id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'flag' END"


@query("P13_cause_and_split", f"""SELECT memory_id, CASE event_id % 11 WHEN 0 THEN 'project_tag' WHEN 1 THEN 'doc_shape' WHEN 2 THEN 'duplicate' WHEN 3 THEN 'narration' WHEN 4 THEN 'chatter_draft' WHEN 5 THEN 'open_question'
      WHEN 6 THEN 'misattribution' WHEN 7 THEN 'third_party_or_sensitive' WHEN 8 THEN 'churn' ELSE 'other' END AS cause,
    CASE WHEN d >= '2024-01-20' THEN 'test' WHEN coalesce({_FINAL}, '') = '' THEN 'unlabeled' WHEN d >= '2024-01-12' THEN 'dev' ELSE 'train' END AS split
    FROM (SELECT *, strftime(observed_at, '%Y-%m-%d') AS d FROM f_memory)""")
def _p13(t: Tables):
    m = t.f_memory
    day = F.to_date("observed_at").cast("string")
    return m.select("memory_id", l.cause_of(F.expr(_WHY)).alias("cause"), l.split_for(day, F.expr(_FINAL), "2024-01-12", "2024-01-20").alias("split"))


@query("A4_derivation_stats", """SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(approval_state) = 0 THEN 'approval_state' WHEN grouping(reasoning_kind) = 0 THEN 'reasoning_kind' ELSE 'total' END AS dimension,
      coalesce(category, approval_state, reasoning_kind, 'all') AS value, count(*) AS n FROM f_memory GROUP BY GROUPING SETS ((), (category), (approval_state), (reasoning_kind))
    UNION ALL SELECT 'job_status', status, count(*) FROM f_job GROUP BY status""")
def _a4(t: Tables):
    m = j.grouped_counts(t.f_memory.select("category", "approval_state", "reasoning_kind"), ["category", "approval_state", "reasoning_kind"])
    return m.union(t.f_job.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.lit("job_status"), "status", "n"))


# --- joins ---------------------------------------------------------------------------


@query("J1_event_derivations", "SELECT m.memory_id, e.event_id, e.event_type, m.category FROM f_memory m JOIN f_events e ON e.event_id = m.event_id")
def _j1(t: Tables):
    return t.f_memory.select("memory_id", "event_id", "category").join(t.f_events.select("event_id", "event_type"), "event_id")


@query("J2_orphan_derivations", "SELECT memory_id, event_id FROM f_evidence WHERE event_id NOT IN (SELECT event_id FROM events)")
def _j2(t: Tables):
    return t.f_evidence.select("memory_id", "event_id").join(t.events.select("event_id"), "event_id", "left_anti")


@query("J4_unpromoted_tier1", f"SELECT memory_id FROM f_memory WHERE {TIER1} AND {EXCL} AND memory_id NOT IN (SELECT memory_id FROM f_promotion WHERE status = 'succeeded')")
def _j4(t: Tables):
    return l.unpromoted_tier1(t.f_memory, t.f_promotion, "main").select("memory_id")


_TXT = "'turn ' || e.event_type || ' ' || repeat('x', CAST(e.event_id % 40 AS INT))"


@query("J5_resolve_evidence", f"""SELECT v.memory_id, CAST(v.pos AS INTEGER) AS pos, v.event_id, e.event_id IS NULL AS missing, coalesce(e.actor_type, '') AS actor, coalesce(left(trim({_TXT}), 30), '') AS text, coalesce(length(trim({_TXT})) > 30, false) AS truncated
    FROM f_evidence v LEFT JOIN f_events e ON e.event_id = v.event_id""")
def _j5(t: Tables):
    e = t.f_events.alias("e").withColumn("text", F.expr(_TXT))
    r = l.resolve_evidence(t.f_evidence, e, 30)
    return r.select("memory_id", F.col("pos").cast("int").alias("pos"), "event_id", "missing", F.coalesce("actor_type", F.lit("")).alias("actor"), F.coalesce("text", F.lit("")).alias("text"), "truncated")


@query("J6_mark_covered", """WITH c AS (SELECT event_id, min(memory_id) AS by_ FROM f_evidence WHERE memory_id LIKE '%@1.2' GROUP BY 1)
    SELECT memory_id, by_ AS superseded_by FROM f_memory m JOIN c USING (event_id) WHERE v = 0 AND approval_state = 'queued'""")
def _j6(t: Tables):
    heur = t.f_memory.where("v = 0 AND approval_state = 'queued'").select("memory_id", "event_id")
    return l.mark_covered(heur, t.f_evidence.where(F.col("memory_id").endswith("@1.2"))).select("memory_id", "superseded_by")


RULES = [("alpha", r"thread-(1|2)\d$"), ("beta", r"-3"), ("gamma", r"thread-[4-6]$")]
OVR = ["('thread-30', 'special')", "('thread-1', 'special')"]
_BUCKET = f"""CASE thread_key WHEN 'thread-30' THEN 'special' WHEN 'thread-1' THEN 'special' ELSE
    CASE WHEN regexp_matches(thread_key, {q(RULES[0][1])}) THEN 'alpha' WHEN regexp_matches(thread_key, {q(RULES[1][1])}) THEN 'beta' WHEN regexp_matches(thread_key, {q(RULES[2][1])}) THEN 'gamma' ELSE 'misc' END END"""


@query("J11_bucket_rules", f"SELECT memory_id, {_BUCKET} AS bucket FROM f_memory")
def _j11(t: Tables):
    return l.bucket_of(t.f_memory, t.values("thread_key, bucket", *OVR), RULES).select("memory_id", "bucket")


@query("J12_attach_valid_at", "SELECT memory_id, coalesce(event_date, observed_at) AS valid_at, CASE WHEN event_date IS NULL THEN 'conversation' ELSE date_precision END AS valid_precision FROM f_memory")
def _j12(t: Tables):
    return l.attach_valid_at(t.f_memory.drop("observed_at"), t.f_events).select("memory_id", "valid_at", "valid_precision")


_REQ = "SELECT memory_id, event_id + 150 * (v + 1) AS event_id FROM f_memory WHERE event_id % 5 = 0 UNION ALL SELECT memory_id, event_id FROM f_evidence WHERE pos = 0 AND event_id % 5 = 0 UNION ALL SELECT m.memory_id, e.event_id FROM f_memory m JOIN f_events e ON e.conversation_id = m.conversation_id AND e.event_id % 50 = 3 WHERE m.event_id % 20 = 1"


def _requests(t: Tables):
    m = t.f_memory
    own = t.f_events.where("event_id % 50 = 3").select("event_id", "conversation_id")
    return (m.where("event_id % 5 = 0").select("memory_id", (F.col("event_id") + 150 * (F.col("v") + 1)).alias("event_id"))
            .union(t.f_evidence.where("pos = 0 AND event_id % 5 = 0").select("memory_id", "event_id"))
            .union(m.where("event_id % 20 = 1").select("memory_id", "conversation_id").join(own, "conversation_id").select("memory_id", "event_id")))


_EXP = f"""WITH r AS ({_REQ}), x AS (SELECT r.memory_id, r.event_id, m.conversation_id IS DISTINCT FROM e.conversation_id AS bad FROM r JOIN f_memory m USING (memory_id) LEFT JOIN f_events e ON e.event_id = r.event_id)"""


@query("J13_expand_evidence", _EXP + """ SELECT DISTINCT memory_id, event_id FROM x WHERE memory_id NOT IN (SELECT memory_id FROM x WHERE bad) AND (memory_id, event_id) NOT IN (SELECT (memory_id, event_id) FROM f_evidence)""")
def _j13(t: Tables):
    return l.expand_evidence(_requests(t), t.f_memory, t.f_evidence, t.f_events)[0].select("memory_id", "event_id")


@query("J13_bad_requests", _EXP + " SELECT memory_id, event_id FROM x WHERE bad")
def _j13b(t: Tables):
    return l.expand_evidence(_requests(t), t.f_memory, t.f_evidence, t.f_events)[1]


# --- aggregates -------------------------------------------------------------------------

_EPI = "(SELECT thread_key, memory_id, event_id, observed_at, status, conversation_id, harness, reasoning_kind, project FROM f_memory)"


def _ordered(col: str, name: str) -> str:
    return f"(SELECT thread_key, string_agg({col}, ',' ORDER BY f) AS {name} FROM (SELECT thread_key, {col}, min((observed_at, memory_id)) AS f FROM f_memory WHERE {col} IS NOT NULL GROUP BY ALL) GROUP BY 1)"


_A24 = f"""SELECT r.*, harnesses, kinds, coalesce(projects, '') AS projects FROM (SELECT thread_key, min(observed_at) AS first_seen_at, min_by(event_id, (observed_at, memory_id)) AS first_event_id, max(observed_at) AS last_seen_at, max_by(event_id, (observed_at, memory_id)) AS last_event_id,
    max_by(status, (observed_at, memory_id)) AS status, count(*) AS episode_count, count(DISTINCT conversation_id) AS n_conversations FROM f_memory GROUP BY 1) r
    LEFT JOIN {_ordered('harness', 'harnesses')} USING (thread_key) LEFT JOIN {_ordered('reasoning_kind', 'kinds')} USING (thread_key) LEFT JOIN {_ordered('project', 'projects')} USING (thread_key)"""


@query("A24_thread_rollup", _A24)
def _a24(t: Tables):
    r = l.thread_rollup(t.f_memory)
    return r.withColumns({c: F.coalesce(F.array_join(c, ","), F.lit("")) for c in ("harnesses", "kinds", "projects")})


@query("A24_thread_members", "SELECT thread_key, conversation_id, min(observed_at) AS first_seen_at, max(observed_at) AS last_seen_at, count(*) AS episodes FROM f_memory GROUP BY ALL")
def _a24m(t: Tables):
    return l.thread_members(t.f_memory)


@query("A15_thread_stats", f"WITH r AS ({_A24}) SELECT status, count(*) AS threads, count(*) FILTER (WHERE contains(harnesses, ',')) AS cross_harness, count(*) FILTER (WHERE n_conversations > 1) AS cross_conversation FROM r GROUP BY 1")
def _a15(t: Tables):
    return l.thread_rollup(t.f_memory).groupBy("status").agg(
        F.count(F.lit(1)).alias("threads"), F.count_if(F.size("harnesses") > 1).alias("cross_harness"), F.count_if(F.col("n_conversations") > 1).alias("cross_conversation"))


@query("A16_overbroad_threads", f"WITH r AS ({_A24}) SELECT thread_key, n_conversations, episode_count, last_seen_at FROM r WHERE status = 'open' AND n_conversations > 3 ORDER BY n_conversations DESC, thread_key")
def _a16(t: Tables):
    r = l.thread_rollup(t.f_memory).where("status = 'open' AND n_conversations > 3")
    return r.select("thread_key", "n_conversations", "episode_count", "last_seen_at").orderBy(F.desc("n_conversations"), "thread_key")


_BOTH = f"""SELECT conversation_id, harness, project, event_id AS ord, CASE WHEN {TIER1} THEN 't1' ELSE 't2' END AS kind FROM f_memory WHERE approval_state = 'queued' AND v = 0
    UNION ALL SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'src9' END, 'docproj', event_id, 'doc' FROM events WHERE event_id % 61 = 0"""


@query("A17_review_conversations", f"""WITH b AS ({_BOTH}) SELECT conversation_id, coalesce(min_by(harness, (kind = 'doc', ord)) FILTER (WHERE harness IS NOT NULL), '') AS harness, coalesce(min_by(project, (kind = 'doc', ord)) FILTER (WHERE project IS NOT NULL), '') AS project,
    count(*) FILTER (WHERE kind = 't1') AS tier1, count(*) FILTER (WHERE kind = 't2') AS tier2, count(*) FILTER (WHERE kind = 'doc') AS docs FROM b GROUP BY 1 HAVING count(*) FILTER (WHERE kind <> 't2') > 0""")
def _a17(t: Tables):
    ep = t.f_memory.where("approval_state = 'queued' AND v = 0").select("conversation_id", "harness", "project", F.col("event_id").alias("ord"), "reasoning_kind")
    docs = t.events.where("event_id % 61 = 0").selectExpr("user_id AS conversation_id", "CASE WHEN event_id % 2 = 0 THEN 'src9' END AS harness", "'docproj' AS project", "event_id AS ord")
    return l.review_conversations(ep, docs).withColumns({c: F.coalesce(c, F.lit("")) for c in ("harness", "project")})


@query("A18_queue_buckets", f"""SELECT coalesce(project, 'misc') AS project, count(*) FILTER (WHERE t1) AS tier1, count(*) FILTER (WHERE NOT t1) AS tier2, count(*) FILTER (WHERE t1 AND seen) AS reviewed, count(*) FILTER (WHERE t1 AND NOT seen) AS queued
    FROM (SELECT project, {TIER1} AS t1, memory_id IN (SELECT memory_id FROM f_audit) AS seen FROM f_memory WHERE {EXCL}) GROUP BY 1""")
def _a18(t: Tables):
    return l.queue_buckets(t.f_memory, l.current_state(t.f_audit))


# --- windows ------------------------------------------------------------------------------

_NAME = f"{slug('harness', '-', 'misc')} || '-' || {slug('project', '-', 'misc')}"


@query("W8_next_sequence_names", f"""WITH u AS (SELECT {_NAME} AS prefix, count(*) AS top FROM f_promotion GROUP BY 1), n AS (SELECT memory_id, {_NAME} AS prefix, row_number() OVER (PARTITION BY {_NAME} ORDER BY observed_at, memory_id) AS rn FROM f_memory WHERE approval_state = 'queued')
    SELECT memory_id, prefix || '-' || CASE WHEN length(CAST(no AS VARCHAR)) >= 3 THEN CAST(no AS VARCHAR) ELSE lpad(CAST(no AS VARCHAR), 3, '0') END AS name FROM (SELECT memory_id, n.prefix, rn + coalesce(top, 0) AS no FROM n LEFT JOIN u USING (prefix))""")
def _w8(t: Tables):
    from memlake.functions import text as tx

    prefix = F.concat(tx.slug(F.col("harness"), default="misc"), F.lit("-"), tx.slug(F.col("project"), default="misc"))
    used = t.f_promotion.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).select(F.concat("p", F.lit("-"), F.col("n").cast("string")).alias("name"))
    new = t.f_memory.where("approval_state = 'queued'").select("memory_id", "harness", "project", "observed_at")
    return l.next_names(new, used, ["observed_at", "memory_id"]).select("memory_id", "name")


@query("W9_stale_versions", """SELECT memory_id, policy_version FROM (SELECT *, max(v) OVER (PARTITION BY event_id) AS top FROM f_memory) WHERE approval_state = 'queued' AND v <> top""")
def _w9(t: Tables):
    return l.stale_versions(t.f_memory, "queued").select("memory_id", "policy_version")


@query("W10_supersedes_chain", "SELECT memory_id, coalesce(lag(memory_id) OVER (PARTITION BY event_id ORDER BY created_at, memory_id), '') AS supersedes FROM f_memory")
def _w10(t: Tables):
    return l.supersedes_chain(t.f_memory).select("memory_id", F.coalesce("supersedes", F.lit("")).alias("supersedes"))


def _greedy(source: str, budget: int) -> str:
    """Greedy runs by recursion over (k, rn, sz, id)."""
    return f"""s AS ({source}), g AS (SELECT k, rn, id, sz AS acc, 1 AS part FROM s WHERE rn = 1
      UNION ALL SELECT s.k, s.rn, s.id, CASE WHEN g.acc + s.sz > {budget} THEN s.sz ELSE g.acc + s.sz END, CASE WHEN g.acc + s.sz > {budget} THEN g.part + 1 ELSE g.part END FROM g JOIN s ON s.k = g.k AND s.rn = g.rn + 1)"""


@query("W12_chunk_by_budget", "WITH " + _greedy("""SELECT thread_key AS k, memory_id AS id, length(statement) * (event_id % 7 + 1) AS sz, row_number() OVER (PARTITION BY thread_key ORDER BY observed_at, memory_id) AS rn FROM f_memory""", 400) + " SELECT id AS memory_id, CAST(part AS BIGINT) AS part FROM g")
def _w12(t: Tables):
    m = t.f_memory.withColumn("size", F.length("statement") * (F.col("event_id") % 7 + 1)).select("memory_id", "thread_key", "observed_at", "size")
    return l.chunk_by_budget(m, ["thread_key"], ["observed_at", "memory_id"], "size", 400, block_rows=100).select("memory_id", "part")


# --- ordering --------------------------------------------------------------------------------


@query("O9_chronological", "SELECT memory_id, event_date FROM f_memory ORDER BY event_date ASC NULLS LAST, memory_id")
def _o9(t: Tables):
    return t.f_memory.select("memory_id", "event_date").orderBy(F.col("event_date").asc_nulls_last(), "memory_id")


@query("O10_priority_order", f"""WITH m AS (SELECT memory_id, conversation_id, {_PRIO} AS label FROM f_memory JOIN {N_EV} USING (memory_id)), x AS (SELECT *, CASE label WHEN 'priority' THEN 0 WHEN 'maybe' THEN 1 ELSE 2 END AS label_rank FROM m)
    SELECT memory_id, label, CAST(min(label_rank) OVER (PARTITION BY conversation_id) AS INTEGER) AS best, count(*) FILTER (WHERE label = 'priority') OVER (PARTITION BY conversation_id) AS n_priority FROM x""")
def _o10(t: Tables):
    return l.priority_order(t.f_memory, n_evidence(t)).select("memory_id", "label", "best", "n_priority")


@query("O11_audit_sample", "SELECT memory_id, md5('seed7' || memory_id) AS k FROM f_audit WHERE batch_id = 'batch-3' GROUP BY 1 ORDER BY k, memory_id LIMIT 100")
def _o11(t: Tables):
    batch = t.f_audit.where("batch_id = 'batch-3'").select("memory_id").distinct()
    return batch.withColumn("k", F.md5(F.concat(F.lit("seed7"), "memory_id"))).orderBy("k", "memory_id").limit(100)


@query("U1_ordered_union", f"SELECT thread_key, harnesses FROM {_ordered('harness', 'harnesses')}")
def _u1(t: Tables):
    return l.ordered_unions(t.f_memory, "thread_key", {"harness": "harnesses"}, F.struct("observed_at", "memory_id")).withColumn("harnesses", F.array_join("harnesses", ","))


@query("U4_ledger_drift", """WITH p AS (SELECT DISTINCT memory_id FROM f_promotion WHERE status = 'succeeded'), g AS (SELECT memory_id FROM f_memory WHERE event_id % 3 <> 1 AND v = 0)
    SELECT memory_id, 'missing_in_graph' AS side FROM p WHERE memory_id NOT IN (SELECT memory_id FROM g) UNION ALL SELECT memory_id, 'not_promoted' FROM g WHERE memory_id NOT IN (SELECT memory_id FROM p)""")
def _u4(t: Tables):
    return l.drift(t.f_promotion.where("status = 'succeeded'"), t.f_memory.where("event_id % 3 <> 1 AND v = 0"))


# --- ledger ------------------------------------------------------------------------------------


@query("L1_current_state", "SELECT memory_id, max_by(new_state, (\"at\", audit_id)) AS new_state, max_by(actor, (\"at\", audit_id)) AS actor, max(\"at\") AS at_ FROM f_audit GROUP BY 1")
def _l1(t: Tables):
    return l.current_state(t.f_audit).select("memory_id", "new_state", "actor", F.col("at").alias("at_"))


_REJ = "approval_state = 'queued' AND category = 'durable_candidate' AND event_date < TIMESTAMP '2024-01-15'"


@query("L2_bulk_reject", f"SELECT memory_id, 'bulk_reject' AS action, 'queued' AS prior_state, 'rejected' AS new_state, 'b1' AS batch_id FROM f_memory WHERE {_REJ}")
def _l2(t: Tables):
    return l.bulk_audit_rows(l.bulk_reject_plan(t.f_memory, "queued", "durable_candidate", "2024-01-15"), "bulk_reject", "rejected", "b1")


@query("L2_bulk_reject_dry_run", "SELECT approval_state, count(*) AS n FROM f_memory WHERE category = 'durable_candidate' AND approval_state = 'queued' AND event_date < TIMESTAMP '2024-01-15' GROUP BY 1")
def _l2d(t: Tables):
    return l.bulk_reject_plan(t.f_memory, "queued", "durable_candidate", "2024-01-15").groupBy("approval_state").agg(F.count(F.lit(1)).alias("n"))


@query("L3_confirm_superseded", "SELECT memory_id, 'bulk_confirm_superseded' AS action, approval_state AS prior_state, 'deferred' AS new_state, 'b2' AS batch_id FROM f_memory WHERE approval_state = 'superseded'")
def _l3(t: Tables):
    return l.bulk_audit_rows(t.f_memory.where("approval_state = 'superseded'"), "bulk_confirm_superseded", "deferred", "b2")


_BATCHES = "SELECT audit_id, memory_id, \"at\", prior_state, CASE WHEN audit_id % 2 = 0 THEN 'from-' || prior_state ELSE batch_id END AS batch_id FROM f_audit"


def _batches(t: Tables):
    """Bulk actions that start from one state, and batches that something else wrote."""
    return t.f_audit.withColumn("batch_id", F.when(F.col("audit_id") % 2 == 0, F.concat(F.lit("from-"), "prior_state")).otherwise(F.col("batch_id")))


@query("L4_revert_batch", "SELECT memory_id, min_by(prior_state, (\"at\", audit_id)) AS restored_state FROM f_audit WHERE batch_id = 'batch-2' GROUP BY 1")
def _l4(t: Tables):
    return l.restore_rows(t.f_memory, t.f_audit, "batch-2").select("memory_id", "restored_state")


@query("L4_revert_bulk_action", f"SELECT DISTINCT memory_id, prior_state AS restored_state FROM ({_BATCHES}) WHERE batch_id = 'from-approved'")
def _l4a(t: Tables):
    return l.revert_batch(t.f_memory, _batches(t), "from-approved")[0].select("memory_id", "restored_state")


@query("L4_refused_batch", f"SELECT batch_id, prior_state, count(*) AS rows FROM ({_BATCHES}) WHERE batch_id = 'batch-2' AND (SELECT count(DISTINCT prior_state) FROM ({_BATCHES}) WHERE batch_id = 'batch-2') > 1 GROUP BY ALL")
def _l4b(t: Tables):
    return l.revert_batch(t.f_memory, _batches(t), "batch-2")[1]


@query("L5_correct", """SELECT memory_id, statement, approval_state, '' AS supersedes, CASE WHEN event_id % 6 = 0 THEN memory_id || '::corrected' ELSE '' END AS superseded_by FROM (SELECT * REPLACE (CASE WHEN event_id % 6 = 0 THEN 'superseded_by_correction' ELSE approval_state END AS approval_state) FROM f_memory)
    UNION ALL SELECT memory_id || '::corrected', 'Fixed ' || event_id, 'queued_for_review', memory_id, '' FROM f_memory WHERE event_id % 6 = 0""")
def _l5(t: Tables):
    fixes = t.f_memory.where("event_id % 6 = 0").select("memory_id", F.concat(F.lit("Fixed "), F.col("event_id").cast("string")).alias("new_statement"), F.lit("me").alias("reviewer"), F.lit("typo").alias("why"))
    r = l.correct(t.f_memory, fixes)
    return r.select("memory_id", "statement", "approval_state", *[F.coalesce(c, F.lit("")).alias(c) for c in ("supersedes", "superseded_by")])


_ITEMS = "SELECT memory_id AS item_id, created_at AS at_, conversation_id, thread_key FROM f_memory WHERE approval_state = 'queued' AND " + TIER1
_BATCH = f"""WITH p AS ({_ITEMS} AND memory_id NOT IN (SELECT memory_id FROM f_audit)), e AS (SELECT *, row_number() OVER (ORDER BY at_, item_id) AS rn FROM p QUALIFY rn <= 50),
    d AS (SELECT 'doc-' || doc_id AS item_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents QUALIFY rn <= 50),
    n AS (SELECT (SELECT count(*) FROM e) AS ne, (SELECT count(*) FROM d) AS nd), k AS (SELECT least(nd, greatest(10, 50 - ne)) AS td, ne FROM n)"""


@query("L7_nightly_batch", _BATCH + " SELECT 'EP' || rn AS label, item_id FROM e, k WHERE rn <= least(ne, 50 - td) UNION ALL SELECT 'DOC' || rn, item_id FROM d, k WHERE rn <= td")
def _l7(t: Tables):
    return _nightly(t).select("label", "item_id")


def _nightly(t: Tables):
    m = t.f_memory.where(F.expr("approval_state = 'queued' AND " + TIER1)).select(F.col("memory_id").alias("item_id"), F.col("created_at").alias("at"))
    docs = t.f_docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("item_id"), F.col("observed_at").alias("at"))
    return l.nightly_batch(m, t.f_audit.select(F.col("memory_id").alias("item_id")).distinct(), docs, 50)


@query("L6_duplicate_hints", _BATCH + """, tn AS (SELECT 'EP' || rn AS label, item_id, conversation_id, thread_key, rn AS no, split_part(item_id, ':', 1)::BIGINT // 4 AS win FROM e, k WHERE rn <= least(ne, 50 - td)),
    pr AS (SELECT 'tonight ' || label AS ref, conversation_id, thread_key, win, no FROM tn UNION ALL SELECT 'ref ' || m.memory_id, m.conversation_id, m.thread_key, m.event_id // 4, 0 FROM f_memory m WHERE m.memory_id IN (SELECT memory_id FROM f_audit)),
    st AS (SELECT DISTINCT label, ref FROM tn JOIN pr USING (win) WHERE pr.no < tn.no),
    wk AS (SELECT DISTINCT label, ref FROM tn JOIN pr USING (thread_key) WHERE pr.no < tn.no AND pr.conversation_id IS DISTINCT FROM tn.conversation_id AND (label, ref) NOT IN (SELECT (label, ref) FROM st))
    SELECT label, 'likely_duplicate_of' AS hint, ref FROM st UNION ALL SELECT label, 'same_thread_as', ref FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ref) AS rn FROM wk) WHERE rn <= 6""")
def _l6(t: Tables):
    win = F.array(F.floor(F.split("memory_id", ":")[0].cast("bigint") / 4))
    m = t.f_memory.select("memory_id", "conversation_id", "thread_key", win.alias("wins"))
    tonight = _nightly(t).where(F.col("label").startswith("EP")).join(m, F.col("item_id") == F.col("memory_id"))
    seen = t.f_audit.select("memory_id").distinct()
    earlier = m.join(seen, "memory_id", "left_semi").withColumn("ref", F.concat(F.lit("ref "), "memory_id"))
    return l.duplicate_hints(tonight, earlier)


@query("L8_reconcile", """WITH ex AS (SELECT doc_id AS record_id, 'c' || doc_id AS candidate_id, 'name ' || doc_id % 400 AS name, source AS body FROM documents WHERE doc_id % 2 = 0),
    i AS (SELECT 'c' || doc_id * 2 AS candidate_id, CASE WHEN doc_id % 10 = 9 THEN ' ' ELSE 'name ' || doc_id % 500 END AS name, source AS body FROM documents),
    x AS (SELECT i.*, a.record_id AS r1, a.body AS b1, b.r2, b.b2, i.name IN ('name 7', 'name 8') AS rej FROM i LEFT JOIN ex a USING (candidate_id)
          LEFT JOIN (SELECT name, min(record_id) AS r2, min_by(body, record_id) AS b2 FROM ex GROUP BY 1) b ON b.name = i.name)
    SELECT candidate_id, name, CASE WHEN trim(name) = '' THEN 'error' WHEN rej THEN 'discarded' WHEN coalesce(r1, r2) IS NULL THEN 'created' WHEN CASE WHEN r1 IS NOT NULL THEN b1 ELSE b2 END = body THEN 'unchanged' ELSE 'updated' END AS action,
           coalesce(CAST(coalesce(r1, r2) AS VARCHAR), '') AS record_id FROM x""")
def _l8(t: Tables):
    ex = t.documents.where("doc_id % 2 = 0").selectExpr("doc_id AS record_id", "'c' || doc_id AS candidate_id", "'name ' || doc_id % 400 AS name", "source AS body")
    inc = t.documents.selectExpr("'c' || doc_id * 2 AS candidate_id", "CASE WHEN doc_id % 10 = 9 THEN ' ' ELSE 'name ' || doc_id % 500 END AS name", "source AS body")
    r = l.reconcile(ex, inc, t.values("name", "'name 7'", "'name 8'"))
    return r.withColumn("record_id", F.coalesce(F.col("record_id").cast("string"), F.lit("")))


@query("L10_scoped_threads", """WITH e AS (SELECT *, conversation_id = 7 AS here, coalesce(project = 'proj-2' AND event_date >= TIMESTAMP '2024-01-06', false) AS near FROM f_memory WHERE event_date <= TIMESTAMP '2024-01-20'),
    g AS (SELECT thread_key, bool_or(here) AS current, max_by(struct_pack(d := event_date, s := status, t := statement), (event_date, memory_id)) FILTER (WHERE here) AS c, max_by(struct_pack(d := event_date, s := status, t := statement), (event_date, memory_id)) FILTER (WHERE near) AS n FROM e GROUP BY 1),
    x AS (SELECT thread_key, current, coalesce(c, n) AS x FROM g)
    SELECT thread_key, current, x.d AS last_seen_at, x.t AS latest_statement, x.s AS status FROM x WHERE x IS NOT NULL AND (current OR x.s <> 'resolved') ORDER BY current DESC, last_seen_at DESC, thread_key DESC LIMIT 20""")
def _l10(t: Tables):
    return l.scoped_threads(t.f_memory, 7, "proj-2", "2024-01-20")


@query("L11_backfill_projects", f"SELECT memory_id, thread_key, coalesce(project, {_BUCKET}) AS project FROM f_memory")
def _l11(t: Tables):
    m = t.f_memory.withColumn("thread_key", F.when(F.col("event_id") % 2 == 0, F.col("thread_key")))
    return l.backfill_projects(m, t.values("thread_key, bucket", *OVR), RULES).select("memory_id", "thread_key", "project")


@query("L12_redate", """WITH r AS (SELECT memory_id, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-02-01' END AS nd FROM f_memory WHERE event_id % 2 = 0),
    x AS (SELECT r.*, m.event_date, m.observed_at, m.memory_id IN (SELECT memory_id FROM f_promotion) AS p, coalesce(nd, observed_at) AS at_ FROM r JOIN f_memory m USING (memory_id))
    SELECT memory_id, CASE WHEN p THEN 'promoted' WHEN at_ IS NOT DISTINCT FROM event_date THEN 'unchanged' ELSE 'changed' END AS outcome, CASE WHEN NOT p AND at_ IS DISTINCT FROM event_date THEN at_ END AS event_date,
           CASE WHEN NOT p AND at_ IS DISTINCT FROM event_date THEN CASE WHEN nd IS NULL THEN 'exact' ELSE 'day' END ELSE '' END AS date_precision FROM x""")
def _l12(t: Tables):
    req = t.f_memory.where("event_id % 2 = 0").select("memory_id", F.expr("CASE WHEN event_id % 3 = 0 THEN TIMESTAMP_NTZ '2024-02-01 00:00:00' END").alias("new_date"))
    return l.redate(req, t.f_memory, t.f_events, t.f_promotion).withColumn("date_precision", F.coalesce("date_precision", F.lit("")))


@query("L14_retag_pending", f"""SELECT memory_id, coalesce(project, '') AS old_project, {_BUCKET} AS new_project FROM f_memory WHERE memory_id NOT IN (SELECT memory_id FROM f_audit) AND memory_id NOT IN (SELECT memory_id FROM f_promotion) AND project IS DISTINCT FROM {_BUCKET}""")
def _l14(t: Tables):
    r = l.retag_pending(t.f_memory, t.values("thread_key, bucket", *OVR), RULES, t.f_audit.select("memory_id").distinct(), t.f_promotion.select("memory_id").distinct())
    return r.withColumn("old_project", F.coalesce("old_project", F.lit("")))


@query("L15_cascade_discard", """SELECT memory_id, thread_key, CASE WHEN p OR h THEN 'blocked' ELSE 'discard' END AS action, CASE WHEN p THEN 'promoted' WHEN h THEN 'human-reviewed' ELSE '' END AS why, coalesce(nj, 0) AS n_jobs
    FROM (SELECT memory_id, thread_key, event_id, memory_id IN (SELECT memory_id FROM f_promotion) AS p, memory_id IN (SELECT memory_id FROM f_audit WHERE actor = 'human') AS h FROM f_memory WHERE conversation_id % 10 = 4)
    LEFT JOIN (SELECT event_id, count(*) AS nj FROM f_job GROUP BY 1) USING (event_id)""")
def _l15(t: Tables):
    return l.cascade_discard(t.f_memory, t.f_job, t.f_audit, t.f_promotion, F.col("conversation_id") % 10 == 4)


@query("L16_mirror_audit", """WITH a AS (SELECT memory_id, approval_state AS s FROM f_memory), m AS (SELECT memory_id, CASE WHEN event_id % 9 = 1 THEN 'queued' ELSE approval_state END AS s FROM f_memory WHERE event_id % 7 <> 0 UNION ALL SELECT 'ghost-' || memory_id, 'queued' FROM f_memory WHERE event_id % 50 = 0)
    SELECT memory_id, CASE WHEN m.s IS NULL THEN 'restore' WHEN a.s IS NULL THEN 'surplus' ELSE 'synchronize' END AS problem, coalesce(a.s, '') AS want FROM a FULL JOIN m USING (memory_id) WHERE a.s IS DISTINCT FROM m.s""")
def _l16(t: Tables):
    led = t.f_memory.select("memory_id", F.col("approval_state").alias("state"))
    mir = t.f_memory.where("event_id % 7 <> 0").selectExpr("memory_id", "CASE WHEN event_id % 9 = 1 THEN 'queued' ELSE approval_state END AS state").union(
        t.f_memory.where("event_id % 50 = 0").selectExpr("'ghost-' || memory_id", "'queued'"))
    return l.mirror_audit(led, mir)


# --- merging -----------------------------------------------------------------------------------------

_RANK = "coalesce(nullif(list_position([" + words(rules.MERGE_KIND_ORDER) + "], reasoning_kind), 0), 99)"
_C9 = f"""{_greedy(f'''SELECT conversation_id || '|' || thread_key AS k, memory_id AS id, length(statement) AS sz,
      row_number() OVER (PARTITION BY conversation_id, thread_key ORDER BY coalesce(event_date, TIMESTAMP '0001-01-01'), memory_id) AS rn FROM f_memory WHERE {TIER1}''', 200)},
    p AS (SELECT m.*, g.part, g.rn, max(g.part) OVER (PARTITION BY g.k) AS n_parts FROM g JOIN f_memory m ON m.memory_id = g.id),
    pn AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, thread_key, part ORDER BY rn) AS i FROM p),
    c9 AS (SELECT 'reason:threadmerge:' || conversation_id || ':' || thread_key || CASE WHEN max(n_parts) > 1 THEN '::part' || part ELSE '' END AS memory_id, conversation_id, thread_key, CAST(part AS BIGINT) AS part, count(*) AS n_members,
        string_agg('(' || i || ') ' || statement, '; ' ORDER BY i) AS statement, min(confidence) AS confidence, min_by(reasoning_kind, ({_RANK}, rn)) AS reasoning_kind, max_by(status, rn) AS status
      FROM pn GROUP BY conversation_id, thread_key, part HAVING count(*) > 1)"""


@query("C9_merge_threads", f"WITH {_C9} SELECT * FROM c9")
def _c9(t: Tables):
    return l.merge_threads(t.f_memory, t.f_evidence, 200).drop("event_date", "members")


@query("C10_retire_absorbed", f"""WITH {_C9}, ch AS (SELECT pn.memory_id, c9.memory_id AS merged_id, c9.statement AS ms, pn.statement, pn.approval_state FROM pn JOIN c9 USING (conversation_id, thread_key, part))
    SELECT memory_id, merged_id AS superseded_by FROM ch WHERE approval_state = 'queued' AND memory_id NOT IN (SELECT memory_id FROM f_audit) AND memory_id NOT IN (SELECT memory_id FROM f_promotion WHERE status = 'succeeded') AND contains(ms, statement)
      AND memory_id NOT IN (SELECT e.memory_id FROM f_evidence e WHERE e.pos >= 3)""")
def _c10(t: Tables):
    merged = cut_lineage(l.merge_threads(t.f_memory, t.f_evidence, 200))  # read three times below
    members = merged.select(F.col("memory_id").alias("merged_id"), F.explode("members").alias("memory_id"))
    children = t.f_memory.select("memory_id", "statement", "approval_state").join(members, "memory_id")
    kept = members.join(t.f_evidence.where("pos < 3"), "memory_id").select(F.col("merged_id").alias("memory_id"), "event_id").distinct()
    own = t.f_evidence.select("memory_id", "event_id", "pos")
    own = own.select("memory_id", F.when(F.col("pos") < 3, F.col("event_id")).otherwise(-1 - F.col("event_id")).alias("event_id"))
    promoted = t.f_promotion.where("status = 'succeeded'").select("memory_id").distinct()
    return l.retire_absorbed(children, merged, own, kept, t.f_audit.select("memory_id").distinct(), promoted)


_MREQ = "SELECT 'merge-' || conversation_id || '-' || CASE WHEN event_id % 3 = 0 THEN thread_key ELSE CAST(event_id % 40 AS STRING) END AS merge_id, memory_id FROM f_memory WHERE approval_state = 'queued' OR event_id % 30 = 0 UNION ALL SELECT 'merge-x' || event_id % 50, 'nope-' || event_id FROM f_events WHERE event_id % 500 = 0"
_MG = f"""WITH r AS ({_MREQ}), x AS (SELECT merge_id, r.memory_id, m.event_id AS known, conversation_id, coalesce(project, '') AS project, approval_state, confidence, event_date, thread_key, created_at, r.memory_id IN (SELECT memory_id FROM f_promotion) AS prom FROM r LEFT JOIN f_memory m USING (memory_id)),
    g AS (SELECT merge_id, count(*) AS n, count(known) AS k, min(conversation_id) AS conversation_id, max(conversation_id) AS c2, min(project) AS project, max(project) AS p2, bool_or(approval_state <> 'queued') AS busy, bool_or(prom) AS prom, min(confidence) AS confidence,
            min(event_date) AS d1, max(event_date) AS d2, count(event_date) AS dn, min_by(memory_id, (created_at, memory_id)) FILTER (WHERE created_at IS NOT NULL) AS supersedes, min(thread_key) AS t1, max(thread_key) AS t2 FROM x GROUP BY 1),
    o AS (SELECT *, CASE WHEN n < 2 OR n > 20 THEN 'size' WHEN k < n THEN 'unknown item' WHEN conversation_id <> c2 THEN 'several conversations' WHEN busy THEN 'not pending' WHEN prom THEN 'promoted' WHEN project <> p2 THEN 'several projects' END AS problem FROM g)"""


def _merge_requests(t: Tables):
    a = t.f_memory.where("approval_state = 'queued' OR event_id % 30 = 0").selectExpr("'merge-' || conversation_id || '-' || CASE WHEN event_id % 3 = 0 THEN thread_key ELSE CAST(event_id % 40 AS STRING) END AS merge_id", "memory_id")
    return a.union(t.f_events.where("event_id % 500 = 0").selectExpr("'merge-x' || event_id % 50", "'nope-' || event_id"))


@query("C11_manual_merge", _MG + " SELECT merge_id, n, conversation_id, project, confidence, CASE WHEN dn = n AND d1 = d2 THEN d1 END AS event_date, supersedes, coalesce(CASE WHEN t1 = t2 THEN t1 END, '') AS thread_key FROM o WHERE problem IS NULL")
def _c11(t: Tables):
    return l.manual_merge(_merge_requests(t), t.f_memory, t.f_promotion)[0].withColumn("thread_key", F.coalesce("thread_key", F.lit("")))


@query("C11_refused_merges", _MG + " SELECT merge_id, n, problem FROM o WHERE problem IS NOT NULL")
def _c11b(t: Tables):
    return l.manual_merge(_merge_requests(t), t.f_memory, t.f_promotion)[1]


@query("C13_carry_forward", """WITH x AS (SELECT memory_id, statement AS old, CASE event_id % 4 WHEN 0 THEN statement || ' and more' WHEN 1 THEN left(statement, 6) WHEN 2 THEN 'Other ' || event_id ELSE '' END AS new FROM f_memory)
    SELECT memory_id, CASE WHEN contains(old, trim(new)) THEN old WHEN contains(new, trim(old)) THEN new ELSE rtrim(old) || chr(10) || chr(10) || trim(new) || chr(10) END AS body FROM x""")
def _c13(t: Tables):
    from memlake.operators.notes import carry_forward

    new = F.expr("CASE event_id % 4 WHEN 0 THEN statement || ' and more' WHEN 1 THEN left(statement, 6) WHEN 2 THEN 'Other ' || event_id ELSE '' END")
    return t.f_memory.select("memory_id", carry_forward(F.col("statement"), new).alias("body"))

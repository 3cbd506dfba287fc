"""Classification and derivation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import dates, rules, text as tx
from memlake.operators import derive as d
from memlake.plans.registry import Tables, query
from memlake.plans.sqltext import q

_MONTHS = rules.MONTH_NAMES


def _shape(n: int, pattern: str, made: str) -> str:
    """Matches of one shape with the 30 characters before each, as (id, shape, idx, at)."""
    return f"""
    SELECT id, {n} AS shape, i, {made} AS at_ FROM (
      SELECT id, i, ms[i] AS m, right(array_to_string(list_transform(range(1, i), lambda k: ps[k] || ms[k]), '') || ps[i], 30) AS before
      FROM (SELECT id, ms, string_split_regex(text, {q(pattern)}) AS ps, unnest(range(1, len(ms) + 1)) AS i
            FROM (SELECT id, text, regexp_extract_all(text, {q(pattern)}) AS ms FROM src) WHERE len(ms) > 0)
    ) WHERE NOT regexp_matches(before, {q(rules.VALIDITY_BOUNDARY)})"""


def _month(m: str) -> str:
    return f"((strpos('janfebmaraprmayjunjulaugsepoctnovdec', left(lower(regexp_extract({m}, '(?i)({_MONTHS})', 1)), 3)) + 2) // 3)"


_Y = "regexp_extract(m, '(\\d{4})$', 1)::INT"


def _ts(y: str, mo: str, dd: str, rest: str = "'00:00:00'") -> str:
    return f"try_cast(printf('%04d-%02d-%02d ', {y}, {mo}, {dd}) || {rest} AS TIMESTAMP)"


def _isop(g: int) -> str:
    return rf"regexp_extract(m, '^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})', {g})::INT"


def dated_ctes(source: str) -> str:
    """CTEs giving ``dated(id, at_, precision)`` for ``source(id, text)``."""
    s = dates.SHAPES
    parts = [
        _shape(0, s[0][0], _ts(_isop(1), _isop(2), _isop(3), "CASE WHEN contains(m, ':') THEN right(m, 8) ELSE '00:00:00' END")),
        _shape(1, s[1][0], _ts(_Y, _month("m"), r"regexp_extract(m, '(\d{1,2})(?:st|nd|rd|th)?[,\s]+\d{4}$', 1)::INT")),
        _shape(2, s[2][0], _ts(_Y, _month("m"), r"regexp_extract(m, '^(\d{1,2})', 1)::INT")),
        _shape(3, s[3][0], _ts(_Y, _month("m"), "1")),
        _shape(4, s[4][0], r"CASE WHEN regexp_extract(m, '(\d{4})', 1)::INT BETWEEN 1970 AND 2100 THEN " + _ts(r"regexp_extract(m, '(\d{4})', 1)::INT", "1", "1") + " END"),
    ]
    return f"""src AS ({source}),
    hits AS ({' UNION ALL '.join(parts)}),
    dated AS (SELECT id, at_, CASE WHEN shape <= 2 THEN 'exact' WHEN shape = 3 THEN 'month' ELSE 'year' END AS precision
              FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shape, i) AS rn FROM hits WHERE at_ IS NOT NULL) WHERE rn = 1)"""


_SRC = "SELECT event_id AS id, text FROM f_conv"


@query("F6_extract_date", f"WITH {dated_ctes(_SRC)} SELECT s.id AS event_id, at_, coalesce(precision, 'none') AS precision FROM src s LEFT JOIN dated USING (id)")
def _f6(t: Tables):
    x = t.f_conv.select("event_id", dates.extract_date(F.col("text")).alias("d"))
    return x.select("event_id", F.col("d.at").alias("at_"), F.coalesce(F.col("d.precision"), F.lit("none")).alias("precision"))


def rx(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


def classify_sql(text: str, heading: str, prec: str, dated: str) -> str:
    """(category, reason) columns of the decision table over a row with those columns."""
    return f"""
      {rx(text, rules.EPISODIC_VERBS)} AS verbs, {rx(text, rules.PREFERENCE_CHANGE)} AS change,
      ({rx(heading, rules.DURABLE_HEADING)} OR {rx(text, rules.DURABLE_WORDS)}) AND NOT {rx(text, rules.PREFERENCE_CHANGE)} AS durable,
      {rx(heading, rules.EPISODIC_HEADING)} OR {rx(text, rules.EPISODIC_VERBS)} OR {rx(text, rules.PREFERENCE_CHANGE)} AS episodic,
      {rx(text, rules.RELATIVE_TIME)} AS relative, {dated} AS has_date, {prec} AS prec, length({text}) AS n_chars"""


_CATEGORY = """CASE WHEN durable AND NOT verbs THEN 'durable_candidate'
      WHEN (durable OR episodic) AND has_date AND (episodic OR durable) THEN CASE WHEN n_chars > 500 THEN 'ambiguous' ELSE 'episodic' END ELSE 'ambiguous' END"""
_REASON = """CASE WHEN durable AND NOT verbs THEN 'durable language'
      WHEN (durable OR episodic) AND has_date AND n_chars > 500 THEN 'too long for an episodic statement'
      WHEN durable AND has_date THEN 'dated state change (' || prec || ')' WHEN durable THEN 'state change without a date'
      WHEN episodic AND has_date THEN 'dated event (' || prec || ')' WHEN episodic AND relative THEN 'relative time only' WHEN episodic THEN 'event without a date'
      WHEN has_date THEN 'date (' || prec || ') without episodic or durable language' ELSE 'undated and unclear' END"""
_HEADING = "CASE turn % 4 WHEN 0 THEN 'Decision log' WHEN 1 THEN 'Profile' ELSE '' END"


@query("C1_classify_candidate", f"""WITH {dated_ctes(_SRC)},
    x AS (SELECT c.event_id, at_, {classify_sql('c.text', _HEADING, "coalesce(precision, 'none')", 'at_ IS NOT NULL')} FROM f_conv c LEFT JOIN dated ON id = event_id)
    SELECT event_id, at_ AS event_date, prec AS date_precision, {_CATEGORY} AS category, {_REASON} AS reason FROM x""")
def _c1(t: Tables):
    c = t.f_conv.select("event_id", "text", F.expr(_HEADING).alias("heading"))
    return d.classify_candidates(c).select("event_id", "event_date", "date_precision", "category", "reason")


_POLICY = f"""WITH {dated_ctes(_SRC)},
    y AS (SELECT c.*, at_ AS own_at, precision, trim(c.text, ' ') AS body, reconstructed AND at_ IS NULL AS lends FROM f_conv c LEFT JOIN dated ON id = event_id),
    z AS (SELECT *, CASE WHEN lends THEN 'On ' || CAST(observed_at AS DATE) || ', ' || body ELSE body END AS txt,
                 CASE WHEN lends THEN observed_at ELSE own_at END AS at2, CASE WHEN lends THEN 'exact' ELSE coalesce(precision, 'none') END AS prec2 FROM y),
    x AS (SELECT event_id, body, actor_type, at2, {classify_sql('txt', "''", 'prec2', 'at2 IS NOT NULL')} FROM z),
    p AS (SELECT event_id, CASE WHEN body = '' OR actor_type <> 'user' THEN 'non_memory' ELSE {_CATEGORY} END AS category,
            CASE WHEN body = '' THEN 'empty content' WHEN actor_type <> 'user' THEN 'not the user''s own words' ELSE {_REASON} END AS reason,
            CASE WHEN body <> '' AND actor_type = 'user' THEN at2 END AS event_date, CASE WHEN body <> '' AND actor_type = 'user' THEN prec ELSE 'none' END AS date_precision FROM x),
    o AS (SELECT *, least(1.0::DOUBLE, CASE category WHEN 'episodic' THEN 0.6::DOUBLE WHEN 'durable_candidate' THEN 0.5::DOUBLE WHEN 'ambiguous' THEN 0.2::DOUBLE ELSE 0::DOUBLE END
            + CASE date_precision WHEN 'exact' THEN 0.3::DOUBLE WHEN 'day' THEN 0.3::DOUBLE WHEN 'month' THEN 0.15::DOUBLE WHEN 'year' THEN 0.05::DOUBLE ELSE 0::DOUBLE END) AS conf FROM p)"""


@query("C2_heuristic_policy", _POLICY + " SELECT event_id, category, reason, event_date, date_precision, round(conf, 6) AS confidence FROM o")
def _c2(t: Tables):
    return d.heuristic_policy(t.f_conv).select("event_id", "category", "reason", "event_date", "date_precision", F.round("confidence", 6).alias("confidence"))


@query("C3_derive", _POLICY + """
    SELECT o.event_id, o.event_id || '::heuristic@1.2' AS memory_id, category,
           CASE WHEN category = 'non_memory' THEN 'rejected' WHEN category = 'episodic' AND conf >= 0.85 THEN 'auto_accepted' ELSE 'queued_for_review' END AS approval_state,
           coalesce(CASE WHEN f.turn % 2 = 0 THEN o.event_id || '::heuristic@1.1' END, '') AS supersedes
    FROM o JOIN f_conv f ON f.event_id = o.event_id WHERE f.turn % 4 <> 3""")
def _c3(t: Tables):
    e = t.f_conv
    jobs = e.where("turn % 4 = 3").select("event_id", F.lit("heuristic").alias("policy"), F.lit("1.2").alias("policy_version"), F.lit("succeeded").alias("status"))
    prior = e.where("turn % 2 = 0").select("event_id", F.explode(F.array(F.lit("1.0"), F.lit("1.1"))).alias("v"), "observed_at").select(
        "event_id", F.concat("event_id", F.lit("::heuristic@"), "v").alias("memory_id"), F.col("observed_at").alias("created_at"))
    return d.derive(e, jobs, prior, "heuristic", "1.2", 0.85).select("event_id", "memory_id", "category", "approval_state", F.coalesce("supersedes", F.lit("")).alias("supersedes"))


_CUES = """text || CASE turn % 8 WHEN 0 THEN ' I decided to stop.' WHEN 1 THEN ' I want to write a plan for our slides for the team.' WHEN 2 THEN ' what if i were there'
  WHEN 3 THEN ' Make it more concise.' WHEN 4 THEN ' stderr: failed' WHEN 5 THEN ' my wife said so' WHEN 6 THEN ' is this a scam' ELSE '' END"""
_FEAT = ", ".join(f"{rx('body', p)}{' OR ' + rx('body', rules.PERSONAL_ACTION) if n == 'completed_action' else ''} AS {n}" for n, p in rules.TURN_FEATURES.items())
_P6 = f"""WITH b AS (SELECT event_id, trim({_CUES}, ' ') AS body FROM f_conv),
    f AS (SELECT event_id, body, {_FEAT} FROM b),
    g AS (SELECT *, NOT (pasted_log OR third_party_text OR table_request OR hypothetical) AND ({rx('body', rules.ROLE_PROFILE)} OR {rx('body', rules.PERSONAL_BIOGRAPHY)}) AS role_profile_fact,
       CASE WHEN completed_action THEN 'completed' WHEN decision THEN 'deciding' WHEN iterative_refinement THEN 'refining'
            WHEN action_intent AND contains(lower(body), 'draft') THEN 'drafting' WHEN action_intent AND (contains(lower(body), 'prepare') OR contains(lower(body), 'plan')) THEN 'planning'
            WHEN action_intent THEN 'developing' ELSE 'researching' END AS stage FROM f)"""


def _cued(t: Tables):
    return t.f_conv.select("event_id", F.expr(_CUES).alias("text"))


@query("P6_turn_features", _P6 + " SELECT * EXCLUDE (body) FROM g")
def _p6(t: Tables):
    return d.turn_features(_cued(t)).drop("text")


_C4SRC = f"SELECT event_id AS id, trim({_CUES}, ' ') AS text FROM f_conv"
_GENERIC = ", ".join(f"{rx('body', p)} AS {n}" for n, p in (
    ("image", rules.GENERIC_IMAGE), ("dataset", rules.GENERIC_DATASET), ("code", rules.GENERIC_CODE), ("trivia", rules.GENERIC_TRIVIA)))


@query("C4_candidate_gate", _P6.replace("WITH b AS", f"WITH {dated_ctes(_C4SRC)}, b AS") + f""",
    g2 AS (SELECT g.*, at_ IS NOT NULL AS dated, role_profile_fact AND {rx('body', rules.PERSONAL_BIOGRAPHY)} AS bio, {_GENERIC},
             {rx('body', rules.GENERIC_COMMAND)} AND len(string_split_regex(body, '\\s+')) < 6 AS command, first_person_singular OR first_person_org AS me
           FROM g LEFT JOIN dated ON id = event_id),
    h AS (SELECT event_id, stage, CASE WHEN pasted_log AND NOT completed_action THEN 'non_memory_no_personal_significance'
        WHEN third_party_text OR table_request OR troubleshooting THEN 'non_memory_no_personal_significance' WHEN hypothetical THEN 'non_memory_hypothetical'
        WHEN image OR (dataset AND NOT completed_action) THEN 'non_memory_no_personal_significance'
        WHEN generic_drafting AND NOT named_artifact AND NOT role_profile_fact THEN 'non_memory_generic_drafting'
        WHEN (code OR trivia) AND NOT completed_action AND NOT bio AND NOT named_artifact THEN 'non_memory_generic_research'
        WHEN command THEN 'non_memory_no_personal_significance' WHEN bio THEN 'durable_explicit_profile_fact'
        WHEN delivered_portfolio AND NOT (action_intent OR named_artifact) THEN 'durable_explicit_profile_fact'
        WHEN completed_action AND dated THEN 'episodic_confirmed_action'
        WHEN me AND named_artifact AND (action_intent OR decision OR delivered_portfolio) THEN 'episodic_significant_artifact_session'
        WHEN completed_action OR (me AND (named_artifact OR action_intent)) THEN 'ambiguous_personal_context'
        ELSE 'non_memory_no_personal_significance' END AS reason_code FROM g2)
    SELECT *, regexp_extract(reason_code, '^(non_memory|durable|episodic|ambiguous)', 1) AS category FROM h""")
def _c4(t: Tables):
    return d.candidate_gate(_cued(t)).select("event_id", "stage", "reason_code", "category")


_OV = "SELECT event_id AS source_id, CASE event_id % 9 WHEN 0 THEN 'exclude' WHEN 1 THEN 'reclassify' WHEN 2 THEN 'consolidate' ELSE 'split' END AS action, CASE event_id % 9 WHEN 1 THEN 'episodic' WHEN 2 THEN 'group-' || event_id % 50 END AS target FROM f_events WHERE event_id % 9 < 4"


@query("C5_overrides", f"""WITH ov AS ({_OV}), j AS (SELECT e.memory_id, e.event_id AS source_id, m.category, action, target FROM f_evidence e JOIN f_memory m USING (memory_id) LEFT JOIN ov ON ov.source_id = e.event_id)
    SELECT CASE action WHEN 'consolidate' THEN target WHEN 'split' THEN memory_id || '#' || source_id ELSE memory_id END AS memory_id,
           min(CASE WHEN action = 'reclassify' THEN target ELSE category END) AS category, count(DISTINCT source_id) AS n_sources, min(source_id) AS first_source
    FROM j WHERE coalesce(action, '') <> 'exclude' GROUP BY 1""")
def _c5(t: Tables):
    items = t.f_evidence.select("memory_id", F.col("event_id").alias("source_id")).join(t.f_memory.select("memory_id", "category"), "memory_id")
    ov = t.f_events.where("event_id % 9 < 4").selectExpr(
        "event_id AS source_id", "CASE event_id % 9 WHEN 0 THEN 'exclude' WHEN 1 THEN 'reclassify' WHEN 2 THEN 'consolidate' ELSE 'split' END AS action",
        "CASE event_id % 9 WHEN 1 THEN 'episodic' WHEN 2 THEN 'group-' || event_id % 50 END AS target")
    return d.apply_overrides(items, ov)


@query("C6_provenance_violations", """WITH c AS (SELECT memory_id, event_id AS source_id, count(*) AS times FROM (SELECT memory_id, event_id FROM f_evidence UNION ALL SELECT memory_id, event_id FROM f_evidence WHERE event_id % 11 = 0) GROUP BY ALL)
    SELECT memory_id, source_id, CASE WHEN e.event_id IS NULL THEN 'unresolved' ELSE 'duplicate' END AS problem
    FROM c LEFT JOIN (SELECT event_id FROM f_events WHERE actor_type = 'user') e ON e.event_id = source_id WHERE e.event_id IS NULL OR times > 1""")
def _c6(t: Tables):
    ev = t.f_evidence.select("memory_id", F.col("event_id").alias("source_id"))
    return d.provenance_violations(ev.union(ev.where("source_id % 11 = 0")), t.f_events.where("actor_type = 'user'"))


@query("C7_import_accounting", """WITH x AS (SELECT conversation_id, event_id, actor_type, text FROM f_conv UNION ALL SELECT conversation_id, event_id, actor_type, text FROM f_conv WHERE turn % 3 = 1)
    SELECT count(DISTINCT conversation_id) AS conversations, count(*) AS messages, count(*) - count(DISTINCT event_id) AS duplicate_message_ids,
           count(*) FILTER (WHERE actor_type = 'user') AS user_messages,
           count(*) FILTER (WHERE actor_type = 'user') - count(DISTINCT CASE WHEN actor_type = 'user' THEN lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) END) AS duplicate_fingerprints FROM x""")
def _c7(t: Tables):
    c = t.f_conv.select("conversation_id", "event_id", "actor_type", "text", "turn")
    return d.import_accounting(c.union(c.where("turn % 3 = 1")))


@query("C8_redate", f"""WITH {dated_ctes(_SRC)},
    y AS (SELECT c.event_id, CASE WHEN turn % 2 = 0 THEN observed_at END AS old, at_ AS new, {rx('c.text', rules.VALIDITY_BOUNDARY)} AS boundary FROM f_conv c LEFT JOIN dated ON id = event_id)
    SELECT event_id, CASE WHEN new IS NOT NULL THEN new WHEN NOT boundary THEN old END AS event_date,
           CASE WHEN new IS NULL THEN boundary AND old IS NOT NULL ELSE old IS NOT NULL AND new <> old END AS redated FROM y""")
def _c8(t: Tables):
    items = t.f_conv.select("event_id", "text", F.when(F.col("turn") % 2 == 0, F.col("observed_at")).alias("original_at"))
    return d.redate(items).select("event_id", "event_date", F.coalesce("redated", F.lit(False)).alias("redated"))


@query("J9_lookahead_correction", f"""WITH n AS (SELECT *, sum((actor_type = 'user')::INT) OVER (PARTITION BY conversation_id ORDER BY observed_at, event_id) AS user_no FROM f_conv),
    m AS (SELECT * FROM n WHERE turn % 2 = 1),
    h AS (SELECT m.event_id, u.event_id AS by_id, u.user_no - m.user_no AS k FROM m JOIN n u ON u.conversation_id = m.conversation_id AND u.actor_type = 'user' AND u.user_no > m.user_no AND u.user_no <= m.user_no + 6 AND {rx('u.text', rules.CORRECTION)})
    SELECT 'm' || m.event_id AS memory_id, coalesce(min_by(by_id, k), '') AS corrected_by, CAST(coalesce(min(k), 0) AS INTEGER) AS turns_ahead FROM m LEFT JOIN h ON h.event_id = m.event_id GROUP BY 1""")
def _j9(t: Tables):
    mem = t.f_conv.where("turn % 2 = 1").select("event_id", F.concat(F.lit("m"), "event_id").alias("memory_id"))
    r = d.lookahead_correction(mem, t.f_conv.select("event_id", "conversation_id", "actor_type", "text", "observed_at"), ["observed_at", "event_id"])
    return r.select("memory_id", F.coalesce("corrected_by", F.lit("")).alias("corrected_by"), F.coalesce("turns_ahead", F.lit(0)).alias("turns_ahead"))

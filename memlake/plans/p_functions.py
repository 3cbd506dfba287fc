"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import dates, identity, rules, text as tx, vectors
from memlake.operators import derive
from memlake.operators import revisions as rev
from memlake.plans.registry import Tables, query
from memlake.plans.sqltext import bm25_tokens, count_of, fold_words, q, slug, squeeze, terms, words

AS_OF = "2024-02-01 12:00:00"


@query("F1_slug", f"SELECT p_partkey, {slug('name')} AS key, {slug('odd', '-', 'misc')} AS short FROM (SELECT p_partkey, '  ' || p_name || ' & ' || p_brand AS name, CASE WHEN p_partkey % 5 = 0 THEN '--' ELSE p_type END AS odd FROM part)")
def _f1(t: Tables):
    p = t.part.selectExpr("p_partkey", "'  ' || p_name || ' & ' || p_brand AS name", "CASE WHEN p_partkey % 5 = 0 THEN '--' ELSE p_type END AS odd")
    return p.select("p_partkey", tx.slug(F.col("name")).alias("key"), tx.slug(F.col("odd"), "-", "misc").alias("short"))


@query("F2_fold_words", f"SELECT doc_id, md5({fold_words('text')}) AS folded_md5 FROM documents")
def _f2(t: Tables):
    return t.documents.select("doc_id", F.md5(tx.fold_words(F.col("text"))).alias("folded_md5"))


@query("F3_contains_phrase", f"SELECT doc_id, contains(' ' || {fold_words('text')} || ' ', ' ' || phrase || ' ') AS hit FROM (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'in the' ELSE 'of' END AS phrase FROM documents)")
def _f3(t: Tables):
    phrase = F.expr("CASE doc_id % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'in the' ELSE 'of' END")
    return t.documents.select("doc_id", tx.contains_phrase(tx.fold_words(F.col("text")), phrase).alias("hit"))


_NORM = """CASE WHEN regexp_matches(name, '^[A-Z0-9]+$') THEN k WHEN k LIKE '%ies' AND length(k) > 4 THEN left(k, length(k) - 3) || 'y'
    WHEN k LIKE '%s' AND k NOT LIKE '%ss' AND length(k) > 3 THEN left(k, length(k) - 1) ELSE k END"""
NORM_SQL = f"(SELECT *, {_NORM} AS norm FROM (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM f_entity))"


@query("F4_normalize_entity", f"SELECT entity_id, norm FROM {NORM_SQL}")
def _f4(t: Tables):
    return t.f_entity.select("entity_id", tx.normalize_entity(F.col("name")).alias("norm"))


_W = "regexp_extract_all(lower({}), '[a-z0-9]+')"


@query("F5_acronym_containment", f"""SELECT p_partkey, len(b) >= 2 AND length(short) >= 2 AND lower(short) = array_to_string(list_transform(b, lambda x: left(x, 1)), '') AS acronym,
      len(a) > 0 AND len(a) < len(b) AND len(list_filter(a, lambda x: x NOT IN ({words(rules.BM25_STOPWORDS)}))) > 0 AND len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS contained
    FROM (SELECT *, {_W.format('short')} AS a, {_W.format('long')} AS b FROM (
      SELECT p_partkey, p_name || ' ' || p_type AS long, CASE p_partkey % 3 WHEN 0 THEN upper(left(p_name, 1) || left(split_part(p_name, ' ', 2), 1) || left(p_type, 1)) WHEN 1 THEN split_part(p_name, ' ', 1) ELSE p_brand END AS short FROM part))""")
def _f5(t: Tables):
    p = t.part.selectExpr("p_partkey", "p_name || ' ' || p_type AS long", """CASE p_partkey % 3 WHEN 0 THEN upper(left(p_name, 1) || left(split_part(p_name, ' ', 2), 1) || left(p_type, 1))
        WHEN 1 THEN split_part(p_name, ' ', 1) ELSE p_brand END AS short""")
    return p.select("p_partkey", tx.is_acronym(F.col("short"), F.col("long")).alias("acronym"), tx.is_contained(F.col("short"), F.col("long")).alias("contained"))


_REF = """SELECT event_id, observed_at, CASE event_id % 7 WHEN 0 THEN '2024-01-29 to 2024-02-16' WHEN 1 THEN '2023-05-04' WHEN 2 THEN '2023-05' WHEN 3 THEN '2022' WHEN 4 THEN '2023-02-31' WHEN 5 THEN '2021-07-xx' ELSE NULL END AS stated,
      CASE event_id % 7 WHEN 5 THEN 'month' ELSE 'day' END AS prec, CASE event_id % 4 WHEN 0 THEN 'explicit' WHEN 1 THEN 'Calibrated' WHEN 2 THEN 'message_time' ELSE 'unknown' END AS basis FROM f_events"""


@query("F7_reference_time", f"""WITH r AS ({_REF}), s AS (SELECT *, event_id % 7 AS m, lower(basis) IN ('explicit', 'calibrated') AS told FROM r)
    SELECT event_id, CASE WHEN told AND m = 0 THEN TIMESTAMP '2024-01-29' WHEN told AND m = 1 THEN TIMESTAMP '2023-05-04' WHEN told AND m = 2 THEN TIMESTAMP '2023-05-01'
        WHEN told AND m = 3 THEN TIMESTAMP '2022-01-01' WHEN told AND m = 5 THEN TIMESTAMP '2021-07-01' ELSE observed_at END AS at_,
      CASE WHEN basis = 'message_time' THEN 'exact_observed_at' WHEN told AND m = 0 THEN 'normalized_range_start_date_utc' WHEN told AND m = 1 THEN 'normalized_day_midnight_utc'
        WHEN told AND m IN (2, 5) THEN 'normalized_month_first_day_utc' WHEN told AND m = 3 THEN 'normalized_year_first_day_utc' ELSE 'fallback_observed_at' END AS rule FROM s""")
def _f7(t: Tables):
    r = t.f_events.selectExpr("event_id", "observed_at", """CASE event_id % 7 WHEN 0 THEN '2024-01-29 to 2024-02-16' WHEN 1 THEN '2023-05-04' WHEN 2 THEN '2023-05' WHEN 3 THEN '2022'
        WHEN 4 THEN '2023-02-31' WHEN 5 THEN '2021-07-xx' END AS stated""", "CASE event_id % 7 WHEN 5 THEN 'month' ELSE 'day' END AS prec",
        "CASE event_id % 4 WHEN 0 THEN 'explicit' WHEN 1 THEN 'Calibrated' WHEN 2 THEN 'message_time' ELSE 'unknown' END AS basis")
    x = r.withColumn("r", dates.reference_time(F.col("observed_at"), F.col("stated"), F.col("prec"), F.col("basis"), F.lit(AS_OF).cast("timestamp_ntz")))
    return x.select("event_id", F.col("r.at").alias("at_"), F.col("r.rule").alias("rule"))


@query("F8_parse_edit_date", """SELECT event_id, try_cast(CASE event_id % 4 WHEN 0 THEN strftime(observed_at, '%Y-%m-%d') WHEN 1 THEN strftime(observed_at, '%Y-%m') || '-01' WHEN 2 THEN strftime(observed_at, '%Y') || '-01-01' END AS TIMESTAMP) AS at_,
      CASE event_id % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' ELSE 'none' END AS precision FROM f_events""")
def _f8(t: Tables):
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN left(CAST(observed_at AS STRING), 10) WHEN 1 THEN left(CAST(observed_at AS STRING), 7) WHEN 2 THEN left(CAST(observed_at AS STRING), 4) ELSE 'soon' END")
    return t.f_events.withColumn("raw", raw).select("event_id", dates.parse_partial(F.col("raw")).alias("at_"), dates.partial_precision(F.col("raw")).alias("precision"))


@query("F9_describe_age", f"""SELECT doc_id, 'created ' || CAST(observed_at AS DATE) || CASE WHEN doc_id % 4 = 0 THEN ' (on or before)' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' | updated ' || CAST(u AS DATE) || ' (' ||
      CASE greatest(datediff_s // 86400, 0) WHEN 0 THEN 'today' WHEN 1 THEN '1 day ago' ELSE greatest(datediff_s // 86400, 0) || ' days ago' END || ')' END AS age
    FROM (SELECT *, CAST(floor(epoch(TIMESTAMP '{AS_OF}') - epoch(u)) AS BIGINT) AS datediff_s FROM (SELECT doc_id, observed_at, observed_at + (doc_id % 40) * INTERVAL 1 DAY AS u FROM f_docs))""")
def _f9(t: Tables):
    d = t.f_docs.withColumn("u", F.expr("CASE WHEN doc_id % 3 <> 0 THEN observed_at + make_dt_interval(CAST(doc_id % 40 AS INT)) END"))
    return d.select("doc_id", dates.describe_age(F.col("observed_at"), F.col("u"), F.lit(AS_OF).cast("timestamp_ntz"), F.col("doc_id") % 4 == 0).alias("age"))


_HEADS = """CASE p_partkey % 6 WHEN 0 THEN '3A. **' || p_name || '** ' WHEN 1 THEN 'Step 4: ' || p_name WHEN 2 THEN 'June 4, 2026 — ' || p_name WHEN 3 THEN p_name || ' (updated March 2024)'
    WHEN 4 THEN p_name || ' - Added 2024-01-02 draft' ELSE '`' || p_name || '`:' END"""


@query("F10_clean_heading", "SELECT p_partkey, p_name AS clean FROM part")
def _f10(t: Tables):
    return t.part.select("p_partkey", tx.clean_heading(F.expr(_HEADS)).alias("clean"))


@query("F11_parse_reason", """SELECT memory_id, 'what about ' || event_type || '?' AS question, 'value seen' AS rationale, 'wait ' || event_id % 3 AS alternatives, status, thread_key
    FROM f_memory JOIN (SELECT event_id, event_type FROM events) USING (event_id)""")
def _f11(t: Tables):
    names = {"question": "Q", "rationale": "why", "alternatives": "alt", "status": "status", "thread_key": "thread"}
    return t.f_memory.select("memory_id", *[tx.reason_field(F.col("reason"), tag).alias(n) for n, tag in names.items()])


_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_H = "md5(CAST({} AS STRING))"


def _uuid(expr: str) -> str:
    h = f"md5(CAST({expr} AS STRING))"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12))"


_MID = f"'reason:' || {_uuid('conversation_id')} || CASE WHEN event_id % 3 = 0 THEN '' ELSE ':' || {_uuid('event_id + 1000000')} || ':' || CAST(event_id % 5 AS STRING) END || '::p@1.0'"


@query("F12_parse_ids", f"SELECT event_id, {_uuid('conversation_id')} AS conversation, CASE WHEN event_id % 3 = 0 THEN '' ELSE {_uuid('event_id + 1000000')} || ',' || event_id % 5 END AS windows FROM f_events")
def _f12(t: Tables):
    from memlake.operators.ledger import parse_ids

    mid = t.f_events.select("event_id", F.expr(_MID).alias("memory_id"))
    p = mid.withColumn("p", parse_ids(F.col("memory_id")))
    return p.select("event_id", F.col("p.conversation").alias("conversation"), F.array_join(F.coalesce("p.windows", F.array().cast("array<string>")), ",").alias("windows"))


@query("F13_provenance", """SELECT episode_id, 'reasoning_kind=' || CASE episode_id % 3 WHEN 0 THEN 'decision' WHEN 1 THEN 'plan' ELSE 'insight' END || ' · project=' || split_part(project, ' ', 1)
    || CASE WHEN contains(project, ' ') THEN '' ELSE '' END || ' · evidence=' || (episode_id % 5 + 1) || ' turn(s)' AS provenance, 'm' || episode_id AS memory_id FROM f_episode""")
def _f13(t: Tables):
    return t.f_episode.select("episode_id", tx.provenance(F.col("source_description")).alias("provenance"), tx.memory_id_of(F.col("source_description")).alias("memory_id"))


@query("F14_query_terms", f"SELECT item_id, array_to_string({terms('text')}, ' ') AS terms FROM benchmark")
def _f14(t: Tables):
    return t.benchmark.select("item_id", F.array_join(tx.query_terms(F.col("text")), " ").alias("terms"))


_SNIP = f"""p AS (SELECT doc_id, text, lower(text) AS low, string_split_regex(text, '\\s+')[-1] || ' the onenth' AS query FROM documents WHERE length(text) > 0),
    s AS (SELECT doc_id, text, low, lower(trim(query, ' ')) AS q FROM p),
    wd AS (SELECT DISTINCT doc_id, low, regexp_replace(w, '^[^a-zA-Z0-9_]+|[^a-zA-Z0-9_]+$', '', 'g') AS w FROM (SELECT doc_id, low, unnest(string_split_regex(q, '\\s+')) AS w FROM s)),
    sp AS (SELECT doc_id, w, list_transform(string_split(low, w), lambda x: length(x)) AS gaps FROM wd WHERE length(w) > 2),
    hit AS (SELECT DISTINCT doc_id, at_ FROM (SELECT doc_id, list_sum(gaps[1:k]) + (k - 1) * length(w) AS at_ FROM (SELECT doc_id, w, gaps, unnest(range(1, len(gaps))) AS k FROM sp))),
    cov AS (SELECT doc_id, at_, count(*) OVER (PARTITION BY doc_id ORDER BY at_ RANGE BETWEEN 140 PRECEDING AND 140 FOLLOWING) AS c FROM hit),
    a1 AS (SELECT doc_id, arg_min(at_, (-c, at_)) AS x FROM cov GROUP BY 1), a2 AS (SELECT doc_id, arg_min(at_, (-c, at_)) AS x FROM cov JOIN a1 USING (doc_id) WHERE abs(at_ - a1.x) >= 280 GROUP BY 1),
    a3 AS (SELECT cov.doc_id, arg_min(at_, (-c, at_)) AS x FROM cov JOIN a1 ON a1.doc_id = cov.doc_id JOIN a2 ON a2.doc_id = cov.doc_id WHERE abs(at_ - a1.x) >= 280 AND abs(at_ - a2.x) >= 280 GROUP BY 1),
    pick AS (SELECT doc_id, x, 0 AS extra FROM s JOIN (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3) USING (doc_id) WHERE NOT contains(low, q) UNION ALL SELECT doc_id, strpos(low, q) - 1, length(q) FROM s WHERE contains(low, q)),
    piece AS (SELECT doc_id, x, (CASE WHEN x > 140 THEN '...' ELSE '' END) || trim(regexp_replace(substr(text, greatest(x - 140, 0)::BIGINT + 1, (least(x + extra + 140, length(text)) - greatest(x - 140, 0))::BIGINT), '\\s+', ' ', 'g'), ' ')
              || (CASE WHEN x + extra + 140 < length(text) THEN '...' ELSE '' END) AS t FROM pick JOIN s USING (doc_id))"""


@query("F15_snippet", f"""WITH {_SNIP} SELECT d.doc_id, CASE WHEN length(d.text) > 0 THEN coalesce(t, trim(regexp_replace(left(d.text, 280), '\\s+', ' ', 'g'), ' ') || CASE WHEN length(d.text) > 280 THEN '...' ELSE '' END) END AS snippet
    FROM documents d LEFT JOIN (SELECT doc_id, string_agg(t, ' … ' ORDER BY x) AS t FROM piece GROUP BY 1) USING (doc_id)""")
def _f15(t: Tables):
    probe = F.element_at(F.split("text", r"\s+"), -1)
    return t.documents.select("doc_id", tx.snippet(F.col("text"), F.concat_ws(" ", probe, F.lit("the onenth"))).alias("snippet"))


_EXC = f"""SELECT doc_id, t, lower(t) AS low FROM (SELECT doc_id, {squeeze('text')} AS t FROM documents)"""


@query("F16_excerpt", f"""WITH e AS ({_EXC}), s AS (SELECT doc_id, t, low, unnest(range(0, greatest(length(t) - 280, 0) + 1, 40)) AS st FROM e),
    h AS (SELECT doc_id, st, {count_of('w', "'the'")} + {count_of('w', "'in'")} + {count_of('w', "'qu'")} AS hits FROM (SELECT *, substr(low, st + 1, 280) AS w FROM s)),
    b AS (SELECT doc_id, st FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, st) AS rn FROM h) WHERE rn = 1)
    SELECT doc_id, md5(CASE WHEN length(t) <= 280 THEN t ELSE CASE WHEN st > 0 THEN '…' ELSE '' END || substr(t, st + 1, 280) || CASE WHEN st + 280 < length(t) THEN '…' ELSE '' END END) AS excerpt_md5
    FROM e JOIN b USING (doc_id)""")
def _f16(t: Tables):
    terms_ = F.array(F.lit("the"), F.lit("in"), F.lit("qu"))
    return t.documents.select("doc_id", F.md5(tx.excerpt(F.col("text"), terms_)).alias("excerpt_md5"))


_LEDE_SRC = "CASE WHEN doc_id % 4 = 0 THEN '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) ELSE '' END || text"


@query("F17_lede", f"""WITH b AS (SELECT doc_id, {squeeze('text')} AS c FROM documents), p AS (SELECT *, strpos(c, '. ') - 1 AS d, strpos(c, '; ') - 1 AS s FROM b)
    SELECT doc_id, CASE WHEN d BETWEEN 20 AND 240 THEN left(c, d + 1) WHEN s BETWEEN 20 AND 240 THEN left(c, s + 1) WHEN length(c) > 240 THEN rtrim(left(c, 240)) || '...' ELSE c END AS lede FROM p""")
def _f17(t: Tables):
    return t.documents.select("doc_id", tx.lede(F.expr(_LEDE_SRC)).alias("lede"))


@query("F18_cosine", """SELECT a.vec_id, round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 6) AS cosine
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1""")
def _f18(t: Tables):
    e = t.embeddings.select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("F19_confidence", """SELECT memory_id, round(least(1.0, CASE category WHEN 'episodic' THEN 0.6 WHEN 'durable_candidate' THEN 0.5 WHEN 'ambiguous' THEN 0.2 ELSE 0.0 END
    + CASE date_precision WHEN 'exact' THEN 0.3 WHEN 'day' THEN 0.3 WHEN 'month' THEN 0.15 WHEN 'year' THEN 0.05 ELSE 0.0 END)::DOUBLE, 6) AS score FROM f_memory""")
def _f19(t: Tables):
    return t.f_memory.select("memory_id", F.round(derive.confidence(F.col("category"), F.col("date_precision")), 6).alias("score"))


@query("F21_json_access", """SELECT event_id, metadata->>'$.via' AS via, CAST(content->>'$.props.k' AS BIGINT) AS k FROM f_events WHERE metadata->>'$.client_version' = '1.2'""")
def _f21(t: Tables):
    e = t.f_events.where(F.get_json_object("metadata", "$.client_version") == "1.2")
    return e.select("event_id", F.get_json_object("metadata", "$.via").alias("via"), F.get_json_object("content", "$.props.k").cast("bigint").alias("k"))


# Every third note has its accents as combining marks, which normalisation joins.
_NOTE = "CASE WHEN event_id % 3 = 0 THEN replace(event_type, 'e', 'e' || chr(769)) ELSE event_type END"
_CANON = f"""'{{"note":"' || nfc_normalize({_NOTE}) || '","text":"value ' || CAST(user_id AS STRING) || '"}}'"""


@query("F22_content_hash_event_id", f"""SELECT event_id AS id, 'sha256:' || sha256({_CANON}) AS content_hash,
    CASE WHEN event_id % 2 = 0 THEN 'src:' || user_id || ':' || event_id ELSE 'src:backfill:' || sha256({_CANON}) END AS stable_id FROM events""")
def _f22(t: Tables):
    e = t.events.select("event_id", "user_id", identity.content_hash({
        "text": F.concat(F.lit("  value "), F.col("user_id").cast("string"), F.lit(" ")), "note": F.expr("CASE WHEN event_id % 3 = 0 THEN replace(event_type, 'e', 'e\u0301') ELSE event_type END")}).alias("content_hash"))
    turn = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string"))
    sid = identity.event_id(F.lit("src"), F.col("content_hash"), F.col("user_id").cast("string"), turn, F.lit("backfill"))
    return e.select(F.col("event_id").alias("id"), "content_hash", sid.alias("stable_id"))


@query("F22_origin_fingerprint", f"""WITH o AS (SELECT event_id, 'src_' || left(sha256('export:' || CASE WHEN turn % 2 = 0 THEN 'plans ahead' ELSE '' END || ':' || trim(regexp_replace(lower(trim(text, ' ')), '\\s+', ' ', 'g'), ' ')), 16) AS origin_id,
      CASE WHEN turn % 2 = 0 THEN strftime(observed_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' ELSE 'undated' END AS iso FROM f_conv)
    SELECT event_id, origin_id, left(sha256(origin_id || ':' || iso), 16) AS fingerprint FROM o""")
def _f22b(t: Tables):
    c = t.f_conv
    c = c.withColumn("origin_id", identity.origin_id(F.lit("Export"), F.when(F.col("turn") % 2 == 0, F.lit("Plans  ahead")), F.col("text")))
    return c.select("event_id", "origin_id", identity.fingerprint(F.col("origin_id"), F.when(F.col("turn") % 2 == 0, F.col("observed_at"))).alias("fingerprint"))


@query("F23_front_matter", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'proj-' || doc_id % 7 END AS project, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS created FROM documents")
def _f23(t: Tables):
    body = F.expr("""CASE WHEN doc_id % 3 = 0 THEN text ELSE '---\\ntitle: a\\nproject: proj-' || (doc_id % 7) || '\\ncreated: "2024-01-' || lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0') || '"\\n---\\n' || text END""")
    d = t.documents.select("doc_id", body.alias("text"))
    return d.select("doc_id", *[F.coalesce(tx.front_matter_field(F.col("text"), f), F.lit("")).alias(f) for f in ("project", "created")])


@query("F24_project_of_path", """SELECT event_id, CASE coalesce(a.new, p.project) WHEN '' THEN 'unknown' ELSE coalesce(a.new, p.project) END AS project FROM (
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'tool-' || user_id % 9 WHEN 2 THEN 'tmp-other' WHEN 3 THEN 'other' ELSE 'app-' || user_id % 4 END AS project FROM events) p
    LEFT JOIN (VALUES ('tool-1', 'tools'), ('app-2', 'apps')) a(old, new) ON a.old = p.project""")
def _f24(t: Tables):
    path = F.expr("""CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '-Users-me-Dev-tool-' || user_id % 9 WHEN 2 THEN '-private-var-folders-zz-T-tmp1' WHEN 3 THEN '-opt-x'
        ELSE '-Volumes-disk-projects-app-' || user_id % 4 END""")
    roots = r"^-(?:Users-[^-]+-(?:Dev|Documents)|Volumes-[^-]+-(?:data-)?projects)-"
    e = t.events.select("event_id", tx.project_of_path(path, roots).alias("project"))
    aliases = t.values("project, new", "('tool-1', 'tools')", "('app-2', 'apps')")
    return e.join(F.broadcast(aliases), "project", "left").select("event_id", F.coalesce("new", "project").alias("project"))


@query("F25_format_gap", """SELECT event_id, CASE WHEN g / 60 < 90 THEN CAST(CAST(round_even(g / 60, 0) AS BIGINT) AS VARCHAR) || 'm' WHEN g / 3600 < 48 THEN printf('%.1f', g / 3600) || 'h' ELSE printf('%.1f', g / 86400) || 'd' END AS gap
    FROM (SELECT event_id, (event_id * 137 % 900000)::DOUBLE AS g FROM events)""")
def _f25(t: Tables):
    return t.events.select("event_id", tx.format_gap((F.col("event_id") * 137 % 900000).cast("double")).alias("gap"))


_CLIENT = "CASE event_id % 6 WHEN 0 THEN 'Cursor Editor' WHEN 1 THEN 'codex-mcp-client' WHEN 2 THEN ' ' WHEN 3 THEN 'My Tool ' || user_id WHEN 4 THEN 'Cline' ELSE '***' END"


@query("F26_client_slug", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'cursor' WHEN 1 THEN 'codex' WHEN 2 THEN 'unknown_mcp_client' WHEN 3 THEN 'my_tool_' || user_id WHEN 4 THEN 'cline' ELSE 'unknown_mcp_client' END AS slug FROM events")
def _f26(t: Tables):
    return t.events.select("event_id", tx.client_slug(F.expr(_CLIENT)).alias("slug"))


@query("F27_target_path", "SELECT doc_id, 'WIKI/projects/' || CASE WHEN doc_id % 5 = 4 THEN 'untitled.md' ELSE path END AS target FROM f_docs")
def _f27(t: Tables):
    raw = F.expr("CASE doc_id % 5 WHEN 0 THEN path WHEN 1 THEN '/wiki/' || path WHEN 2 THEN 'Projects/WIKI/' || path || '/' WHEN 3 THEN ' projects//' || path ELSE 'wiki/projects/' END")
    return t.f_docs.select("doc_id", tx.target_path(raw).alias("target"))


@query("F28_removed_line_fraction", """WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line FROM documents WHERE text <> '')
    SELECT doc_id, round(count(*) FILTER (WHERE length(line) % 3 = 0) / count(*), 6) AS removed FROM l GROUP BY 1 UNION ALL SELECT doc_id, 0 FROM documents WHERE coalesce(text, '') = ''""")
def _f28(t: Tables):
    shorter = F.array_join(F.filter(F.split("text", "\n"), lambda x: F.length(x) % 3 != 0), "\n")
    r = rev.removed_line_fraction(t.documents.select("doc_id", F.col("text").alias("old"), shorter.alias("new")), "doc_id")
    return r.select("doc_id", F.round("removed", 6).alias("removed"))


@query("F28_moved_lines")
def _f28b(t: Tables):
    """The first third of the lines moved to the end, in reverse."""
    lines, n = F.split("text", "\n"), F.floor(F.size(F.split("text", "\n")) / 3).cast("int")
    moved = F.array_join(F.concat(F.slice(lines, n + 1, F.size(lines)), F.reverse(F.slice(lines, F.lit(1), n))), "\n")
    return rev.removed_line_fraction(t.documents.select("doc_id", F.col("text").alias("old"), moved.alias("new")), "doc_id")


_NOISE = """CASE WHEN n = '' THEN 'empty' WHEN regexp_matches(n, {dim}) THEN '' WHEN regexp_matches(n, {quo}) THEN 'quoted'
    WHEN regexp_matches(n, {ext}) OR (NOT contains(n, ' ') AND slashes > 0 AND (regexp_matches(n, '^[/~.\\\\]') OR contains(n, '*') OR slashes >= 2)) THEN 'file_or_path'
    WHEN regexp_matches(n, {exc}) THEN 'exception' WHEN regexp_matches(n, {call}) THEN 'code_identifier'
    WHEN NOT contains(n, ' ') AND (regexp_matches(n, {con}) OR regexp_matches(n, {sna}) OR regexp_matches(n, {cam}) OR regexp_matches(n, {dot})) THEN 'code_identifier'
    WHEN regexp_matches(n, {loc}) THEN 'local_label' WHEN regexp_matches(n, {num}) THEN '' WHEN regexp_matches(n, {mea}) THEN 'number_or_measure' ELSE '' END""".format(
    dim=q(rules.DIMENSION_NAME), quo=q(rules.QUOTED_NAME), ext=q(rules.FILE_EXTENSION), exc=q(rules.EXCEPTION_NAME), call=q(rules.CALL_NAME), con=q(rules.CONSTANT_NAME),
    sna=q(rules.SNAKE_NAME), cam=q(rules.CAMEL_NAME), dot=q(rules.DOTTED_NAME), loc=q(rules.LOCAL_LABEL), num=q(rules.NUMBERED_NAME), mea=q(rules.NUMBER_SHAPE))
NOISE_SQL = f"(SELECT *, {_NOISE} AS noise FROM (SELECT *, trim(name, ' ') AS n, length(name) - length(regexp_replace(name, '[/\\\\]', '', 'g')) AS slashes FROM f_entity))"


@query("P7_noise_category", f"SELECT entity_id, noise FROM {NOISE_SQL}")
def _p7(t: Tables):
    return t.f_entity.select("entity_id", F.coalesce(tx.noise_category(F.col("name")), F.lit("")).alias("noise"))


@query("P11_sanitize_fulltext", """SELECT item_id, replace(replace(text, 'a', 'a_b'), ' the ', ' ＿ ') AS clean FROM benchmark""")
def _p11(t: Tables):
    raw = F.expr("replace(replace(text, 'a', 'a_b'), ' the ', ' _ ')")
    return t.benchmark.select("item_id", tx.sanitize_fulltext(raw).alias("clean"))

"""Evaluation queries: benchmark cases, gold from leaking documents, graded as of snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import evaluate as e, retrieve as r
from memlake.plans import p_retrieve as pr
from memlake.plans.registry import Tables, query
from memlake.session import cut_lineage

# Gold of a case: the documents that quote it; updates add the next document and retire some.
_GOLD = f"""{pr.LEAK}, gold AS (SELECT case_id, 'doc-' || doc_id AS name FROM leak),
    upd AS (SELECT case_id, CAST(doc_id % 2 AS INTEGER) AS update_no, TIMESTAMP '2024-01-01 08:00:00' + (doc_id % 2) * INTERVAL 6 HOUR AS from_at, 'add' AS op, 'doc-' || (doc_id + 1) AS name FROM leak WHERE doc_id % 3 = 0
            UNION ALL SELECT case_id, 1, TIMESTAMP '2024-01-01 14:00:00', 'retire', 'doc-' || doc_id FROM leak WHERE doc_id % 6 = 0),
    ops AS (SELECT case_id, name, -1 AS update_no, 'add' AS op, NULL::TIMESTAMP AS from_at FROM gold UNION ALL SELECT case_id, name, update_no, op, from_at FROM upd),
    eg AS (SELECT snapshot, case_id, name FROM (SELECT snapshot, case_id, name, max_by(op, (update_no, CASE WHEN op = 'retire' THEN 1 ELSE 0 END)) AS op FROM ops, f_snapshot WHERE from_at IS NULL OR from_at <= as_of GROUP BY 1, 2, 3) WHERE op = 'add')"""


def gold(t: Tables):
    """Small and read several times by the grading plan: written once."""
    return cut_lineage(pr._r11(t)).select("case_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), "doc_id")


def effective(t: Tables):
    g = gold(t)
    adds = g.where("doc_id % 3 = 0").selectExpr("case_id", "CAST(doc_id % 2 AS INT) AS update_no", "TIMESTAMP_NTZ '2024-01-01 08:00:00' + CAST(doc_id % 2 AS INT) * INTERVAL '6' HOUR AS from_at", "'add' AS op", "'doc-' || (doc_id + 1) AS name")
    drops = g.where("doc_id % 6 = 0").selectExpr("case_id", "1 AS update_no", "TIMESTAMP_NTZ '2024-01-01 14:00:00' AS from_at", "'retire' AS op", "name")
    return e.effective_gold(g.select("case_id", "name"), adds.union(drops), t.f_snapshot)


@query("U5_effective_gold", f"WITH {_GOLD} SELECT snapshot, case_id, name FROM eg")
def _u5(t: Tables):
    return effective(t)


# Results: the BM25 pool under three policies, asked at every snapshot.
_RES = f"""{_GOLD}, {pr.BM}, pol AS (SELECT * FROM (VALUES ('wide', 12, 0.0), ('narrow', 3, 0.0), ('strict', 12, 6.0)) x(policy, k, min_score)),
    res AS (SELECT snapshot, policy, query_id AS case_id, rank, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'doc-' || doc_id END AS name, CASE WHEN doc_id % 9 = 0 THEN observed_at END AS invalid_at FROM bm, pol, f_snapshot WHERE rank <= k AND score >= min_score),
    pa AS (SELECT 'doc-' || doc_id AS name, observed_at AS promoted_at FROM f_docs),
    per AS (SELECT r.snapshot, policy, r.case_id, min(CASE WHEN g.name IS NOT NULL THEN rank END) AS gold_rank, count(*) FILTER (WHERE promoted_at > as_of) AS leaks, count(r.name) / count(*) AS provenance_rate, count(invalid_at) AS superseded, count(*) AS results
            FROM res r JOIN f_snapshot s ON s.snapshot = r.snapshot LEFT JOIN pa ON pa.name = r.name LEFT JOIN eg g ON g.snapshot = r.snapshot AND g.case_id = r.case_id AND g.name = r.name GROUP BY 1, 2, 3),
    av AS (SELECT g.snapshot, case_id, bool_or(coalesce(promoted_at <= as_of, false)) AS available FROM eg g JOIN f_snapshot s ON s.snapshot = g.snapshot LEFT JOIN pa ON pa.name = g.name GROUP BY 1, 2),
    gr AS (SELECT a.snapshot, a.policy, c.item_id AS case_id, gold_rank, coalesce(available, false) AS gold_available, CASE WHEN available IS NOT NULL AND NOT available THEN gold_rank IS NULL END AS abstained_correctly, coalesce(leaks, 0) AS leaks,
             coalesce(provenance_rate, 1.0) AS provenance_rate, coalesce(superseded, 0) AS superseded, coalesce(results, 0) AS results
           FROM benchmark c, (SELECT DISTINCT snapshot, policy FROM res) a LEFT JOIN per ON per.snapshot = a.snapshot AND per.policy = a.policy AND per.case_id = c.item_id LEFT JOIN av ON av.snapshot = a.snapshot AND av.case_id = c.item_id)"""


def results(t: Tables):
    hits = cut_lineage(r.bm25_search(t.f_query, pr.docs(t), 12))
    policies = t.values("policy, k, min_score", "('wide', 12, 0.0D)", "('narrow', 3, 0.0D)", "('strict', 12, 6.0D)")
    x = e.apply_policies(hits, policies)
    snaps = t.f_snapshot.agg(F.sort_array(F.collect_list("snapshot"))).scalar()
    return x.select(
        F.explode(snaps).alias("snapshot"), "policy", F.col("query_id").alias("case_id"), "rank",
        F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("name"),
        F.when(F.col("doc_id") % 9 == 0, F.col("observed_at")).alias("invalid_at"))


def graded(t: Tables):
    at = t.f_docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.col("observed_at").alias("promoted_at"))
    return e.grade(t.benchmark.select(F.col("item_id").alias("case_id")), results(t), effective(t), at, t.f_snapshot)


@query("E1_grade_cases", f"WITH {_RES} SELECT snapshot, policy, case_id, CAST(coalesce(gold_rank, -1) AS INTEGER) AS gold_rank, gold_available, coalesce(CAST(abstained_correctly AS VARCHAR), '') AS abstained, leaks, round(provenance_rate, 6) AS provenance_rate, superseded, results FROM gr")
def _e1(t: Tables):
    g = graded(t)
    return g.select("snapshot", "policy", "case_id", F.coalesce("gold_rank", F.lit(-1)).alias("gold_rank"), "gold_available", F.coalesce(F.col("abstained_correctly").cast("string"), F.lit("")).alias("abstained"),
                    "leaks", F.round("provenance_rate", 6).alias("provenance_rate"), "superseded", "results")


_SUM = """SELECT snapshot, policy, count(*) AS cases, count(*) FILTER (WHERE gold_available) AS answerable, round(coalesce(count(*) FILTER (WHERE gold_available AND gold_rank <= 8) / nullif(count(*) FILTER (WHERE gold_available), 0), -1), 6) AS hit_at_k,
    round(coalesce(coalesce(sum(1.0::DOUBLE / gold_rank) FILTER (WHERE gold_available), 0) / nullif(count(*) FILTER (WHERE gold_available), 0), -1), 6) AS mrr, CAST(sum(leaks) AS BIGINT) AS leaks FROM gr GROUP BY 1, 2"""


def _summary(t: Tables):
    s = e.summarize(graded(t), 8)
    return s.select("snapshot", "policy", "cases", "answerable", *[F.round(F.coalesce(c, F.lit(-1.0)), 6).alias(c) for c in ("hit_at_k", "mrr")], "leaks")


@query("E2_summarize", f"WITH {_RES} {_SUM} HAVING policy = 'wide'")
def _e2(t: Tables):
    return _summary(t).where("policy = 'wide'")


@query("E3_policy_sweep", f"WITH {_RES} {_SUM}")
def _e3(t: Tables):
    return _summary(t)


@query("E4_judge_scores", """WITH x AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'doc' ELSE 'episode' END AS item_type, CASE WHEN quality = 1 AND toxic = 0 THEN 'approve' WHEN toxic = 1 THEN 'reject' ELSE 'flag' END AS final,
      CASE doc_id % 5 WHEN 0 THEN 'reject' WHEN 1 THEN 'flag' WHEN 2 THEN NULL ELSE 'approve' END AS judge FROM labels)
    SELECT coalesce(item_type, 'all') AS scope, count(*) AS n, round(count(*) FILTER (WHERE final IN ('approve', 'reject') AND judge = final) / greatest(count(*) FILTER (WHERE final IN ('approve', 'reject')), 1), 4) AS agree,
      count(*) FILTER (WHERE judge = 'approve' AND final <> 'approve') AS false_approve, count(*) FILTER (WHERE coalesce(judge <> 'approve', true) AND final = 'approve') AS missed, round(count(*) FILTER (WHERE judge = 'flag') / count(*), 4) AS flag_rate,
      round(count(*) FILTER (WHERE coalesce(judge = 'approve', false) = (final = 'approve')) / count(*), 4) AS binary_agree, count(*) FILTER (WHERE judge IS NULL) AS no_answer FROM x GROUP BY GROUPING SETS ((), (item_type))""")
def _e4(t: Tables):
    rows = t.labels.selectExpr("CASE WHEN doc_id % 3 = 0 THEN 'doc' ELSE 'episode' END AS item_type", "CASE WHEN quality = 1 AND toxic = 0 THEN 'approve' WHEN toxic = 1 THEN 'reject' ELSE 'flag' END AS final",
                               "CASE doc_id % 5 WHEN 0 THEN 'reject' WHEN 1 THEN 'flag' WHEN 2 THEN NULL ELSE 'approve' END AS judge")
    return e.judge_scores(rows)


@query("E5_inference_metrics", f"""WITH {pr._INF}, x AS (SELECT project AS guess, CASE WHEN query_id % 7 <> 0 THEN gold END AS gold FROM inf)
    SELECT count(gold) AS labeled, count(*) FILTER (WHERE gold IS NOT NULL AND guess IS NOT NULL) AS guessed, round(1 - count(*) FILTER (WHERE guess <> gold) / count(*) FILTER (WHERE gold IS NOT NULL AND guess IS NOT NULL), 6) AS accuracy_when_guessed,
      round(count(*) FILTER (WHERE guess IS NULL) / count(*), 6) AS abstain_rate, round(count(*) FILTER (WHERE guess <> gold) / count(gold), 6) AS confident_wrong_rate, round((count(*) FILTER (WHERE guess <> gold) + count(*) FILTER (WHERE gold IS NULL AND guess IS NOT NULL)) / count(*), 6) AS conservative_wrong_rate FROM x""")
def _e5(t: Tables):
    v = pr.vec_queries(t).select("query_id", F.when(F.col("query_id") % 7 != 0, F.col("project")).alias("gold"))
    g = pr.inferred(t).select("query_id", F.col("project").alias("guess")).join(v, "query_id")
    m = e.inference_metrics(g)
    return m.select("labeled", "guessed", *[F.round(c, 6).alias(c) for c in ("accuracy_when_guessed", "abstain_rate", "confident_wrong_rate", "conservative_wrong_rate")])


@query("E6_uncertain_paths", """WITH c AS (SELECT o_orderkey AS commit_id, o_orderdate AS at_, CASE WHEN o_orderkey % 2 = 0 THEN 'Auto-sync x' ELSE 'edit' END AS subject FROM orders),
    n AS (SELECT * FROM c WHERE at_ > TIMESTAMP '1998-05-05 23:58:00' ORDER BY at_, commit_id LIMIT 1) SELECT DISTINCT n.commit_id, 'p' || l_partkey AS path FROM n JOIN lineitem ON l_orderkey = n.commit_id
    WHERE NOT (starts_with(subject, 'Auto-sync') AND epoch(at_) - epoch(TIMESTAMP '1998-05-05 23:58:00') > 300)""")
def _e6(t: Tables):
    c = t.orders.selectExpr("o_orderkey AS commit_id", "o_orderdate AS at", "CASE WHEN o_orderkey % 2 = 0 THEN 'Auto-sync x' ELSE 'edit' END AS subject")
    ch = t.lineitem.selectExpr("l_orderkey AS commit_id", "'p' || l_partkey AS path")
    return e.uncertain_paths(c, ch, F.lit("1998-05-05 23:58:00").cast("timestamp_ntz"))


@query("E7_compare_runs", """WITH w AS (SELECT memory_id, conversation_id, v, list_distinct(regexp_extract_all(lower(s), '[a-z0-9]+')) AS w FROM (SELECT *, CASE WHEN v = 1 THEN statement || ' about ' || harness ELSE statement END AS s FROM f_memory)),
    p AS (SELECT n.memory_id AS new_id, o.memory_id AS old_id, round(2 * len(list_intersect(n.w, o.w)) / (len(n.w) + len(o.w)), 6) AS similarity FROM w n JOIN w o ON o.conversation_id = n.conversation_id AND o.v = 0 WHERE n.v = 1)
    SELECT new_id, old_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY similarity DESC, old_id) AS rn FROM p WHERE similarity >= 0.6) WHERE rn = 1""")
def _e7(t: Tables):
    m = t.f_memory.select("memory_id", "conversation_id", "v", F.expr("CASE WHEN v = 1 THEN statement || ' about ' || harness ELSE statement END").alias("statement"))
    return e.compare_runs(m.where("v = 0"), m.where("v = 1"))


_PICK = "SELECT case_id, gold_rank FROM gr WHERE snapshot = 'now' AND policy = '{}'"


@query("E8_rank_changes", f"""WITH {_RES}, a AS ({_PICK.format('wide')}), b AS ({_PICK.format('strict')})
    SELECT case_id, CAST(coalesce(a.gold_rank, 99) AS INTEGER) AS rank_before, CAST(coalesce(b.gold_rank, 99) AS INTEGER) AS rank_after, CASE WHEN coalesce(b.gold_rank, 99) < coalesce(a.gold_rank, 99) THEN 'improved' WHEN coalesce(b.gold_rank, 99) > coalesce(a.gold_rank, 99) THEN 'regressed' ELSE 'same' END AS change FROM a JOIN b USING (case_id)""")
def _e8(t: Tables):
    g = graded(t).where("snapshot = 'now'")
    return e.rank_changes(g.where("policy = 'wide'"), g.where("policy = 'strict'"))


@query("E9_rerank_ceiling", f"""WITH {_GOLD}, {pr.POOL}, op AS (SELECT case_id, project FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY c DESC, project) AS rn FROM (SELECT case_id, lang AS project, count(*) AS c FROM leak JOIN documents USING (doc_id) GROUP BY 1, 2)) WHERE rn = 1),
    bo AS (SELECT p.query_id, p.doc_id, row_number() OVER (PARTITION BY p.query_id ORDER BY coalesce(p.project = op.project, false) DESC, rank) AS place FROM pool p LEFT JOIN op ON op.case_id = p.query_id),
    ca AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY overflow, rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, project ORDER BY rank) > 4 AS overflow FROM pool)),
    al AS (SELECT 'baseline' AS arm, query_id, doc_id, rank AS place FROM pool UNION ALL SELECT 'boost', query_id, doc_id, place FROM bo UNION ALL SELECT 'cap', query_id, doc_id, place FROM ca),
    hr AS (SELECT arm, query_id, min(place) AS gr FROM al JOIN leak ON case_id = query_id AND leak.doc_id = al.doc_id WHERE place <= 8 GROUP BY 1, 2)
    SELECT arm, count(*) AS hits, round(sum(1.0::DOUBLE / gr) / (SELECT count(DISTINCT case_id) FROM leak), 6) AS mrr FROM hr GROUP BY 1""")
def _e9(t: Tables):
    g = gold(t)
    p = cut_lineage(pr.pool(t))
    op = e.oracle_projects(g.select("case_id", "name"), t.documents.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.col("lang").alias("project")))
    arms = p.where("rank <= 8").select(F.lit("baseline").alias("arm"), "query_id", "doc_id", F.col("rank").alias("place")).union(
        r.boost(p, op.withColumnRenamed("case_id", "query_id"), 8).select(F.lit("boost"), "query_id", "doc_id", "place")).union(
        r.project_cap(p, 4, 8).select(F.lit("cap"), "query_id", "doc_id", "place"))
    first = arms.join(g.select(F.col("case_id").alias("query_id"), "doc_id"), ["query_id", "doc_id"]).groupBy("arm", "query_id").agg(F.min("place").alias("gr"))
    n = g.agg(F.count_distinct("case_id")).scalar()
    return first.groupBy("arm").agg(F.count(F.lit(1)).alias("hits"), F.sum(1.0 / F.col("gr")).alias("s")).select("arm", "hits", F.round(F.col("s") / n, 6).alias("mrr"))


@query("E10_remap_gold", f"WITH {_GOLD}, m AS (SELECT 'doc-' || doc_id AS member, 'roll-' || doc_id // 10 AS rollup FROM documents WHERE doc_id % 2 = 0) SELECT DISTINCT case_id, coalesce(rollup, name) AS name FROM gold LEFT JOIN m ON member = name")
def _e10(t: Tables):
    m = t.documents.where("doc_id % 2 = 0").selectExpr("'doc-' || doc_id AS member", "'roll-' || doc_id DIV 10 AS rollup")
    return e.remap_gold(gold(t).select("case_id", "name"), m)


@query("E11_expansion_gain", f"""WITH {pr._EXP}, gl AS (SELECT DISTINCT o_custkey % 40 AS case_id, l_suppkey AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 7 AND l_quantity > 47), cs AS (SELECT DISTINCT o_custkey % 40 AS case_id FROM orders),
    di AS (SELECT DISTINCT query_id AS case_id, note_id AS name FROM sd JOIN f_note_mention ON entity_id = episode_id % 1000), ex AS (SELECT query_id AS case_id, note_id AS name FROM nxr WHERE rank <= 3),
    h AS (SELECT case_id, (case_id IN (SELECT case_id FROM gl SEMI JOIN di USING (case_id, name))) AS d, (case_id IN (SELECT case_id FROM gl SEMI JOIN (SELECT * FROM di UNION ALL SELECT * FROM ex) z USING (case_id, name))) AS e FROM cs)
    SELECT case_id, d AS direct_hit, e AS expanded_hit, e AND NOT d AS recovered FROM h""")
def _e11(t: Tables):
    o = t.orders.select("o_orderkey", (F.col("o_custkey") % 40).alias("case_id"))
    g = t.lineitem.where("l_linenumber = 7 AND l_quantity > 47").select("l_orderkey", F.col("l_suppkey").alias("name")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("case_id", "name").distinct()
    direct = pr.seeds(t).select(F.col("query_id").alias("case_id"), (F.col("item_id") % 1000).alias("entity_id")).join(t.f_note_mention, "entity_id").select("case_id", F.col("note_id").alias("name"))
    expanded = pr.note_expansion(t).select(F.col("query_id").alias("case_id"), F.col("item_id").alias("name"))
    return e.expansion_gain(o.select("case_id").distinct(), g, direct, expanded)

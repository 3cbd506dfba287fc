"""Temporal graph queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from memlake.functions import rules, text as tx
from memlake.operators import graph as g
from memlake.plans.p_functions import NOISE_SQL
from memlake.plans.registry import Tables, query
from memlake.plans.sqltext import q, words
from memlake.session import cut_lineage

NL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' ')"


@query("G1_active_facts", "SELECT fact_id, source_id, target_id, valid_at FROM f_fact WHERE invalid_at IS NULL")
def _g1(t: Tables):
    return g.active_facts(t.f_fact).select("fact_id", "source_id", "target_id", "valid_at")


@query("G1_superseded_facts", "SELECT fact_id, valid_at, invalid_at FROM f_fact WHERE invalid_at IS NOT NULL")
def _g1b(t: Tables):
    return g.superseded_facts(t.f_fact).select("fact_id", "valid_at", "invalid_at")


@query("G1_facts_of_entity", "SELECT fact_id, source_id, target_id FROM f_fact WHERE source_id IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2') OR target_id IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2')")
def _g1c(t: Tables):
    ids = t.part.where("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("entity_id"))
    return g.facts_of(t.f_fact, ids).select("fact_id", "source_id", "target_id")


@query("G2_orphan_entities", "SELECT entity_id FROM f_entity WHERE entity_id NOT IN (SELECT entity_id FROM f_mention) AND entity_id NOT IN (SELECT source_id FROM f_fact) AND entity_id NOT IN (SELECT target_id FROM f_fact)")
def _g2(t: Tables):
    return g.orphans(t.f_entity, t.f_mention, t.f_fact).select("entity_id")


@query("G2_silent_episodes", "SELECT episode_id FROM f_episode WHERE episode_id NOT IN (SELECT episode_id FROM f_mention)")
def _g2b(t: Tables):
    return g.silent_episodes(t.f_episode, t.f_mention).select("episode_id")


_DUP = f"""n AS (SELECT *, {NL.format('name')} AS norm FROM f_entity),
    c AS (SELECT norm, min_by(entity_id, (CASE WHEN origin = 'wiki' THEN 0 ELSE 1 END, created_at, entity_id)) AS canonical_id, count(*) AS size FROM n GROUP BY 1 HAVING count(*) > 1),
    dg AS (SELECT entity_id, norm, canonical_id, size FROM n JOIN c USING (norm))"""


@query("G3_duplicate_groups", f"WITH {_DUP} SELECT * FROM dg")
def _g3(t: Tables):
    return g.duplicate_groups(t.f_entity)


@query("G4_merge_mentions", f"WITH {_DUP} SELECT DISTINCT episode_id, coalesce(canonical_id, m.entity_id) AS entity_id FROM f_mention m LEFT JOIN dg ON dg.entity_id = m.entity_id")
def _g4(t: Tables):
    return g.merge_entities(g.duplicate_groups(t.f_entity), t.f_mention, t.f_fact)[0]


@query("G4_merge_facts", f"""WITH {_DUP} SELECT fact_id, coalesce(a.canonical_id, source_id) AS source_id, coalesce(b.canonical_id, target_id) AS target_id,
      coalesce(a.canonical_id, source_id) = coalesce(b.canonical_id, target_id) AND (coalesce(a.canonical_id, source_id) <> source_id OR coalesce(b.canonical_id, target_id) <> target_id) AS self_loop
    FROM f_fact LEFT JOIN dg a ON a.entity_id = source_id LEFT JOIN dg b ON b.entity_id = target_id""")
def _g4b(t: Tables):
    return g.merge_entities(g.duplicate_groups(t.f_entity), t.f_mention, t.f_fact)[1].select("fact_id", "source_id", "target_id", "self_loop")


@query("G4_merged_aliases", f"""WITH {_DUP}, x AS (SELECT DISTINCT canonical_id, k.name AS kept_name, e.name FROM dg JOIN f_entity e ON e.entity_id = dg.entity_id JOIN f_entity k ON k.entity_id = canonical_id WHERE e.name <> k.name)
    SELECT canonical_id, kept_name, string_agg(name, '|' ORDER BY name) AS aliases FROM x GROUP BY 1, 2""")
def _g4c(t: Tables):
    return g.merged_aliases(g.duplicate_groups(t.f_entity), t.f_entity).withColumn("aliases", F.array_join("aliases", "|"))


def _doc_pairs(t: Tables):
    d = t.documents.select("doc_id", F.md5("text").alias("h"))
    hub = d.groupBy("h").agg(F.min("doc_id").alias("a"))
    stars = d.join(hub, "h").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    ids = t.documents.select("doc_id")
    chain = ids.where("doc_id % 17 = 0").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")).join(ids.select(F.col("doc_id").alias("b")), "b", "left_semi")
    return stars.union(chain.select("a", "b"))


@query("G6_connected_components", """WITH p AS (SELECT min(doc_id) OVER (PARTITION BY md5(text)) AS a, doc_id AS b FROM documents UNION ALL SELECT doc_id, doc_id + 1 FROM documents WHERE doc_id % 17 = 0 AND doc_id + 1 IN (SELECT doc_id FROM documents)),
    e AS (SELECT a, b FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b), r AS (SELECT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen)
    SELECT id, min(seen) AS component FROM r GROUP BY 1""")
def _g6(t: Tables):
    return g.connected_components(_doc_pairs(t))


_DEG = """dgr AS (SELECT e.*, coalesce(a.c, 0) AS episodes, coalesce(n.c, 0) AS notes, coalesce(r.c, 0) AS relates FROM f_entity e LEFT JOIN (SELECT entity_id, count(*) AS c FROM f_mention GROUP BY 1) a USING (entity_id)
    LEFT JOIN (SELECT entity_id, count(*) AS c FROM f_note_mention GROUP BY 1) n USING (entity_id) LEFT JOIN (SELECT entity_id, count(*) AS c FROM (SELECT source_id AS entity_id FROM f_fact UNION ALL SELECT target_id FROM f_fact) GROUP BY 1) r USING (entity_id))"""


def _deg(t: Tables):
    return g.degrees(t.f_entity, t.f_mention, t.f_note_mention, t.f_fact)


@query("G7_canonical_pick", f"WITH {_DEG} SELECT {NL.format('name')} AS group_id, max_by(entity_id, (relates > 0, episodes + notes + relates, -entity_id)) AS canonical_id FROM dgr GROUP BY 1")
def _g7(t: Tables):
    return g.canonical_pick(_deg(t).withColumn("group_id", g.norm_label(F.col("name"))))


_FOLD = "SELECT o_orderkey AS duplicate_id, o_orderkey - 1 AS keep_id FROM orders WHERE o_orderkey % 10 = 3"


def _fold(t: Tables):
    m = t.orders.where("o_orderkey % 10 = 3").selectExpr("o_orderkey AS duplicate_id", "o_orderkey - 1 AS keep_id")
    return g.fold_episodes(m, t.f_mention, t.f_fact_episode)


@query("G8_fold_mentions", f"WITH m AS ({_FOLD}) SELECT DISTINCT coalesce(keep_id, episode_id) AS episode_id, entity_id FROM f_mention LEFT JOIN m ON duplicate_id = episode_id")
def _g8(t: Tables):
    return _fold(t)[0]


@query("G8_fold_fact_episodes", f"WITH m AS ({_FOLD}) SELECT DISTINCT coalesce(keep_id, episode_id) AS episode_id, fact_id FROM f_fact_episode LEFT JOIN m ON duplicate_id = episode_id")
def _g8b(t: Tables):
    return _fold(t)[1]


_RET = """gone AS (SELECT o_orderkey AS episode_id FROM orders WHERE o_orderkey % 5 = 1),
    lft AS (SELECT * FROM f_fact_episode WHERE episode_id NOT IN (SELECT episode_id FROM gone)), tch AS (SELECT DISTINCT fact_id FROM f_fact_episode WHERE episode_id IN (SELECT episode_id FROM gone))"""


def _ret(t: Tables):
    return g.retract(t.orders.where("o_orderkey % 5 = 1").select(F.col("o_orderkey").alias("episode_id")), t.f_mention, t.f_fact, t.f_fact_episode)


@query("G9_retract_facts", f"WITH {_RET} SELECT fact_id, CASE WHEN fact_id IN (SELECT fact_id FROM lft) THEN 'detached' ELSE 'deleted' END AS effect FROM tch")
def _g9(t: Tables):
    r = _ret(t)
    return r["deleted_facts"].withColumn("effect", F.lit("deleted")).union(r["detached_facts"].withColumn("effect", F.lit("detached")))


@query("G9_retract_orphans", f"""WITH {_RET}, m AS (SELECT * FROM f_mention), keep AS (SELECT * FROM f_fact WHERE fact_id IN (SELECT fact_id FROM lft))
    SELECT DISTINCT entity_id FROM m WHERE episode_id IN (SELECT episode_id FROM gone) AND entity_id NOT IN (SELECT entity_id FROM m WHERE episode_id NOT IN (SELECT episode_id FROM gone))
      AND entity_id NOT IN (SELECT source_id FROM keep) AND entity_id NOT IN (SELECT target_id FROM keep)""")
def _g9b(t: Tables):
    gone = t.orders.where("o_orderkey % 5 = 1").select(F.col("o_orderkey").alias("episode_id"))
    return g.retract(gone, t.f_mention, t.f_fact, t.f_fact_episode)["orphaned_entities"]


_SNAP = "1999-06-01 00:00:00"
_SNAPSQL = f"""pm AS (SELECT memory_id, min(promoted_at) AS p FROM f_episode_promotion WHERE status = 'succeeded' AND graph_name = 'main' GROUP BY 1),
    av AS (SELECT e.*, coalesce(p, created_at) AS available_at FROM f_episode e LEFT JOIN pm ON pm.memory_id = 'm' || episode_id), late AS (SELECT episode_id FROM av WHERE available_at > TIMESTAMP '{_SNAP}'),
    kf AS (SELECT f.* FROM f_fact f WHERE fact_id IN (SELECT fact_id FROM f_fact_episode WHERE episode_id NOT IN (SELECT episode_id FROM late))),
    km AS (SELECT episode_id, entity_id FROM f_mention WHERE episode_id NOT IN (SELECT episode_id FROM late)),
    tl AS (SELECT max(episode_id) AS episode_id, created_at FROM f_episode GROUP BY created_at),
    cs AS (SELECT k.fact_id, tl.episode_id FROM kf k ASOF JOIN tl ON k.invalid_at >= tl.created_at WHERE k.invalid_at IS NOT NULL)"""


def _available(t: Tables):
    return g.availability(t.f_episode, t.f_episode_promotion, ["main"])


def _snap(t: Tables):
    return g.snapshot(_available(t), t.f_mention, t.f_fact, t.f_fact_episode, F.lit(_SNAP).cast("timestamp_ntz"))


@query("G10_availability", f"WITH {_SNAPSQL} SELECT episode_id, available_at, available_at <> created_at AS promoted FROM av")
def _g10a(t: Tables):
    return _available(t).select("episode_id", "available_at", (F.col("available_at") != F.col("created_at")).alias("promoted"))


@query("G10_snapshot_facts", f"""WITH {_SNAPSQL} SELECT fact_id, coalesce(fact_id IN (SELECT fact_id FROM cs WHERE episode_id IN (SELECT episode_id FROM late)), false) AS restored,
    CASE WHEN fact_id IN (SELECT fact_id FROM cs WHERE episode_id IN (SELECT episode_id FROM late)) THEN NULL ELSE invalid_at END AS invalid_at FROM kf""")
def _g10(t: Tables):
    return _snap(t)["facts"].select("fact_id", "restored", "invalid_at")


@query("G10_snapshot_mentions", f"WITH {_SNAPSQL} SELECT episode_id, entity_id FROM km")
def _g10b(t: Tables):
    return _snap(t)["mentions"].select("episode_id", "entity_id")


# Notes hold names, too: some that no episode or fact holds.
_HELD = """nm AS (SELECT note_id, entity_id FROM f_note_mention UNION ALL SELECT s_suppkey AS note_id, 20000000 + s_suppkey // 2 AS entity_id FROM supplier)"""


@query("G10_pruned_notes", f"""WITH {_SNAPSQL}, {_HELD}, st AS (SELECT note_id FROM f_dated_note WHERE created_at > TIMESTAMP '{_SNAP}')
    SELECT 'note' AS kind, note_id AS id FROM st UNION ALL SELECT DISTINCT 'entity', entity_id FROM nm WHERE note_id IN (SELECT note_id FROM st) AND entity_id NOT IN (SELECT entity_id FROM nm WHERE note_id NOT IN (SELECT note_id FROM st))
      AND entity_id NOT IN (SELECT entity_id FROM km) AND entity_id NOT IN (SELECT source_id FROM kf) AND entity_id NOT IN (SELECT target_id FROM kf)""")
def _g10c(t: Tables):
    held = t.f_note_mention.union(t.supplier.selectExpr("s_suppkey AS note_id", "20000000 + s_suppkey DIV 2 AS entity_id"))
    s = g.snapshot(_available(t), t.f_mention, t.f_fact, t.f_fact_episode, F.lit(_SNAP).cast("timestamp_ntz"), t.f_dated_note, held)
    return s["removed_notes"].select(F.lit("note").alias("kind"), F.col("note_id").alias("id")).union(s["removed_entities"].select(F.lit("entity"), "entity_id"))


@query("J10_newest_at_expiry", """WITH tl AS (SELECT created_at, max(episode_id) AS episode_id FROM f_episode GROUP BY 1) SELECT f.fact_id, f.invalid_at AS at_, coalesce(tl.episode_id, -1) AS episode_id
    FROM (SELECT * FROM f_fact WHERE invalid_at IS NOT NULL) f ASOF LEFT JOIN tl ON f.invalid_at >= tl.created_at""")
def _j10(t: Tables):
    ended = t.f_fact.where("invalid_at IS NOT NULL").select(F.lit(1).alias("k"), F.col("invalid_at").alias("at"), "fact_id")
    line = t.f_episode.select(F.lit(1).alias("k"), F.col("created_at").alias("at"), "episode_id")
    return g.newest_at(ended, line, ["k"], "at", "episode_id").select("fact_id", F.col("at").alias("at_"), F.coalesce("episode_id", F.lit(-1)).alias("episode_id"))


_DF = f"df AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(string_split({NL.format('text')}, ' '))) AS word FROM documents) WHERE word <> '' GROUP BY 1)"


@query("A23_document_frequency", f"WITH {_DF} SELECT word, df FROM df")
def _a23(t: Tables):
    return g.document_frequency(t.documents)


_IDF = f"""{_DF}, nm AS (SELECT DISTINCT {NL.format('name')} AS norm FROM nsrc), w AS (SELECT norm, unnest(string_split(norm, ' ')) AS word FROM nm),
    idf AS (SELECT norm, ln(((SELECT count(*) FROM documents) + 1) / (min(coalesce(df, 0)) + 1)) AS idf FROM w LEFT JOIN df USING (word) GROUP BY 1)"""


@query("F20_phrase_idf", f"WITH nsrc AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:2], ' ') AS name FROM benchmark), {_IDF} SELECT item_id, round(idf, 6) AS idf FROM nsrc JOIN idf ON norm = {NL.format('name')}")
def _f20(t: Tables):
    names = t.benchmark.select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("name"))
    n = t.documents.agg(F.count(F.lit(1)).alias("n"))
    return g.phrase_idf(names, "item_id", "name", g.document_frequency(t.documents), n).select("item_id", F.round("idf", 6).alias("idf"))


_RARE = "SELECT entity_id, CASE entity_id % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'of the' ELSE name END AS name FROM f_entity"


@query("G11_retention_sweep", f"""WITH nsrc AS ({_RARE}), {_IDF}, m AS (SELECT entity_id, count(*) AS c FROM f_mention GROUP BY 1)
    SELECT entity_id, coalesce(c, 0) AS mentions, CASE WHEN coalesce(c, 0) >= 2 THEN 'recurring' WHEN idf > 2.0 THEN 'vouched' ELSE 'candidate' END AS status FROM nsrc JOIN idf ON norm = {NL.format('name')} LEFT JOIN m USING (entity_id)""")
def _g11(t: Tables):
    ent = t.f_entity.selectExpr("entity_id", "CASE entity_id % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'of the' ELSE name END AS name")
    idf = g.phrase_idf(ent, "entity_id", "name", g.document_frequency(t.documents), t.documents.agg(F.count(F.lit(1)).alias("n")))
    return g.retention_sweep(ent, t.f_mention, idf)


@query("G12_anchor_valid_at", """SELECT fact_id, CASE WHEN valid_at = date_trunc('day', valid_at) AND CAST(valid_at AS DATE) = CAST(ref AS DATE) AND valid_at < ref THEN ref ELSE valid_at END AS valid_at
    FROM (SELECT *, valid_at + (source_id % 40) * INTERVAL 1 HOUR AS ref FROM f_fact)""")
def _g12(t: Tables):
    f = t.f_fact.withColumn("ref", F.expr("valid_at + CAST(source_id % 40 AS INT) * INTERVAL '1' HOUR"))
    return g.anchor_valid_at(f, F.col("ref")).select("fact_id", "valid_at")


_EDITS = "SELECT DISTINCT fact AS fact_text, 'edit-' || fact AS edit_id, TIMESTAMP '2000-01-01' AS at_ FROM f_fact WHERE source_id % 7 = 1"
_HITS = f"ed AS ({_EDITS}), h AS (SELECT edit_id, at_, fact_id, valid_at, count(*) OVER (PARTITION BY edit_id) AS n FROM ed JOIN f_fact ON lower(trim(fact)) = lower(trim(fact_text)) WHERE invalid_at IS NULL)"


def _edits(t: Tables):
    f = t.f_fact.where("source_id % 7 = 1").select(F.upper("fact").alias("fact_text"), F.concat(F.lit("edit-"), "fact").alias("edit_id")).distinct()
    return g.supersede_by_text(f.withColumn("at", F.lit("2000-01-01").cast("timestamp_ntz")), t.f_fact)


@query("G13_supersede_by_text", f"WITH {_HITS} SELECT edit_id, fact_id, valid_at, greatest(at_, valid_at) AS invalid_at FROM h WHERE n = 1")
def _g13(t: Tables):
    return _edits(t)[0]


@query("G13_ambiguous_candidates", f"WITH {_HITS} SELECT edit_id, fact_id, n FROM h WHERE n > 1")
def _g13b(t: Tables):
    return _edits(t)[1]


_NEW = "SELECT o_orderkey AS edge_id, upper(p_name) || ' ' || p_partkey % 40 AS source_name, 'Customer ' || o_custkey AS target_name FROM orders JOIN part ON p_partkey = o_custkey"


@query("G14_resolve_endpoints", f"""WITH e AS ({_NEW}), k AS (SELECT lower(trim(name)) AS key, CAST(min(entity_id) AS VARCHAR) AS id FROM f_entity GROUP BY 1),
    a AS (SELECT edge_id, lower(trim(source_name)) AS s, lower(trim(target_name)) AS t FROM e)
    SELECT edge_id, coalesce(x.id, 'new:' || sha1(s)) AS source_id, coalesce(y.id, 'new:' || sha1(t)) AS target_id FROM a LEFT JOIN k x ON x.key = s LEFT JOIN k y ON y.key = t""")
def _g14(t: Tables):
    e = t.orders.select("o_orderkey", "o_custkey").join(t.part.select("p_partkey", "p_name"), F.col("p_partkey") == F.col("o_custkey"))
    e = e.selectExpr("o_orderkey AS edge_id", "upper(p_name) || ' ' || p_partkey % 40 AS source_name", "'Customer ' || o_custkey AS target_name")
    return g.resolve_endpoints(e, t.f_entity)[0]


@query("G15_repath_notes", """WITH n AS (SELECT path FROM f_docs WHERE doc_id % 2 = 0), f AS (SELECT CASE WHEN doc_id % 6 = 0 THEN 'moved/' || filename ELSE path END AS path, filename AS base FROM f_docs WHERE doc_id % 4 <> 2 UNION ALL SELECT 'copy/' || filename, filename FROM f_docs WHERE doc_id % 24 = 0),
    m AS (SELECT path, regexp_extract(path, '([^/]+)$', 1) AS base FROM n WHERE path NOT IN (SELECT path FROM f)), b AS (SELECT base, count(*) AS c, min(path) AS found FROM f GROUP BY 1)
    SELECT path, CASE WHEN c IS NULL THEN 'no file with that name' WHEN c > 1 THEN 'ambiguous' WHEN found IN (SELECT path FROM n) THEN 'target already a note' ELSE 'moved' END AS outcome,
           coalesce(CASE WHEN c = 1 AND found NOT IN (SELECT path FROM n) THEN found END, '') AS new_path FROM m LEFT JOIN b USING (base)""")
def _g15(t: Tables):
    files = t.f_docs.where("doc_id % 4 <> 2").selectExpr("CASE WHEN doc_id % 6 = 0 THEN 'moved/' || filename ELSE path END AS path").union(
        t.f_docs.where("doc_id % 24 = 0").selectExpr("'copy/' || filename"))
    r = g.repath(t.f_docs.where("doc_id % 2 = 0").select("path"), files)
    return r.withColumn("new_path", F.coalesce("new_path", F.lit("")))


@query("G16_prune_debris", f"""WITH d AS (SELECT * FROM {NOISE_SQL} WHERE noise <> ''), ok AS (SELECT * FROM d WHERE NOT (noise = 'code_identifier' AND entity_type IN ('Software', 'AIModel') AND NOT (regexp_matches(n, {q(rules.CALL_NAME)}) OR (NOT contains(n, ' ') AND regexp_matches(n, {q(rules.CAMEL_NAME)})))))
    SELECT entity_id, noise FROM ok WHERE entity_id IN (SELECT entity_id FROM f_mention WHERE episode_id % 3 <> 0) AND entity_id NOT IN (SELECT entity_id FROM f_mention WHERE episode_id % 3 = 0) AND entity_id NOT IN (SELECT entity_id FROM f_note_mention)""")
def _g16(t: Tables):
    return g.prune_debris(t.f_entity, t.f_mention, t.f_note_mention, t.f_episode.where("episode_id % 3 <> 0").select("episode_id")).select("entity_id", "noise")


@query("G17_explain_memory", """SELECT 'm' || o_orderkey AS memory_id, o_orderkey % 4 <> 3 AS promoted, o_orderkey % 2 = 0 AS found, CASE WHEN o_orderkey % 2 = 0 THEN 'ep-' || o_orderkey ELSE '' END AS episode,
    CASE WHEN o_orderkey % 2 = 0 THEN coalesce(a.c, 0) ELSE 0 END AS entities, CASE WHEN o_orderkey % 2 = 0 THEN coalesce(b.c, 0) ELSE 0 END AS facts FROM orders
    LEFT JOIN (SELECT episode_id, count(*) AS c FROM f_mention GROUP BY 1) a ON a.episode_id = o_orderkey LEFT JOIN (SELECT episode_id, count(*) AS c FROM f_fact_episode GROUP BY 1) b ON b.episode_id = o_orderkey""")
def _g17(t: Tables):
    mem = t.orders.selectExpr("'m' || o_orderkey AS memory_id", "o_orderkey")
    prom = mem.where("o_orderkey % 4 <> 3").select("memory_id", F.lit("succeeded").alias("status"))
    return g.explain_memory(mem, prom, t.f_episode.where("episode_id % 2 = 0"), t.f_mention, t.f_fact_episode)


@query("G18_rebuild_from_ledger", """WITH p AS (SELECT p.memory_id, p.promoted_at, p.harness, p.project, m.memory_id IS NULL AS missing FROM f_promotion p LEFT JOIN f_memory m ON m.memory_id = p.memory_id WHERE p.status = 'succeeded')
    SELECT memory_id, missing, harness || '-' || coalesce(project, 'misc') || '-' || CASE WHEN rn < 1000 THEN lpad(CAST(rn AS VARCHAR), 3, '0') ELSE CAST(rn AS VARCHAR) END AS name FROM (SELECT *, row_number() OVER (PARTITION BY harness, project ORDER BY promoted_at, memory_id) AS rn FROM p)""")
def _g18(t: Tables):
    return g.rebuild_from_ledger(t.f_promotion, t.f_memory).select("memory_id", "missing", "name")


# --- joins and aggregates ---------------------------------------------------------------------


@query("J7_shared_entity_groups", "SELECT m.entity_id, episode_id, degree, hub_episode FROM f_mention m JOIN (SELECT entity_id, count(*) AS degree, min(episode_id) AS hub_episode FROM f_mention GROUP BY 1 HAVING count(*) > 1) d ON d.entity_id = m.entity_id")
def _j7(t: Tables):
    return g.shared_groups(t.f_mention).select("entity_id", "episode_id", "degree", "hub_episode")


@query("J7_related_episodes", """WITH s AS (SELECT episode_id FROM f_episode ORDER BY valid_at DESC, episode_id LIMIT 20) SELECT a.episode_id AS seed_id, b.episode_id, count(*) AS shared
    FROM f_mention a JOIN s ON s.episode_id = a.episode_id JOIN f_mention b ON b.entity_id = a.entity_id AND b.episode_id <> a.episode_id GROUP BY 1, 2""")
def _j7b(t: Tables):
    newest = t.f_episode.orderBy(F.desc("valid_at"), "episode_id").limit(20)
    return g.related_episodes(newest, t.f_mention)


@query("J8_neighbourhood", """WITH r AS (SELECT entity_id FROM f_entity WHERE contains(lower(name), 'bolt 7'))
    SELECT r.entity_id AS root_id, coalesce(fact_id, '') AS fact_id, coalesce(other_id, -1) AS other_id, coalesce(direction, '') AS direction FROM r LEFT JOIN (
      SELECT source_id AS root, fact_id, target_id AS other_id, 'out' AS direction FROM f_fact UNION ALL SELECT target_id, fact_id, source_id, 'in' FROM f_fact) ON root = r.entity_id""")
def _j8(t: Tables):
    n = g.neighbourhood(t.f_entity, t.f_fact, "bolt 7")
    return n.select("root_id", F.coalesce("fact_id", F.lit("")).alias("fact_id"), F.coalesce("other_id", F.lit(-1)).alias("other_id"), F.coalesce("direction", F.lit("")).alias("direction"))


@query("A9_inventory", """SELECT 'episode' AS label, count(*) AS n FROM f_episode UNION ALL SELECT 'entity', count(*) FROM f_entity UNION ALL SELECT 'mentions', count(*) FROM f_mention UNION ALL SELECT 'note', count(*) FROM f_note
    UNION ALL SELECT 'note_mentions', count(*) FROM f_note_mention UNION ALL SELECT 'relates_to', count(*) FROM f_fact""")
def _a9(t: Tables):
    return g.inventory(episode=t.f_episode, entity=t.f_entity, mentions=t.f_mention, note=t.f_note, note_mentions=t.f_note_mention, relates_to=t.f_fact)


@query("A10_mention_counts", "SELECT entity_id, coalesce(c, 0) AS mentions FROM f_entity LEFT JOIN (SELECT entity_id, count(*) AS c FROM f_mention GROUP BY 1) USING (entity_id)")
def _a10(t: Tables):
    return g.mention_counts(t.f_entity, t.f_mention)


@query("A10_entities_per_episode", "SELECT episode_id AS entity_id, coalesce(c, 0) AS mentions FROM f_episode LEFT JOIN (SELECT episode_id, count(*) AS c FROM f_mention GROUP BY 1) USING (episode_id)")
def _a10b(t: Tables):
    flip = t.f_mention.select(F.col("episode_id").alias("entity_id"), F.col("entity_id").alias("x"))
    return g.mention_counts(t.f_episode.select(F.col("episode_id").alias("entity_id")), flip)


@query("A11_duplicate_names", "SELECT lower(trim(name)) AS key, count(*) AS n, min(entity_id) AS first_id, max(entity_id) AS last_id FROM f_entity GROUP BY 1 HAVING count(*) > 1")
def _a11(t: Tables):
    return g.duplicate_keys(t.f_entity, F.lower(F.trim("name")), "entity_id")


@query("A11_duplicate_content", "SELECT md5(trim(text, ' ')) AS key, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def _a11b(t: Tables):
    return g.duplicate_keys(t.documents, F.md5(F.trim("text")), "doc_id")


@query("A12_contradictions", "SELECT source_id, target_id, count(*) AS active, min(valid_at) AS oldest, max(valid_at) AS newest FROM f_fact WHERE invalid_at IS NULL GROUP BY 1, 2 HAVING count(*) > 1")
def _a12(t: Tables):
    return g.contradictions(t.f_fact)


_PROJ = "(SELECT entity_id, string_agg(DISTINCT project, '|' ORDER BY project) AS projects, count(DISTINCT project) AS breadth FROM f_mention JOIN f_episode USING (episode_id) GROUP BY 1)"


@query("A13_cross_project", f"SELECT entity_id, projects, CAST(breadth AS INTEGER) AS breadth FROM {_PROJ} WHERE breadth >= 3 ORDER BY breadth DESC, entity_id")
def _a13(t: Tables):
    return g.cross_project(t.f_episode, t.f_mention, 3).withColumn("projects", F.array_join("projects", "|"))


@query("A19_entity_projects", f"SELECT entity_id, projects FROM {_PROJ}")
def _a19(t: Tables):
    return g.entity_projects(t.f_episode, t.f_mention).withColumn("projects", F.array_join("projects", "|"))


@query("A14_entity_quality", f"""WITH tot AS (SELECT entity_id, count(*) AS gm FROM f_mention GROUP BY 1), inf AS (SELECT entity_id, {NL.format('name')} AS norm, noise <> '' AS noisy, gm FROM {NOISE_SQL} JOIN tot USING (entity_id)),
    pe AS (SELECT project AS bucket, entity_id, count(*) AS c FROM f_mention JOIN f_episode USING (episode_id) GROUP BY ALL),
    en AS (SELECT bucket, count(*) AS entities, sum(c) AS uses, count(*) FILTER (WHERE gm = 1) AS single, count(*) FILTER (WHERE noisy) AS noisy, count(DISTINCT CASE WHEN norm IN ('small ring 0', 'red widget 1', 'no such') THEN norm END) AS gold_found FROM pe JOIN inf USING (entity_id) GROUP BY 1),
    ep AS (SELECT project AS bucket, count(*) AS episodes, count(*) FILTER (WHERE m IS NULL) AS empty, sum(coalesce(f, 0)) AS facts FROM f_episode LEFT JOIN (SELECT episode_id, count(*) AS m FROM f_mention GROUP BY 1) USING (episode_id) LEFT JOIN (SELECT episode_id, count(*) AS f FROM f_fact_episode GROUP BY 1) USING (episode_id) GROUP BY 1)
    SELECT bucket, episodes, entities, round(empty / episodes, 6) AS empty_rate, round(uses / episodes, 6) AS entities_per_episode, round(facts / episodes, 6) AS facts_per_episode, round(single / entities, 6) AS single_rate, round(noisy / entities, 6) AS noise_share, gold_found FROM ep LEFT JOIN en USING (bucket)""")
def _a14(t: Tables):
    gold = t.values("norm", "'small ring 0'", "'red widget 1'", "'no such'")
    r = g.entity_quality(t.f_episode, t.f_mention, t.f_entity, t.f_fact_episode, gold, "project")
    return r.withColumns({c: F.round(c, 6) for c in ("empty_rate", "entities_per_episode", "facts_per_episode", "single_rate", "noise_share")})


_NR = f"""WITH {_DEG}, nz AS (SELECT d.*, z.noise, CASE WHEN episodes > 0 THEN 'episode' WHEN notes > 0 THEN 'wiki-only' ELSE 'unmentioned' END AS side,
      CASE WHEN d.entity_id % 20 = 5 THEN 'in-merge' WHEN relates > 0 THEN 'has-facts' ELSE 'drop-candidate' END AS disposition FROM dgr d JOIN {NOISE_SQL} z USING (entity_id) WHERE z.noise <> '')"""


@query("A20_noise_report", _NR + """ SELECT CASE WHEN grouping(disposition) = 0 THEN 'disposition' WHEN grouping(noise) = 0 THEN 'noise' WHEN grouping(side) = 0 THEN 'side' ELSE 'total' END AS dimension, coalesce(disposition, noise, side, 'all') AS value, count(*) AS n, CAST(sum(risk) AS BIGINT) AS facts_at_risk
    FROM (SELECT *, CASE WHEN disposition = 'has-facts' THEN relates ELSE 0 END AS risk FROM nz) GROUP BY GROUPING SETS ((), (disposition), (noise), (side))""")
def _a20(t: Tables):
    merging = t.f_entity.where("entity_id % 20 = 5").select("entity_id")
    return g.noise_report(g.noise_rows(_deg(t), merging))


@query("U2_shared_entities", "SELECT entity_id FROM f_mention JOIN f_episode USING (episode_id) WHERE project = '1-URGENT' INTERSECT SELECT entity_id FROM f_mention JOIN f_episode USING (episode_id) WHERE project = '5-LOW'")
def _u2(t: Tables):
    return g.shared_entities(t.f_episode, t.f_mention, "1-URGENT", "5-LOW")


@query("U3_except_project", "SELECT episode_id, name FROM f_episode WHERE project <> '5-LOW'")
def _u3(t: Tables):
    return t.f_episode.where(F.col("project") != "5-LOW").select("episode_id", "name")


_FAMILY, _KEEP = ["SMALL RING 22", "red ring 21"], ["blue bolt 9", "small gear 28"]
_NORM = "CASE WHEN regexp_matches({0}, '^[A-Z0-9]+$') THEN k WHEN k LIKE '%ies' AND length(k) > 4 THEN k[:-4] || 'y' WHEN k LIKE '%s' AND k NOT LIKE '%ss' AND length(k) > 3 THEN k[:-2] ELSE k END"
_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_DIGITS, _FRAME = "array_to_string(regexp_extract_all(lower({0}), '\\d+[a-z]?'), '.')", "regexp_replace(regexp_replace(lower({0}), '\\d+[a-z]?', '', 'g'), '[^a-z0-9]', '', 'g')"


def _sql_norms(names: list[str]) -> str:
    return ", ".join(q(re.sub("[^a-z0-9]", "", x.lower())) for x in names)


@query("G5_duplicate_pairs", f"""WITH k AS (SELECT name, min(entity_type) AS kind, max(noise <> '') AS debris, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM {NOISE_SQL} GROUP BY name),
    n AS (SELECT name, kind, debris, {_NORM.format('name')} AS norm, {_WORDS.format('name')} AS w, array_to_string(list_transform({_WORDS.format('name')}, lambda x: x[1]), '') AS acr, vector FROM k LEFT JOIN f_name_vector USING (name)),
    same AS (SELECT m.a, n.name AS b, 'normalized' AS rule FROM n JOIN (SELECT norm, min(name) AS a FROM n GROUP BY 1) m USING (norm) WHERE n.name <> m.a),
    acro AS (SELECT x.name AS a, y.name AS b, 'acronym' AS rule FROM n x JOIN n y ON regexp_matches(x.name, '^[A-Z0-9]{{2,}}$') AND len(y.w) >= 2 AND y.acr = lower(x.name)),
    held AS (SELECT x.name AS a, y.name AS b, 'containment' AS rule FROM n x JOIN n y ON len(list_distinct(x.w)) < len(list_distinct(y.w)) AND list_has_all(y.w, x.w) AND len(list_filter(x.w, lambda z: z NOT IN ({words(rules.BM25_STOPWORDS)}))) > 0),
    named AS (SELECT a, b, min_by(rule, CASE rule WHEN 'normalized' THEN 0 WHEN 'acronym' THEN 1 ELSE 2 END) AS rule FROM (FROM same UNION ALL FROM acro UNION ALL FROM held) GROUP BY a, b),
    reps AS (SELECT min(name) AS name, vector FROM n WHERE vector IS NOT NULL GROUP BY vector),
    near AS (SELECT x.name AS a, y.name AS b FROM reps x JOIN reps y ON x.name < y.name AND round(list_cosine_similarity(x.vector, y.vector), 9) >= 0.92 UNION ALL SELECT r.name, n.name FROM n JOIN reps r USING (vector) WHERE n.name <> r.name),
    p AS (FROM named UNION ALL SELECT a, b, 'embedding' FROM near WHERE NOT EXISTS (SELECT 1 FROM named m WHERE (m.a, m.b) IN ((near.a, near.b), (near.b, near.a)))),
    c AS (SELECT p.*, coalesce(round(list_cosine_similarity(x.vector, y.vector), 9), 0) AS sim, x.kind <> y.kind AS typed, x.debris OR y.debris AS debris, x.kind AS ka, y.kind AS kb, x.norm AS na, y.norm AS nb, x.w AS wa, y.w AS wb FROM p JOIN n x ON x.name = a JOIN n y ON y.name = b),
    d AS (SELECT *, CASE WHEN rule = 'normalized' AND (typed OR debris OR (lower(a) <> lower(b) AND NOT contains(a, ' ') AND a[1] <> b[1])) THEN 'review' WHEN rule = 'normalized' THEN 'auto'
            WHEN na IN ({_sql_norms(_FAMILY)}) AND nb IN ({_sql_norms(_FAMILY)}) THEN 'never-family' WHEN rule = 'acronym' AND length(a) <= 2 THEN 'weak' WHEN rule = 'acronym' THEN 'review'
            WHEN rule = 'containment' THEN CASE WHEN typed OR len(list_filter(wa, lambda z: z NOT IN ({words(rules.GENERIC_NAME_WORDS)}))) = 0 THEN NULL WHEN lower(kb) = 'person' AND lower(ka) = 'person' THEN 'review' WHEN sim < 0.8 THEN NULL
              WHEN len(list_filter(wb, lambda z: NOT list_contains(wa, z) AND z NOT IN ({words(rules.GENERIC_NAME_WORDS)}))) = 0 THEN 'weak' ELSE 'review' END END AS by_name,
          CASE WHEN sim >= 0.92 AND NOT typed THEN CASE WHEN na IN ({_sql_norms(_KEEP)}) AND nb IN ({_sql_norms(_KEEP)}) THEN 'never-gold-keep' WHEN debris THEN 'weak' ELSE 'review' END END AS by_vector,
          {_FRAME.format('a')} = {_FRAME.format('b')} AND {_DIGITS.format('a')} <> {_DIGITS.format('b')} AND {_DIGITS.format('a')} <> '' AND {_DIGITS.format('b')} <> '' AS version FROM c)
    SELECT a, b, CASE WHEN by_name IS NULL AND NOT version THEN 'embedding' ELSE rule END AS rule, CASE WHEN version THEN 'never-version' ELSE coalesce(by_name, by_vector) END AS tier, round(sim, 6) AS sim FROM d WHERE version OR by_name IS NOT NULL OR by_vector IS NOT NULL""")
def _g5(t: Tables):
    n = t.f_entity.groupBy("name").agg(F.min("entity_type").alias("kind"))
    # What depends on one name is found once a name, not once a pair.
    n = cut_lineage(n.select("name", "kind", tx.noise_category(F.col("name")).isNotNull().alias("debris"), tx.normalize_entity(F.col("name")).alias("norm")))
    p = g.with_vectors(g.name_pairs(t.f_entity), t.f_name_vector)
    for k in ("a", "b"):
        p = p.join(n.select(F.col("name").alias(k), F.col("kind").alias(f"k{k}"), F.col("debris").alias(f"d{k}"), F.col("norm").alias(f"n{k}")), k)
    return g.tier_pairs(p, families=[_FAMILY], keep=_KEEP).select("a", "b", "rule", "tier", F.round(F.coalesce("sim", F.lit(0.0)), 6).alias("sim"))

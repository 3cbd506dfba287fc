"""Retrieval queries: benchmark items asked of the documents, vectors and the graph."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from memlake.functions import rules, text as tx
from memlake.operators import retrieve as r, similarity as sim
from memlake.plans.registry import Tables, query
from memlake.plans.sqltext import bm25_tokens, count_of, fold_words, q, terms
from memlake.session import checkpoint_dir, settle

DOC = "source || ' ' || lang"


def docs(t: Tables):
    return t.f_docs.withColumn("subject", F.expr(DOC))


# --- lexical ------------------------------------------------------------------------------

LEX = f"""lq AS (SELECT query_id, lower(trim(query, ' ')) AS q, {terms('query')} AS ts FROM f_query), lt AS (SELECT query_id, q, len(ts) AS n_terms, unnest(ts) AS term FROM lq),
    ld AS (SELECT doc_id, lower(text) AS t, lower(filename) AS fn, lower(path) AS p, lower(area) AS ar, lower(extension) AS ex FROM f_docs),
    lc AS (SELECT query_id, q, n_terms, doc_id, t, fn, p, ar, ex, contains(fn, term) AS f_hit, contains(p, term) AS p_hit, {count_of('t', 'term')} AS cnt FROM lt, ld),
    ls AS (SELECT query_id, doc_id, round(CASE WHEN contains(any_value(fn), any_value(q)) THEN 20 ELSE 0 END + sum(CASE WHEN f_hit THEN 6.0 ELSE 0 END), 2)::DOUBLE AS filename,
             round(CASE WHEN contains(any_value(p), any_value(q)) THEN 12 ELSE 0 END + sum(CASE WHEN p_hit THEN 3.0 ELSE 0 END), 2)::DOUBLE AS path,
             round(CASE WHEN contains(any_value(t), any_value(q)) THEN 15 + least({count_of('any_value(t)', 'any_value(q)')} * 0.5, 5) ELSE 0 END
               + sum(CASE WHEN cnt > 0 THEN 2.0 + least(cnt * 0.2, 3.0) ELSE 0 END) + CASE WHEN sum((cnt > 0)::INT) = any_value(n_terms) AND any_value(n_terms) > 1 THEN 5 ELSE 0 END, 2)::DOUBLE AS content,
             (CASE WHEN contains(any_value(ar), any_value(q)) OR contains(any_value(ex), any_value(q)) THEN 2 ELSE 0 END)::DOUBLE AS metadata
           FROM lc GROUP BY query_id, doc_id),
    lex AS (SELECT query_id, doc_id, round(filename + path + content + metadata, 2) AS score, CASE greatest(filename, path, content, metadata) WHEN filename THEN 'filename' WHEN path THEN 'path' WHEN content THEN 'content' ELSE 'metadata' END AS basis FROM ls WHERE filename + path + content + metadata > 0),
    lexr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM lex)"""


@query("R1_lexical_scores", f"WITH {LEX} SELECT query_id, basis, count(*) AS documents, max(score) AS best_score FROM lex GROUP BY ALL")
def _r1(t: Tables):
    return r.lexical_summary(t.f_query, docs(t))


@query("R1_lexical_top20", f"WITH {LEX} SELECT query_id, doc_id, score, basis, rank FROM lexr WHERE rank <= 20")
def _r1b(t: Tables):
    return r.lexical_search(t.f_query, docs(t), 20)


# --- BM25 -----------------------------------------------------------------------------------

_TOK = f"list_concat(list_concat({bm25_tokens(DOC)}, {bm25_tokens(DOC)}), list_concat({bm25_tokens(DOC)}, {bm25_tokens('text')}))"
BM = f"""bd AS (SELECT doc_id, observed_at, {_TOK} AS toks FROM f_docs), bq AS (SELECT DISTINCT query_id, unnest({bm25_tokens('query')}) AS token FROM f_query),
    bp AS (SELECT doc_id, observed_at, len, token, count(*) AS tf FROM (SELECT doc_id, observed_at, len(toks) AS len, unnest(toks) AS token FROM bd) WHERE token IN (SELECT token FROM bq) GROUP BY ALL),
    bn AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS a FROM bd), bi AS (SELECT token, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM bp, bn GROUP BY token, n),
    bs AS (SELECT query_id, doc_id, observed_at, round(sum(idf * tf * 2.4::DOUBLE / (tf + 1.4::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a))), 9) AS score FROM bp JOIN bi USING (token) JOIN bq USING (token), bn GROUP BY ALL),
    bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, observed_at DESC, doc_id)::INT AS rank FROM bs)"""


@query("R2_bm25_top10", f"WITH {BM} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 10")
def _r2(t: Tables):
    return r.bm25_search(t.f_query, docs(t), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def pool(t: Tables, k: int = rules.PROJECT_BOOST_POOL):
    """BM25 pool with the document's source (its episode), language (its project) and text."""
    hits = r.bm25_search(t.f_query, docs(t), k).select("query_id", "doc_id", "score", "rank")
    return hits.join(t.f_docs.select("doc_id", "source", F.col("lang").alias("project"), F.md5("text").alias("fact"), "observed_at", "provider"), "doc_id")


POOL = f"{BM}, pool AS (SELECT query_id, bm.doc_id, score, rank, source, lang AS project, md5(text) AS fact, d.observed_at, provider FROM bm JOIN f_docs d ON d.doc_id = bm.doc_id WHERE rank <= 24)"


@query("O2_topk_per_query", f"WITH {BM} SELECT query_id, doc_id, rank FROM bm WHERE rank <= 5")
def _o2(t: Tables):
    return r.bm25_search(t.f_query, docs(t), 5).select("query_id", "doc_id", "rank")


@query("O3_score_floor", f"WITH {POOL}, f AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM pool) SELECT query_id, doc_id, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS place FROM f WHERE score >= top * 0.4) WHERE place <= 8")
def _o3(t: Tables):
    return r.score_floor(pool(t), 8).select("query_id", "doc_id", "rank")


@query("O4_dedup_cap", f"WITH {POOL}, f AS (SELECT query_id, fact, min(rank) AS r FROM pool GROUP BY ALL) SELECT query_id, fact, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r)::INT AS place FROM f) WHERE place <= 10")
def _o4(t: Tables):
    return r.dedup_cap(pool(t), 10).select("query_id", "fact", "rank")


@query("O5_source_cap", f"WITH {POOL}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM pool) SELECT query_id, doc_id, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS place FROM f WHERE n = 1 OR source = '') WHERE place <= 10")
def _o5(t: Tables):
    p = pool(t).withColumnRenamed("rank", "pos")
    return r.source_cap(p, [F.col("pos")], 10).select("query_id", "doc_id", "rank")


_FAN = f"{BM}, fan AS (SELECT * FROM (SELECT query_id, provider, CASE provider WHEN 'mail' THEN 0 WHEN 'memory' THEN 1 ELSE 2 END AS provider_no, doc_id, score, row_number() OVER (PARTITION BY query_id, provider ORDER BY score DESC, doc_id)::INT AS rank FROM bs JOIN (SELECT doc_id, provider FROM f_docs) USING (doc_id)) WHERE rank <= 5)"


def _fan(t: Tables):
    hits = r.bm25_scores(t.f_query, docs(t)).withColumn("score", F.round("score", 9)).join(t.f_docs.select("doc_id", "provider"), "doc_id")
    return r.fan_out({p: hits.where(F.col("provider") == p) for p in ("wiki", "mail", "memory")}, 5)


@query("R10_fan_out", f"WITH {_FAN} SELECT query_id, provider, doc_id, rank FROM fan")
def _r10(t: Tables):
    return _fan(t).select("query_id", "provider", "doc_id", "rank")


@query("O6_interleave", f"WITH {_FAN} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, provider_no)::INT AS place FROM fan")
def _o6(t: Tables):
    return r.interleave(_fan(t)).select("query_id", "doc_id", "place")


_GUESS = "SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' END AS project FROM benchmark"
_BOOST = "row_number() OVER (PARTITION BY query_id ORDER BY coalesce(p.project = g.project, false) DESC, rank)::INT"


@query("O7_project_boost", f"WITH {POOL}, g AS ({_GUESS}) SELECT query_id, doc_id, place FROM (SELECT p.query_id, doc_id, row_number() OVER (PARTITION BY p.query_id ORDER BY coalesce(p.project = g.project, false) DESC, rank)::INT AS place FROM pool p JOIN g ON g.query_id = p.query_id) WHERE place <= 8")
def _o7(t: Tables):
    g = t.benchmark.selectExpr("item_id AS query_id", "CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' END AS project")
    return r.boost(pool(t), g, 8).select("query_id", "doc_id", "place")


@query("O12_project_cap", f"WITH {POOL}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, project ORDER BY rank) > 4 AS overflow FROM pool) SELECT query_id, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overflow, rank)::INT AS place FROM c) WHERE place <= 8")
def _o12(t: Tables):
    return r.project_cap(pool(t), 4, 8).select("query_id", "doc_id", "place")


@query("O1_newest_documents", "SELECT doc_id, observed_at FROM f_docs ORDER BY observed_at DESC, doc_id LIMIT 25")
def _o1(t: Tables):
    return t.f_docs.select("doc_id", "observed_at").orderBy(F.desc("observed_at"), "doc_id").limit(25)


@query("O13_fits_room", "SELECT doc_id, used FROM (SELECT doc_id, CAST(sum(greatest(length(text), 1)) OVER (ORDER BY observed_at DESC, doc_id) AS BIGINT) AS used FROM f_docs) WHERE used <= 20000")
def _o13(t: Tables):
    return r.fits_room(t.f_docs, 20000, F.length("text")).select("doc_id", "used")


# --- fusion -------------------------------------------------------------------------------------

_RRF = f"""{BM}, {LEX}, ll AS (SELECT query_id, 0 AS list_no, rank - 1 AS rank, doc_id FROM bm WHERE rank <= 12 UNION ALL SELECT query_id, 1, rank - 1, doc_id FROM lexr WHERE rank <= 12),
    lf AS (SELECT query_id, list_no, rank, md5(text) AS fact, source FROM ll JOIN documents USING (doc_id)), fu AS (SELECT query_id, fact, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min((list_no, rank)) AS seen, min_by(source, (list_no, rank)) AS source FROM lf GROUP BY 1, 2),
    fc AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, seen) AS n FROM fu), fused AS (SELECT query_id, fact, source, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen)::INT AS rank FROM fc WHERE n <= 1)"""


def fused(t: Tables, limit: int = 10):
    text = t.f_docs.select("doc_id", F.md5("text").alias("fact"), "source")
    a = r.bm25_search(t.f_query, docs(t), 12).select("query_id", F.lit(0).alias("list_no"), (F.col("rank") - 1).alias("rank"), "doc_id")
    b = r.lexical_search(t.f_query, docs(t), 12).select("query_id", F.lit(1).alias("list_no"), (F.col("rank") - 1).alias("rank"), "doc_id")
    return r.rrf(a.union(b).join(text, "doc_id"), limit)


@query("R4_rrf_fusion", f"WITH {_RRF} SELECT query_id, fact, source, round(score, 6) AS score, rank FROM fused WHERE rank <= 10")
def _r4(t: Tables):
    return fused(t).select("query_id", "fact", "source", F.round("score", 6).alias("score"), "rank")


# --- vectors ----------------------------------------------------------------------------------------


def vecs(t: Tables):
    return t.embeddings.select("vec_id", F.col("embedding").alias("vector"), F.concat(F.lit("label-"), F.col("label").cast("string")).alias("project"))


def vec_queries(t: Tables):
    """Every vector is asked once."""
    return vecs(t).select(F.col("vec_id").alias("query_id"), "vector", "project")


_V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, 'label-' || label AS project FROM embeddings)"


_CENT = f"{_V}, cx AS (SELECT project, i, avg(e[i]) AS x FROM v, range(1, 65) r(i) GROUP BY ALL), ct AS (SELECT project, list(x ORDER BY i) AS c FROM cx GROUP BY 1)"


@query("A22_project_centroids", f"WITH {_CENT} SELECT project, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM cx")
def _a22(t: Tables):
    c = r.centroids(vecs(t))
    return c.select("project", F.posexplode("centroid").alias("i", "x")).select("project", "i", F.round("x", 6).alias("x"))


def asked(t: Tables):
    """Every hundredth vector, asked of all."""
    return t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("R3_vector_knn", f"WITH {_V}, s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.e, b.e), 9) AS s FROM v a, v b WHERE a.vec_id % 100 = 0) SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 6")
def _r3(t: Tables):
    return sim.nearest(asked(t), vecs(t), rules.VECTOR_ARM_K).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("R3_bucketed_index")
def _r3b(t: Tables):
    """The index is tuned on other questions than those asked of it."""
    index = sim.VectorIndex.build(vecs(t), f"{checkpoint_dir(t.spark)}/vector-index-{uuid.uuid4().hex}", bucket=50)
    index.tune(t.embeddings.where("vec_id % 100 = 50").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), rules.VECTOR_ARM_K, 0.93)
    return index.search(asked(t), rules.VECTOR_ARM_K).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


_ALIAS = f"""ql AS (SELECT vec_id AS query_id, 'find ' || CASE vec_id % 5 WHEN 0 THEN 'Label 3 notes' WHEN 1 THEN 'label 1s and the label 2' ELSE 'nothing here' END AS query FROM embeddings),
    al AS (SELECT DISTINCT project, {fold_words("'label ' || replace(project, 'label-', '')")} AS label FROM v), ah AS (SELECT DISTINCT query_id, project, 1.0::DOUBLE AS score FROM ql JOIN al ON contains(' ' || {fold_words('query')} || ' ', ' ' || label || ' '))"""
_CH = """SELECT query_id, max(CASE WHEN rk = 1 THEN project END) AS project, (max(CASE WHEN rk = 1 THEN score END) - coalesce(max(CASE WHEN rk = 2 THEN score END), 0)) / max(total) AS margin
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, project) AS rk, sum(score) OVER (PARTITION BY query_id) AS total FROM {} WHERE score > 0) GROUP BY 1"""
_INF = f"""{_CENT}, {_ALIAS}, cs AS (SELECT vec_id AS query_id, ct.project, round(greatest(list_cosine_similarity(e, c), 0), 9) AS score FROM v, ct), ca AS ({_CH.format('ah')}), ce AS ({_CH.format('cs')}),
    inf AS (SELECT v.vec_id AS query_id, v.project AS gold, CASE WHEN ca.margin > 0.1 THEN ca.project WHEN ce.margin > 0.0006 THEN ce.project END AS project, CASE WHEN ca.margin > 0.1 THEN 'A' WHEN ce.margin > 0.0006 THEN 'E' END AS method FROM v LEFT JOIN ca ON ca.query_id = v.vec_id LEFT JOIN ce ON ce.query_id = v.vec_id)"""


def inferred(t: Tables):
    v = vec_queries(t)
    asked = t.embeddings.selectExpr("vec_id AS query_id", "'find ' || CASE vec_id % 5 WHEN 0 THEN 'Label 3 notes' WHEN 1 THEN 'label 1s and the label 2' ELSE 'nothing here' END AS query")
    labels = v.select("project").distinct().withColumn("label", F.concat(F.lit("label "), F.regexp_replace("project", "label-", "")))
    cents = r.centroid_scores(v, r.centroids(vecs(t))).withColumn("score", F.round("score", 9))
    return r.infer_projects(r.alias_scores(asked, labels), cents, v)


@query("R6_project_inference", f"WITH {_INF} SELECT query_id, coalesce(project, '') AS project, coalesce(method, '') AS method FROM inf")
def _r6(t: Tables):
    return inferred(t).select("query_id", F.coalesce("project", F.lit("")).alias("project"), F.coalesce("method", F.lit("")).alias("method"))


@query("R7_pool_inference", f"WITH {POOL}, s AS (SELECT query_id, project, sum(1.0::DOUBLE / rank) AS score FROM pool GROUP BY ALL) SELECT query_id, project, round(score, 6) AS score FROM s")
def _r7(t: Tables):
    return r.pool_project_scores(pool(t)).select("query_id", "project", F.round("score", 6).alias("score"))


@query("R7_entity_inference", f"WITH {POOL}, z AS (SELECT lang AS project, count(*) AS size FROM documents GROUP BY 1) SELECT query_id, project, round(sum(1.0::DOUBLE / size), 6) AS score FROM pool JOIN z USING (project) GROUP BY ALL")
def _r7b(t: Tables):
    sizes = t.documents.groupBy(F.col("lang").alias("project")).agg(F.count(F.lit(1)).alias("size"))
    return r.entity_project_scores(pool(t).select("query_id", "project"), sizes).select("query_id", "project", F.round("score", 6).alias("score"))


@query("R12_document_boost", f"""WITH {POOL}, g AS ({_GUESS}) SELECT query_id, path, place FROM (SELECT p.query_id, d.path, row_number() OVER (PARTITION BY p.query_id ORDER BY coalesce(p.project = g.project, false) DESC, rank)::INT AS place
    FROM pool p JOIN g ON g.query_id = p.query_id JOIN f_docs d ON d.doc_id = p.doc_id) WHERE place <= 8""")
def _r12(t: Tables):
    # Each document's project is read from its front matter.
    notes = t.f_docs.select("doc_id", "path", F.expr("'---\\nproject: ' || lang || '\\n---\\n' || text").alias("text"))
    notes = notes.select("doc_id", "path", tx.front_matter_field(F.col("text"), "project").alias("project"))
    hits = r.bm25_search(t.f_query, docs(t), rules.PROJECT_BOOST_POOL).select("query_id", "doc_id", "rank").join(notes, "doc_id")
    g = t.benchmark.selectExpr("item_id AS query_id", "CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' END AS project")
    return r.boost(hits, g, 8).select("query_id", "path", "place")


# --- graph-backed ---------------------------------------------------------------------------------------

SEED = "SELECT query_id, episode_id, rk FROM (SELECT o_custkey % 40 AS query_id, o_orderkey AS episode_id, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderdate DESC, o_orderkey)::INT AS rk FROM orders) WHERE rk <= 3"


def seeds(t: Tables):
    """Three newest episodes per query: a page of direct hits."""
    from memlake.operators.scan import top_k

    o = t.orders.select((F.col("o_custkey") % 40).alias("query_id"), F.col("o_orderkey").alias("item_id"), "o_orderdate")
    return top_k(o, ["query_id"], [F.desc("o_orderdate"), F.col("item_id")], 3).drop("o_orderdate")


def note_expansion(t: Tables, k: int = 3):
    eps = t.f_mention.select(F.col("episode_id").alias("item_id"), "entity_id")
    notes = t.f_note_mention.select(F.col("note_id").alias("item_id"), "entity_id")
    s = seeds(t)
    exclude = t.f_note.select((F.col("note_id") % 40).alias("query_id"), F.col("note_id").alias("item_id"))
    return r.expand(s.select("query_id", "item_id"), eps, notes, t.f_note_mention, exclude, k)


_EXP = f"""sd AS ({SEED}), en AS (SELECT DISTINCT query_id, entity_id FROM sd JOIN f_mention USING (episode_id)), fq AS (SELECT entity_id, count(*) AS freq FROM f_note_mention GROUP BY 1), w AS (SELECT query_id, entity_id, 1.0::DOUBLE / freq AS weight FROM en JOIN fq USING (entity_id)),
    nx AS (SELECT query_id, note_id, round(sum(weight), 9) AS score, max_by(w.entity_id, (weight, -w.entity_id)) AS top_entity FROM w JOIN f_note_mention n ON n.entity_id = w.entity_id WHERE note_id % 40 <> query_id GROUP BY 1, 2),
    nxr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note_id)::INT AS rank FROM nx)"""


@query("R5_expand_to_notes", f"WITH {_EXP} SELECT query_id, note_id, round(score, 6) AS score, top_entity, rank FROM nxr WHERE rank <= 3")
def _r5(t: Tables):
    return note_expansion(t).select("query_id", F.col("item_id").alias("note_id"), F.round("score", 6).alias("score"), "top_entity", "rank")


@query("R5_expand_to_episodes", """WITH sd AS (SELECT s_suppkey % 40 AS query_id, s_suppkey AS note_id FROM supplier), en AS (SELECT DISTINCT query_id, entity_id FROM sd JOIN f_note_mention USING (note_id)), fq AS (SELECT entity_id, count(*) AS freq FROM f_note_mention GROUP BY 1),
    x AS (SELECT query_id, episode_id, round(sum(1.0::DOUBLE / freq), 9) AS score, max_by(m.entity_id, (1.0::DOUBLE / freq, -m.entity_id)) AS top_entity FROM en JOIN fq USING (entity_id) JOIN f_mention m ON m.entity_id = en.entity_id WHERE episode_id % 40 <> query_id GROUP BY 1, 2)
    SELECT query_id, episode_id, round(score, 6) AS score, top_entity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, episode_id)::INT AS rank FROM x) WHERE rank <= 3""")
def _r5b(t: Tables):
    eps = t.f_mention.select(F.col("episode_id").alias("item_id"), "entity_id")
    notes = t.f_note_mention.select(F.col("note_id").alias("item_id"), "entity_id")
    s = t.supplier.select((F.col("s_suppkey") % 40).alias("query_id"), F.col("s_suppkey").alias("item_id"))
    exclude = t.f_episode.select((F.col("episode_id") % 40).alias("query_id"), F.col("episode_id").alias("item_id"))
    x = r.expand(s, notes, eps, t.f_note_mention, exclude)
    return x.select("query_id", F.col("item_id").alias("episode_id"), F.round("score", 6).alias("score"), "top_entity", "rank")


@query("R8_attach_sources", f"""WITH sd AS ({SEED}) SELECT query_id, rk AS rank, 'ep-' || e.episode_id AS names, e.project AS projects FROM sd JOIN f_episode e ON e.episode_id = sd.episode_id""")
def _r8(t: Tables):
    s = seeds(t)
    hits = s.select("query_id", "rank")
    r8 = r.attach_sources(hits, s.select("query_id", "rank", F.col("item_id").alias("episode_id")), t.f_episode)
    return r8.select("query_id", "rank", F.array_join(F.transform("sources", lambda x: x["name"]), ",").alias("names"), F.array_join(F.transform("sources", lambda x: x["project"]), ",").alias("projects"))


_R9 = f"""{BM}, {_EXP}, wk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS place FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM bm WHERE rank <= 12) WHERE score >= top * 0.4),
    ff AS (SELECT query_id, fact, min((rk, f.valid_at, f.fact_id)) AS o, min_by(invalid_at, (rk, f.valid_at, f.fact_id)) AS inv, min_by(invalid_at IS NULL, (rk, f.valid_at, f.fact_id)) AS act FROM sd JOIN f_fact_episode USING (episode_id) JOIN f_fact f USING (fact_id) GROUP BY 1, 2),
    fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o)::INT AS rank FROM ff),
    ctx AS (SELECT query_id, 'wiki' AS section, place AS rank, CAST(doc_id AS VARCHAR) AS item, '' AS status FROM wk WHERE place <= 5 UNION ALL SELECT query_id, 'memory', rank, fact, CASE WHEN act THEN 'ACTIVE' ELSE 'SUPERSEDED' END FROM fr WHERE rank <= 10
      UNION ALL SELECT query_id, 'expanded', rank, CAST(note_id AS VARCHAR), '' FROM nxr WHERE rank <= 3)"""


def context_rows(t: Tables):
    wiki = r.score_floor(r.bm25_search(t.f_query, docs(t), 12).select("query_id", "doc_id", "score", "rank"), 5)
    s = seeds(t).select("query_id", F.col("item_id").alias("episode_id"), F.col("rank").alias("rk"))
    # The cited pairs come first: facts are summed up for them only.
    cited = settle(t.f_fact_episode.join(settle(s), "episode_id"), row_bytes=96)
    ends = F.split("fact_id", "[>@]")
    pairs = cited.select(ends[0].cast("bigint").alias("source_id"), ends[1].cast("bigint").alias("target_id")).distinct()
    facts = cited.join(t.f_fact.join(settle(pairs), ["source_id", "target_id"], "left_semi"), "fact_id")
    ranked = facts.withColumn("rank", F.struct("rk", "valid_at", "fact_id")).select("query_id", "rank", "fact", "invalid_at")
    mem = r.dedup_cap(ranked, 10)
    return r.assemble_context(wiki, mem, note_expansion(t).select("query_id", "rank", "item_id"))


@query("R9_context_rows", f"WITH {_R9} SELECT * FROM ctx")
def _r9(t: Tables):
    return context_rows(t).drop("section_no")


@query("R9_context_text", f"WITH {_R9} SELECT query_id, md5(string_agg('[' || section || '] ' || CASE WHEN status = '' THEN '' ELSE status || ' ' END || item, chr(10) ORDER BY CASE section WHEN 'wiki' THEN 1 WHEN 'memory' THEN 2 ELSE 3 END, rank)) AS context_md5 FROM ctx GROUP BY 1")
def _r9b(t: Tables):
    return r.context_text(context_rows(t)).select("query_id", F.md5("context").alias("context_md5"))


# --- leaks -----------------------------------------------------------------------------------------------

_W = "regexp_extract_all(lower({}), '[a-z0-9]+')"
LEAK = f"""cs AS (SELECT item_id AS case_id, {_W.format("text")} AS w FROM benchmark UNION ALL SELECT item_id + 1000000, {_W.format("array_to_string(string_split(text, ' ')[1:6], ' ')")} FROM benchmark WHERE item_id % 8 = 0),
    sh AS (SELECT g, min(case_id) AS case_id FROM (SELECT case_id, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT case_id, w, unnest(range(1, len(w) - 6)) AS i FROM cs WHERE len(w) >= 8)) GROUP BY 1),
    wh AS (SELECT array_to_string(w, ' ') AS g, min(case_id) AS case_id FROM cs WHERE len(w) BETWEEN 5 AND 7 GROUP BY 1),
    dw AS (SELECT doc_id, {_W.format('text')} AS w FROM documents), dg AS (SELECT doc_id, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM dw WHERE len(w) >= 8)),
    leak AS (SELECT doc_id, case_id FROM (SELECT doc_id, case_id, count(*) AS n FROM dg JOIN sh USING (g) GROUP BY ALL) WHERE n >= 3 UNION SELECT doc_id, case_id FROM dw, wh WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || g || ' '))"""


def cases(t: Tables):
    """Every item whole, and for each eighth one a short case beside it."""
    short = t.benchmark.where("item_id % 8 = 0").selectExpr("item_id + 1000000 AS case_id", "array_join(slice(split(text, ' '), 1, 6), ' ') AS query")
    return t.benchmark.selectExpr("item_id AS case_id", "text AS query").union(short)


@query("R11_eval_leaks", f"WITH {LEAK} SELECT doc_id, case_id FROM leak")
def _r11(t: Tables):
    return r.eval_leaks(cases(t), t.documents)

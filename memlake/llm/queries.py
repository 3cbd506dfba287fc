"""The registered queries over the operators of this package, with oracle SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.llm import attention_lm, conversation_repair, crf_quality, decontaminate, divergence, exact_dedup, html_extraction, line_dedup, packing, simhash, token_files, toxicity, url_filter
from memlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_exact_dedup", r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS pts, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY pts DESC, doc_id)""")
def op1(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op2_simhash")
def op2(spark, sf_dir):
    found = simhash.near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@query("op3_line_dedup", rf"""
WITH pages AS (SELECT DISTINCT coalesce(source, '') AS host, coalesce(text, '') AS page FROM documents),
 own AS (SELECT host, page, unnest(list_distinct(list_transform(string_split(page, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))))) AS line FROM pages),
 held AS (SELECT host, line, count(*) AS n FROM own WHERE line <> '' GROUP BY host, line),
 total AS (SELECT host, count(*) AS total FROM pages GROUP BY host),
 bad AS (SELECT host, list(line) AS bad FROM held JOIN total USING (host) WHERE n >= {line_dedup.MIN_PAGES} AND n > {line_dedup.RATIO} * total GROUP BY host),
 d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, coalesce(bad, []) AS bad FROM documents LEFT JOIN bad ON coalesce(source, '') = bad.host),
 k AS (SELECT doc_id, text, l, list_filter(l, lambda x: NOT list_contains(bad, trim(x, ' ' || chr(9) || chr(13)))) AS kept FROM d)
SELECT doc_id, coalesce(len(l), 0)::INTEGER AS n_lines, coalesce(len(l) - len(kept), 0)::INTEGER AS n_dropped,
  CASE WHEN len(l) > len(kept) THEN array_to_string(kept, chr(10)) ELSE text END AS text FROM k""")
def op3(spark, sf_dir):
    cleaned = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), "text")


@query("op4_decontaminate", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
 lens AS (SELECT DISTINCT n FROM p),
 dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN lens)),
 hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN p USING (n, win)),
 pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM hit) GROUP BY doc_id),
 it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op4(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


@query("op5_token_files")
def op5(spark, sf_dir):
    return token_files.token_report(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


@query("op6_best_fit_packing")
def op6(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


@query("op7_crf_quality")
def op7(spark, sf_dir):
    return crf_quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_url_filter")
def op8(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query("op9_toxicity")
def op9(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_attention_lm")
def op10(spark, sf_dir):
    return attention_lm.report(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op11_html_text", r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS inner_html FROM pages),
 t AS (SELECT page_id, url, regexp_replace(regexp_replace(inner_html, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
 u AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS t FROM t),
 w AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM u)
SELECT page_id, url, text, length(text) AS n_chars FROM w""")
def op11(spark, sf_dir):
    return html_extraction.extract(table(spark, sf_dir, "pages"))


@query("op12_source_divergence", rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 g AS (SELECT DISTINCT lang, source FROM d),
 kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {divergence.MIN_DOCS}),
 c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
 every AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 p AS (SELECT lang, source, term, n, 1 + ((1000000000::HUGEINT * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w)) AS p FROM every WINDOW w AS (PARTITION BY lang, source)),
 q AS (SELECT lang, term, 1 + ((1000000000::HUGEINT * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w)) AS q
       FROM (SELECT lang, term, sum(n) AS n FROM every GROUP BY ALL) WINDOW w AS (PARTITION BY lang)),
 dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS v FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN dist x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
 term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= {divergence.TOP}""")
def op12(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op13_conversation_repair")
def op13(spark, sf_dir):
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))

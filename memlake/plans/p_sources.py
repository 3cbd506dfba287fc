"""Import, note and file queries. Export shapes are built from the given tables row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import rules, text as tx
from memlake.operators import graph as g, ledger as l, notes as n, revisions as rev
from memlake.plans.registry import Tables, query
from memlake.plans.sqltext import q
from memlake.sources import exports as x, files as f

# --- chat trees: a sibling branch at every third turn -----------------------------------
_NODES = """SELECT conversation_id, 'n' || turn AS node_id, CASE WHEN turn > 0 THEN 'n' || (turn - 1) END AS parent_id, turn * 2 AS created_at FROM f_conv
    UNION ALL SELECT conversation_id, 's' || turn, 'n' || (turn - 1), turn * 2 - 1 FROM f_conv WHERE turn % 3 = 0 AND turn > 0"""


def tree(t: Tables):
    c = t.f_conv
    main = c.selectExpr("conversation_id", "'n' || turn AS node_id", "CASE WHEN turn > 0 THEN 'n' || (turn - 1) END AS parent_id", "turn * 2 AS created_at")
    return main.union(c.where("turn % 3 = 0 AND turn > 0").selectExpr("conversation_id", "'s' || turn", "'n' || (turn - 1)", "turn * 2 - 1"))


_PATH = f"nd AS ({_NODES}), lf AS (SELECT conversation_id, max_by(node_id, created_at) AS node_id FROM nd a WHERE NOT EXISTS (SELECT 1 FROM nd b WHERE b.conversation_id = a.conversation_id AND b.parent_id = a.node_id) GROUP BY 1), wk AS (SELECT conversation_id, node_id, 0 AS steps FROM lf UNION ALL SELECT w.conversation_id, n.parent_id, steps + 1 FROM wk w JOIN nd n ON n.conversation_id = w.conversation_id AND n.node_id = w.node_id WHERE n.parent_id IS NOT NULL)"


def _leaf_fix(nodes):
    # Text ids compare as text; the newest leaf is by creation number.
    return nodes.withColumn("created_at", F.lpad(F.col("created_at").cast("string"), 12, "0"))


@query("S6_active_path", f"WITH {_PATH} SELECT conversation_id, node_id, CAST(max(steps) OVER (PARTITION BY conversation_id) - steps AS BIGINT) AS position FROM wk")
def _s6(t: Tables):
    nodes = tree(t)
    return x.active_path(nodes, x.newest_leaf(_leaf_fix(nodes)))


@query("S6_path_counts", f"WITH {_PATH} SELECT n.conversation_id, count(w.node_id) AS active, count(*) - count(w.node_id) AS discarded FROM nd n LEFT JOIN wk w ON w.conversation_id = n.conversation_id AND w.node_id = n.node_id GROUP BY 1")
def _s6b(t: Tables):
    nodes = tree(t)
    return x.path_counts(nodes, x.active_path(nodes, x.newest_leaf(_leaf_fix(nodes))))


@query("S5_read_chat_tree", """SELECT event_id AS conversation_id, n AS node_id, coalesce(CASE n WHEN 'a' THEN 'root' END, '') AS parent_id, n = 'a' AS is_leaf, coalesce(CASE n WHEN 'a' THEN actor_type END, '') AS role, CASE n WHEN 'a' THEN trim(text, ' ') ELSE '' END AS text
    FROM f_conv, (VALUES ('root'), ('a')) v(n) WHERE turn % 4 <> 3""")
def _s5(t: Tables):
    msg = F.struct(F.col("event_id").alias("id"), F.struct(F.col("actor_type").alias("role")).alias("author"), F.struct(F.array("text").alias("parts")).alias("content"))
    node = F.struct(F.lit("root").alias("parent"), msg.alias("message"))
    root = F.struct(F.lit(None).cast("string").alias("parent"), F.lit(None).cast(t.f_conv.select(msg.alias("m")).schema["m"].dataType).alias("message"))
    doc = F.to_json(F.struct(F.col("event_id").alias("conversation_id"), F.lit("a").alias("current_node"), (F.col("turn") % 4 == 3).alias("is_do_not_remember"),
                             F.create_map(F.lit("root"), root, F.lit("a"), node).alias("mapping")))
    r = x.read_chat_tree(t.f_conv.select(doc.alias("json")))
    return r.select("conversation_id", "node_id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "is_leaf", F.coalesce("role", F.lit("")).alias("role"), "text")


@query("S7_message_text", "SELECT event_id, md5(CASE WHEN turn % 2 = 0 THEN trim(text, ' ') ELSE trim(left(text, 10) || ' ' || actor_type, ' ') END) AS text_md5 FROM f_conv")
def _s7(t: Tables):
    blocks = F.expr("array(struct('text' AS type, left(text, 10) AS text), struct('image' AS type, 'zz' AS text), struct('text' AS type, '' AS text), struct('text' AS type, actor_type AS text))")
    own = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.lit("  "))
    return t.f_conv.select("event_id", F.md5(x.message_text(own, blocks)).alias("text_md5"))


_ACT = "('apps:' || CASE WHEN turn % 2 = 0 THEN 'conv' || conversation_id ELSE 'unlinked-' || (conversation_id * 10 + turn) END)"
_HASH = """sha256('{"text":' || to_json(%s) || '}')"""


@query("S8_flatten_activity", f"""WITH b AS (SELECT *, 'ask ' || conversation_id || ' ' || turn AS p, 'reply ' || turn AS a FROM f_conv WHERE turn % 5 <> 4)
    SELECT 'activity:' || {_ACT} || ':' || {_HASH % 'p'} AS event_id, 'user' AS actor_type, p AS text, '' AS parent_event_id, observed_at FROM b
    UNION ALL SELECT 'activity:' || {_ACT} || ':response:' || {_HASH % 'a'}, 'assistant', a, 'activity:' || {_ACT} || ':' || {_HASH % 'p'}, observed_at FROM b WHERE turn % 3 <> 2""")
def _s8(t: Tables):
    rec = F.to_json(F.struct(
        F.when(F.col("turn") % 5 == 4, F.lit("  ")).otherwise(F.expr("'Prompted ask ' || conversation_id || ' ' || turn")).alias("title"), F.col("observed_at").cast("string").alias("time"),
        F.expr("CASE WHEN turn % 2 = 0 THEN 'https://x.example/app/conv' || conversation_id END").alias("titleUrl"),
        F.expr("CASE WHEN turn % 3 <> 2 THEN array(struct('<p>reply <b>' || turn || '</b></p>' AS html)) END").alias("safeHtmlItem")))
    e = x.flatten_activity(t.f_conv.select((F.col("conversation_id") * 10 + F.col("turn")).alias("record_no"), rec.alias("json")))
    return e.select("event_id", "actor_type", "text", F.coalesce("parent_event_id", F.lit("")).alias("parent_event_id"), "observed_at")


# --- Markdown lists ------------------------------------------------------------------------


def bullet_docs(t: Tables):
    """Documents whose lines become headings, bullets of two depths, continuations and paragraphs."""
    line = "CASE (doc_id + i) % 7 WHEN 0 THEN '# ' || x WHEN 1 THEN '- ' || x WHEN 2 THEN '  - ' || x WHEN 3 THEN '    more ' || x WHEN 4 THEN '' WHEN 5 THEN x ELSE '* ' || x END"
    return t.documents.select("doc_id", F.array_join(F.expr(f"transform(split(text, '\\\\n'), (x, i) -> {line})"), "\n").alias("text"))


@query("S9_parse_bullets")
def _s9(t: Tables):
    return n.parse_bullets(bullet_docs(t))


# --- sections and links ------------------------------------------------------------------------

_MD = "html"
for _k in range(1, 6):
    _MD = f"regexp_replace({_MD}, '<h{_k}[^>]*>(.*?)</h{_k}>', chr(10) || '{'#' * _k} \\1' || chr(10), 'g')"


def pages(t: Tables):
    md = F.col("html")
    for k in range(1, 6):
        md = F.regexp_replace(md, f"<h{k}[^>]*>(.*?)</h{k}>", f"\n{'#' * k} $1\n")
    # Pages hold no second-level headings: line breaks and list items stand for them.
    md = F.replace(F.replace(md, F.lit("<br>"), F.lit("\n## ")), F.lit("<li>"), F.lit("\n### "))
    return t.pages.select(F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), md.alias("text"))


_MD = f"replace(replace({_MD}, '<br>', chr(10) || '## '), '<li>', chr(10) || '### ')"
_CLEAN = "trim(h1, ' ')"
for _p, _to in ((r"[*_`]", ""),):
    _CLEAN = f"trim(regexp_replace({_CLEAN}, {q(_p)}, '', 'g'), ' ')"
for _p in (r"^(?:\d+[A-Za-z]?[.)]|Step\s*\d+|Phase\s*\d+|Part\s*\d+|#+)\s*[-—:.]?\s*", r"^(?:[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]\x{FE0F}?\s*)+",
           r"\((?:as of |updated )?[^)]*\d{4}[^)]*\)", r"\s*[-—]\s*(?:Added |Updated )?\d{4}-\d{2}-\d{2}.*$", r"^\w+ \d{1,2}, \d{4}\s*[-—:]\s*"):
    _CLEAN = f"regexp_replace({_CLEAN}, {q(_p)}, '', 'g')"
_CLEAN = f"trim(regexp_replace({_CLEAN}, '\\s+', ' ', 'g'), ' :—-')"
_NRM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' ')"
SECT = f"""pg AS (SELECT 'page/' || page_id || '.md' AS path, {_MD} AS text FROM pages),
    ln AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM pg),
    hd AS (SELECT path, no, length(regexp_extract(line, {q(rules.HEADING)}, 1)) AS level, regexp_extract(line, {q(rules.HEADING)}, 2) AS h1, row_number() OVER (PARTITION BY path ORDER BY no) - 1 AS idx FROM ln WHERE regexp_matches(line, {q(rules.HEADING)})),
    h2 AS (SELECT *, {_CLEAN} AS clean FROM hd), h3 AS (SELECT *, left(sha1(path || chr(31) || idx || chr(31) || clean), 16) AS section_id FROM h2),
    pr AS (SELECT a.path, a.no, max(b.no) AS pno FROM h3 a JOIN h3 b ON b.path = a.path AND b.no < a.no AND b.level < a.level GROUP BY 1, 2),
    bd AS (SELECT l.path, max(h.no) AS sno, l.no, any_value(l.line) AS line FROM ln l JOIN h3 h ON h.path = l.path AND h.no < l.no WHERE NOT regexp_matches(l.line, {q(rules.HEADING)}) GROUP BY l.path, l.no),
    bw AS (SELECT path, sno AS no, list_filter(flatten(list(string_split_regex(line, '\\s+') ORDER BY bd.no)), lambda w: w <> '') AS ws FROM bd GROUP BY 1, 2),
    sections AS (SELECT h.path, h.section_id, h.idx, h.level, h.clean, p.section_id AS parent_id, coalesce(len(ws), 0) AS body_words, coalesce(array_to_string(ws[1:25], ' '), '') AS lede,
        {_NRM.format('h.clean')} IN ({', '.join(q(b) for b in rules.BOILERPLATE_LABELS)}) AS is_boilerplate
      FROM h3 h LEFT JOIN pr ON pr.path = h.path AND pr.no = h.no LEFT JOIN h3 p ON p.path = pr.path AND p.no = pr.pno LEFT JOIN bw ON bw.path = h.path AND bw.no = h.no)"""


@query("S10_parse_sections", f"WITH {SECT} SELECT path, section_id, idx, CAST(level AS INTEGER) AS level, clean AS heading, coalesce(parent_id, '') AS parent_id, body_words, md5(lede) AS lede_md5, is_boilerplate FROM sections")
def _s10(t: Tables):
    s = n.parse_sections(pages(t))
    return s.select("path", "section_id", "idx", "level", F.col("heading_clean").alias("heading"), F.coalesce("parent_id", F.lit("")).alias("parent_id"), "body_words", F.md5("lede").alias("lede_md5"), "is_boilerplate")


_LINKS = "SELECT path AS from_path, doc_id * 7 % 1400 AS to_id FROM f_docs"
_RES = f"lk AS ({_LINKS}), rs AS (SELECT from_path, d.path AS resolved FROM lk LEFT JOIN f_docs d ON d.doc_id = to_id)"


def links(t: Tables):
    text = F.expr("text || ' [[area/' || doc_id * 7 % 1400 || '|alias]] [['")
    return n.wikilinks(t.f_docs.select("path", text.alias("text")))


@query("S11_resolve_links", f"WITH {_RES} SELECT from_path, coalesce(resolved, '') AS resolved_path FROM rs")
def _s11(t: Tables):
    return n.resolve_links(links(t), t.f_docs).select("from_path", F.coalesce("resolved_path", F.lit("")).alias("resolved_path"))


@query("S11_stub_notes", f"WITH {_RES} SELECT DISTINCT resolved AS path, split_part(resolved, '/', 1) AS area FROM rs WHERE resolved <> from_path AND resolved NOT IN (SELECT path FROM f_docs WHERE doc_id % 3 <> 0)")
def _s11b(t: Tables):
    return n.stub_notes(n.resolve_links(links(t), t.f_docs), t.f_docs.where("doc_id % 3 <> 0"))


@query("S12_describe_assets", """WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '.git/' || path WHEN 1 THEN path WHEN 2 THEN doc_id || '.PDF' WHEN 3 THEN 'x/' || doc_id ELSE 'y/.hid' || doc_id END AS path FROM f_docs)
    SELECT path, CASE doc_id % 5 WHEN 1 THEN split_part(path, '/', 1) WHEN 2 THEN 'ROOT' ELSE 'x' END AS area, CASE doc_id % 5 WHEN 1 THEN '.md' WHEN 2 THEN '.pdf' ELSE '(none)' END AS extension,
           CASE doc_id % 5 WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'application/pdf' ELSE 'application/octet-stream' END AS media_type FROM p WHERE doc_id % 5 IN (1, 2, 3)""")
def _s12b(t: Tables):
    p = t.f_docs.selectExpr("CASE doc_id % 5 WHEN 0 THEN '.git/' || path WHEN 1 THEN path WHEN 2 THEN doc_id || '.PDF' WHEN 3 THEN 'x/' || doc_id ELSE 'y/.hid' || doc_id END AS path")
    return f.describe_assets(p).select("path", "area", "extension", "media_type")


@query("S13_note_dates", """WITH nt AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'n/2024-01-0' || (doc_id % 9 + 1) || ' ' || filename ELSE path END AS path, CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '2023-12-01' + (doc_id % 20) * INTERVAL 1 DAY END AS fc,
        CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '2024-03-01' END AS fu, CASE WHEN doc_id % 5 = 1 THEN TIMESTAMP '2024-01-01' + (doc_id % 9) * INTERVAL 1 DAY END AS nm, CASE WHEN doc_id % 3 = 0 THEN observed_at END AS dc FROM f_docs),
    h AS (SELECT event_id % 2000 AS doc_id, min(observed_at) AS c1, max(observed_at) AS c2 FROM f_events GROUP BY 1),
    x AS (SELECT nt.*, c1, c2, coalesce(c1, dc) AS base, nm IS NOT NULL AND (coalesce(c1, dc) IS NULL OR CAST(nm AS DATE) < CAST(coalesce(c1, dc) AS DATE)) AS early FROM nt LEFT JOIN h USING (doc_id))
    SELECT path, CASE WHEN fc IS NOT NULL THEN fc WHEN early THEN nm ELSE base END AS created_at, coalesce(CASE WHEN fc IS NOT NULL THEN 'frontmatter' WHEN early THEN 'filename' WHEN c1 IS NOT NULL THEN 'git' WHEN dc IS NOT NULL THEN 'disk' END, '') AS created_source,
           coalesce(c2, fu, dc) AS updated_at, coalesce(CASE WHEN c2 IS NOT NULL THEN 'git' WHEN fu IS NOT NULL THEN 'frontmatter' WHEN dc IS NOT NULL THEN 'disk' END, '') AS updated_source FROM x""")
def _s13(t: Tables):
    d = t.f_docs.selectExpr(
        "doc_id", "CASE WHEN doc_id % 5 = 1 THEN 'n/2024-01-0' || (doc_id % 9 + 1) || ' ' || filename ELSE path END AS path",
        "CASE WHEN doc_id % 4 = 0 THEN '---\\ncreated: ' || CAST(date_add(DATE '2023-12-01', CAST(doc_id % 20 AS INT)) AS STRING) || '\\nupdated: \"2024-03-01T00:00:00Z\"\\n---\\n' || text ELSE text END AS text",
        "CASE WHEN doc_id % 3 = 0 THEN observed_at END AS disk_created", "CASE WHEN doc_id % 3 = 0 THEN observed_at END AS disk_updated")
    hist = t.f_events.select((F.col("event_id") % 2000).alias("doc_id"), F.col("observed_at").alias("at")).join(d.select("doc_id", "path"), "doc_id").select("path", "at")
    r = n.note_dates(d.drop("doc_id"), hist)
    return r.withColumns({c: F.coalesce(c, F.lit("")) for c in ("created_source", "updated_source")})


@query("S14_read_mail", """SELECT 'm' || doc_id AS id, 'th' || doc_id % 50 AS thread_id, 'About ' || source AS subject, observed_at AS sent_at, md5(text) AS body_md5 FROM f_docs WHERE doc_id % 7 <> 0""")
def _s14(t: Tables):
    msg = F.to_json(F.struct(F.expr("'m' || doc_id AS id"), F.expr("'th' || doc_id % 50 AS thread_id"), F.expr("'About ' || source AS subject"), F.col("observed_at").cast("string").alias("date"), F.col("text").alias("body"),
                             F.array(F.lit("inbox")).alias("labels")))
    rows = t.f_docs.select(F.when(F.col("doc_id") % 7 == 0, F.lit("{broken")).otherwise(msg).alias("json"))
    return f.parse_mail(rows).select("id", "thread_id", "subject", "sent_at", F.md5("body").alias("body_md5"))


@query("S14_parse_mbox", """SELECT '<m' || doc_id || '@x>' AS id, 'Re: ' || source || ' and more' AS subject, md5(trim('From here' || chr(10) || text, ' ')) AS body_md5 FROM documents""")
def _s14b(t: Tables):
    raw = F.expr("'From a@b Mon Jan 1\\nMessage-ID: <m' || doc_id || '@x>\\nSubject: Re: ' || source || '\\n  and more\\nFrom: a@b\\n\\n>From here\\n' || text")
    m = f.parse_mbox_messages(t.documents.select(raw.alias("raw")))
    return m.select("id", "subject", F.md5("body").alias("body_md5"))


# --- agent transcripts ------------------------------------------------------------------------


def session_lines(t: Tables):
    msg = F.expr("""named_struct('role', actor_type, 'model', 'm1', 'content', CASE turn % 4 WHEN 0 THEN CASE actor_type WHEN 'user' THEN text ELSE to_json(array(named_struct('type', 'thinking', 'thinking', text))) END
        WHEN 1 THEN to_json(array(named_struct('type', 'text', 'text', text), named_struct('type', 'text', 'text', 'ok')))
        WHEN 2 THEN to_json(array(named_struct('type', CASE actor_type WHEN 'user' THEN 'tool_result' ELSE 'tool_use' END, 'content', text, 'name', 'shell', 'input', '{"a":1}'))) ELSE '' END)""")
    line = F.to_json(F.struct(F.expr("CASE WHEN actor_type = 'system' THEN 'summary' ELSE actor_type END").alias("type"), F.concat(F.lit("u"), "turn").alias("uuid"), F.col("observed_at").cast("string").alias("timestamp"),
                              (F.col("turn") == 6).alias("isMeta"), msg.alias("message")))
    return t.f_conv.select("conversation_id", F.when(F.col("turn") == 5, F.lit("{oops")).otherwise(line).alias("line"))


_CUT = f"CASE WHEN length(trim(text, ' ')) > {x.BLOCK_CHARS} THEN left(trim(text, ' '), {x.BLOCK_CHARS}) || '...[truncated]' ELSE trim(text, ' ') END"


@query("S15_session_lines", f"""SELECT 'session:' || conversation_id || ':u' || turn AS event_id, actor_type, CASE WHEN actor_type = 'assistant' THEN 'assistant_turn' WHEN turn % 4 = 2 THEN 'tool_result' ELSE 'user_turn' END AS content_kind,
    md5(CASE turn % 4 WHEN 0 THEN CASE actor_type WHEN 'user' THEN trim(text, ' ') ELSE text END WHEN 1 THEN text || CASE actor_type WHEN 'user' THEN ' ' ELSE chr(10) || chr(10) END || 'ok' ELSE '' END) AS text_md5,
    md5(CASE WHEN turn % 4 <> 2 THEN '' WHEN actor_type = 'assistant' THEN 'shell {{"a":1}}' WHEN length(trim(text, ' ')) > {x.BLOCK_CHARS} THEN left(trim(text, ' '), {x.BLOCK_CHARS}) || '...[truncated]' ELSE trim(text, ' ') END) AS blocks_md5, observed_at FROM f_conv WHERE actor_type <> 'system' AND turn NOT IN (5, 6) AND turn % 4 <> 3""")
def _s15(t: Tables):
    e = x.parse_agent_lines(session_lines(t), "session")
    return e.select("event_id", "actor_type", "content_kind", F.md5("text").alias("text_md5"), F.md5("blocks_text").alias("blocks_md5"), "observed_at")


@query("S15_line_stats", "SELECT CASE WHEN turn = 5 THEN 'unparseable' WHEN actor_type = 'system' OR turn = 6 THEN 'skipped' WHEN turn % 4 = 3 THEN 'empty' ELSE 'kept' END AS status, count(*) AS lines FROM f_conv GROUP BY 1")
def _s15b(t: Tables):
    return x.agent_line_stats(session_lines(t), "session")


@query("S15_rollout_lines", f"""SELECT 'rollout:' || conversation_id || ':' || turn AS event_id, CASE WHEN turn % 4 < 2 AND actor_type = 'user' THEN 'user' ELSE 'assistant' END AS actor_type,
    CASE turn % 4 WHEN 2 THEN 'tool_use' WHEN 3 THEN 'tool_result' ELSE CASE WHEN actor_type = 'user' THEN 'user_turn' ELSE 'assistant_turn' END END AS content_kind,
    md5(CASE turn % 4 WHEN 2 THEN '[tool] shell' WHEN 3 THEN {_CUT} ELSE text END) AS text_md5 FROM f_conv WHERE actor_type <> 'system' OR turn % 4 >= 2""")
def _s15c(t: Tables):
    pl = F.expr("""named_struct('type', CASE turn % 4 WHEN 2 THEN 'function_call' WHEN 3 THEN 'function_call_output' ELSE 'message' END, 'role', CASE WHEN actor_type = 'system' THEN 'developer' ELSE actor_type END,
        'name', 'shell', 'output', text, 'content', array(named_struct('type', 'text', 'text', text)))""")
    line = F.to_json(F.struct(F.lit("response_item").alias("type"), F.col("turn").alias("ordinal"), F.col("observed_at").cast("string").alias("timestamp"), pl.alias("payload")))
    e = x.parse_agent_lines(t.f_conv.select("conversation_id", line.alias("line")), "rollout")
    return e.select("event_id", "actor_type", "content_kind", F.md5("text").alias("text_md5"))


@query("S15_step_lines", f"""SELECT 'steps:' || conversation_id || ':' || turn AS event_id, CASE WHEN actor_type = 'user' THEN 'user' ELSE 'assistant' END AS actor_type, md5(CASE WHEN actor_type = 'assistant' AND turn % 2 = 1 THEN {_CUT} ELSE text END) AS text_md5 FROM f_conv WHERE actor_type <> 'system'""")
def _s15d(t: Tables):
    line = F.expr("""to_json(named_struct('source', CASE actor_type WHEN 'user' THEN 'USER_EXPLICIT' WHEN 'assistant' THEN 'MODEL' ELSE 'SYSTEM' END,
        'type', CASE actor_type WHEN 'user' THEN 'USER_INPUT' ELSE CASE WHEN turn % 2 = 1 THEN 'GENERIC' ELSE 'PLANNER_RESPONSE' END END, 'step_index', turn, 'created_at', CAST(observed_at AS STRING), 'content', text))""")
    e = x.parse_agent_lines(t.f_conv.select("conversation_id", line.alias("line")), "steps")
    return e.select("event_id", "actor_type", F.md5("text").alias("text_md5"))


@query("S16_review_report", f"""WITH e AS (SELECT memory_id, count(*) AS n FROM f_evidence GROUP BY 1), s AS (SELECT *, reasoning_kind IN ({', '.join(q(k) for k in rules.STRONG_KINDS)}) AS strong FROM f_memory JOIN e USING (memory_id) WHERE approval_state = 'queued'),
    m AS (SELECT *, CASE WHEN strong AND n >= 3 THEN 'priority' WHEN (strong AND n = 2) OR (NOT strong AND n >= 5) THEN 'maybe' ELSE 'low' END AS label FROM s)
    SELECT memory_id, '- **' || label || '** · ' || reasoning_kind || ' · ' || n || ' turns · `' || memory_id || '`: ' || left(trim(statement), 160) AS line FROM m""")
def _s16(t: Tables):
    ev = t.f_evidence.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    rows = l.priority_order(t.f_memory.where("approval_state = 'queued'"), ev)
    return f.report_lines(rows).select("memory_id", "line")


@query("S18_read_projects", """SELECT 'export:project:p' || o_orderkey || ':' || strftime(o_orderdate, '%Y-%m-%d') AS event_id, 'Project ' || o_orderkey AS name, coalesce(CASE i WHEN 0 THEN 'a.md' WHEN 1 THEN 'b.md' END, '') AS filename, coalesce(CASE WHEN i IS NOT NULL THEN 'doc ' || o_custkey END, '') AS text
    FROM (SELECT *, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [0, 1] ELSE [NULL] END) AS i FROM orders)""")
def _s18(t: Tables):
    p = F.expr("""to_json(named_struct('uuid', 'p' || o_orderkey, 'name', 'Project ' || o_orderkey, 'updated_at', left(CAST(o_orderdate AS STRING), 10),
        'docs', CASE WHEN o_orderkey % 2 = 0 THEN array(named_struct('filename', 'a.md', 'content', 'doc ' || o_custkey), named_struct('filename', 'b.md', 'content', 'doc ' || o_custkey)) END))""")
    return x.read_projects(t.orders.select(p.alias("json"))).select("event_id", "name", F.coalesce("filename", F.lit("")).alias("filename"), F.coalesce("text", F.lit("")).alias("text"))


@query("S18_read_memories", """SELECT 'export:memory:conversations_memory:a' || c_custkey || ':S' AS event_id, 'conversations_memory' AS memory_kind, 'about ' || c_name AS text FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT 'export:memory:project:p' || c_custkey || ':S', 'project_memory', 'in ' || c_mktsegment FROM customer UNION ALL SELECT 'export:memory_file:f/' || c_custkey || ':S', 'memory_file', c_name FROM customer WHERE c_custkey % 3 = 0""")
def _s18b(t: Tables):
    m = F.expr("""to_json(named_struct('account_uuid', 'a' || c_custkey, 'conversations_memory', CASE WHEN c_custkey % 2 = 0 THEN ' about ' || c_name ELSE ' ' END, 'project_memories', map('p' || c_custkey, 'in ' || c_mktsegment),
        'memory_files', array(named_struct('path', CASE WHEN c_custkey % 3 = 0 THEN 'f/' || c_custkey END, 'content', c_name))))""")
    return x.read_memories(t.customer.select(m.alias("json")), "S").drop("scope")


# --- notes ------------------------------------------------------------------------------------


@query("J14_canonical_folders", """WITH e AS (SELECT regexp_replace(lower(p), '[^a-z0-9]', '', 'g') AS k, min(p) AS known FROM (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS p FROM part WHERE p_size < 20 AND p_partkey % 7 <> 0) GROUP BY 1),
    f AS (SELECT p_partkey, replace(p_name, ' ', '-') AS folder FROM part)
    SELECT p_partkey, coalesce(known, array_to_string(list_transform(string_split(folder, '-'), lambda w: upper(left(w, 1)) || substr(w, 2)), '-')) AS canonical FROM f LEFT JOIN e ON e.k = regexp_replace(lower(folder), '[^a-z0-9]', '', 'g')""")
def _j14(t: Tables):
    existing = t.part.where("p_size < 20 AND p_partkey % 7 <> 0").selectExpr("CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS folder").distinct()
    return n.canonical_folders(t.part.selectExpr("p_partkey", "replace(p_name, ' ', '-') AS folder"), existing).select("p_partkey", "canonical")


_LAST = "CASE WHEN strpos(reverse(w), reverse({s})) > 0 THEN 1000 + length(w) - strpos(reverse(w), reverse({s})) - length({s}) + 1 END"


@query("C14_split_to_room", f"""WITH RECURSIVE r AS (SELECT doc_id, -1 AS part_no, '' AS part, coalesce(text, '') AS rest FROM documents UNION ALL
      SELECT doc_id, part_no + 1, CASE WHEN length(rest) <= 2000 THEN regexp_replace(rest, '\\s+$', '') ELSE regexp_replace(left(rest, p), '\\s+$', '') END, CASE WHEN length(rest) <= 2000 THEN '' ELSE regexp_replace(substr(rest, p + 1), '^\\s+', '') END
      FROM (SELECT doc_id, part_no, rest, coalesce({_LAST.format(s="(chr(10) || chr(10))")}, {_LAST.format(s="chr(10)")}, {_LAST.format(s="' '")}, 2000) AS p FROM (SELECT *, substr(rest, 1001, 1000) AS w FROM r)) WHERE rest <> '')
    SELECT doc_id, part_no, part FROM r WHERE part_no >= 0 UNION ALL SELECT doc_id, 0, '' FROM documents WHERE coalesce(text, '') = ''""")
def _c14(t: Tables):
    return t.documents.select("doc_id", F.posexplode(tx.split_to_room(F.col("text"), 2000)).alias("part_no", "part"))


STACKED = "CASE page_id % 3 WHEN 0 THEN text || chr(10) || replace(text, 'the', 'thus') WHEN 1 THEN text || chr(10) || text || chr(10) || 'moved' || text ELSE text END"


def page_text(t: Tables):
    """Pages as Markdown under their number."""
    return pages(t).withColumn("page_id", F.regexp_extract("path", r"(\d+)", 1).cast("bigint")).select("page_id", "text")


@query("C12_collapse_stacks", f"""WITH pg AS (SELECT page_id, {_MD} AS text FROM pages), st AS (SELECT page_id, string_split({STACKED}, chr(10)) AS l FROM pg),
    h AS (SELECT page_id, l, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '^#\\s+.*\\S\\s*$')) AS tops FROM st),
    k AS (SELECT page_id, l, list_filter(tops, lambda i: trim(regexp_replace(lower(l[i]), '\\s+', ' ', 'g'), ' ') = trim(regexp_replace(lower(l[tops[1]]), '\\s+', ' ', 'g'), ' ')) AS same FROM h)
    SELECT page_id, md5(array_to_string(CASE WHEN len(same) > 1 THEN l[same[-1]:] ELSE l END, chr(10))) AS text_md5, len(same) > 1 AS collapsed FROM k""")
def _c12(t: Tables):
    stacked = page_text(t).selectExpr("page_id", f"{STACKED} AS text")
    return rev.collapse_stacks(stacked, "page_id").select("page_id", F.md5("text").alias("text_md5"), "collapsed")


def additions(t: Tables):
    """Pages written again: as they are, with much more in each section, with a word more."""
    more = "replace(text, '\\n## ', concat(' ', repeat('quite other words ', 60), '\\n## '))"
    return page_text(t).selectExpr("page_id", f"CASE page_id % 3 WHEN 0 THEN text WHEN 1 THEN {more} ELSE replace(text, '\\n## ', ' again\\n## ') || '\\n## new\\nonce\\n## new\\nonce' END AS text")


@query("C12_restated_sections")
def _c12b(t: Tables):
    return rev.restated_sections(additions(t), page_text(t), "page_id")


@query("G19_seed_contains", f"WITH {SECT} SELECT DISTINCT parent_id AS src, section_id AS dst FROM sections WHERE parent_id IS NOT NULL")
def _g19(t: Tables):
    return _seed(t)["contains"]


@query("G19_seed_references", f"WITH {_RES} SELECT DISTINCT from_path AS src, resolved AS dst FROM rs WHERE resolved IS NOT NULL AND resolved <> from_path")
def _g19b(t: Tables):
    notes = t.f_docs.select("path", F.lit("s").alias("section_id"), F.lit("h").alias("heading_clean"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent_id"))
    return g.seed_tables(notes, n.resolve_links(links(t), t.f_docs))["references"]


def _seed(t: Tables):
    return g.seed_tables(n.parse_sections(pages(t)), n.resolve_links(links(t), t.f_docs))

"""Adaptors from the given tables to the shapes the operators take.

Each adaptor is one deterministic projection, written once in SQL both Spark and DuckDB
read; ``@NAME(...)@`` marks the few spots where the two dialects differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from memlake.session import plan_size

RAW = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_SPARK = {
    "TS": lambda a: f"TIMESTAMP_NTZ '{a}'",
    "UPTO": lambda a: f"explode(sequence(0, CAST({a} AS INT)))",
    "IDIV": lambda a: "CAST(({}) DIV ({}) AS BIGINT)".format(*a.split(";")),
    "GREPL": lambda a: "regexp_replace({}, {}, {})".format(*a.split(";")),
    "LPAD": lambda a: "lpad(CAST({} AS STRING), {}, '0')".format(*a.split(";")),
    "RX": lambda a: "regexp_extract({}, {}, {})".format(*a.replace("\\", "\\\\").split(";")),
    "VMIX": lambda a: "zip_with({}, {}, (x, y) -> CAST(x AS DOUBLE) + ({}) * CAST(y AS DOUBLE))".format(*a.split(";")),
}
_DUCK = {
    "TS": lambda a: f"TIMESTAMP '{a}'",
    "UPTO": lambda a: f"unnest(range(0, CAST({a} AS BIGINT) + 1))",
    "IDIV": lambda a: "CAST(({}) // ({}) AS BIGINT)".format(*a.split(";")),
    "GREPL": lambda a: "regexp_replace({}, {}, {}, 'g')".format(*a.split(";")),
    "LPAD": lambda a: "lpad(CAST({} AS VARCHAR), {}, '0')".format(*a.split(";")),
    "RX": lambda a: "regexp_extract({}, {}, {})".format(*a.split(";")),
    "VMIX": lambda a: "list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::DOUBLE + ({2}) * {1}[i]::DOUBLE)".format(*a.split(";")),
}

VIEWS: dict[str, str] = {
    # --- journal of source events -------------------------------------------------
    "f_events": """
        SELECT event_id, user_id AS conversation_id, ts AS observed_at, event_type, props,
               'src' || CAST(event_id % 4 AS STRING) AS harness,
               CASE WHEN event_id % 5 <= 2 THEN 'user' WHEN event_id % 5 = 3 THEN 'assistant' ELSE 'tool' END AS actor_type,
               CASE event_id % 20 WHEN 0 THEN 'excluded' WHEN 1 THEN 'redacted' WHEN 2 THEN 'summarized' ELSE 'raw' END AS retention_class,
               CASE WHEN event_id % 7 = 0 THEN 'connector' ELSE 'live' END AS via,
               event_id % 10 = 0 AS reconstructed,
               '{"provenance_reconstructed":' || CASE WHEN event_id % 10 = 0 THEN 'true' ELSE 'false' END
                 || ',"via":"' || CASE WHEN event_id % 7 = 0 THEN 'connector' ELSE 'live' END
                 || '","client_version":"1.' || CAST(event_id % 3 AS STRING) || '"}' AS metadata,
               '{"text":"value ' || CAST(CAST(round(value * 100) AS BIGINT) AS STRING)
                 || CASE WHEN event_id % 11 = 0 THEN ' key sk-ABCDEFGHIJKLMNOPQRSTUVWX end' ELSE '' END
                 || '","api_key":"k' || CAST(event_id % 13 AS STRING)
                 || '","props":' || props || '}' AS content
        FROM events""",
    # --- conversation turns with injected cues -----------------------------------
    "f_conv": """
        SELECT 'c' || CAST(conv_id AS STRING) || ':' || CAST(turn AS STRING) AS event_id,
               conv_id AS conversation_id, turn, role AS actor_type,
               'src' || CAST(conv_id % 4 AS STRING) AS harness,
               @TS(2024-01-01 00:00:00)@ + (conv_id * 60 + turn * 7
                 + CASE WHEN conv_id % 3 = 0 AND turn >= 4 THEN 180 ELSE 0 END) * INTERVAL '1' MINUTE AS observed_at,
               (conv_id * 31 + turn) % 10 = 0 AS reconstructed,
               CASE WHEN (conv_id * 31 + turn) % 11 = 0 THEN 'Okay, now something different. ' ELSE '' END
               || text
               || CASE WHEN (conv_id * 31 + turn) % 5 = 0 THEN ' Should we change this?' ELSE '' END
               || CASE WHEN (conv_id * 31 + turn) % 7 = 0 THEN
                    CASE (conv_id + turn) % 6
                      WHEN 0 THEN ' We decided to use the second plan on 2024-03-05.'
                      WHEN 1 THEN ' We chose the first plan on March 15, 2023.'
                      WHEN 2 THEN ' It was fixed on 7 June 2022 by the team.'
                      WHEN 3 THEN ' We switched tools in March 2021.'
                      WHEN 4 THEN ' I migrated the archive since 2019 and 2024-02-31 is no date.'
                      ELSE ' We decided yesterday to stop.' END
                  ELSE '' END
               || CASE WHEN (conv_id * 31 + turn) % 13 = 0 THEN ' The licence is valid through December 2026.' ELSE '' END
               || CASE WHEN (conv_id * 31 + turn) % 9 = 0 THEN ' Traceback in /usr/local/lib/app.py again.' ELSE '' END
               || CASE WHEN (conv_id * 31 + turn) % 8 = 0 THEN ' I prefer the short form.' ELSE '' END
               || CASE WHEN (conv_id * 31 + turn) % 12 = 0 THEN ' Actually, it is for my friend.' ELSE '' END AS text
        FROM conversations""",
    # --- documents and queries ------------------------------------------------------
    "f_docs": """
        SELECT doc_id, text, source, lang,
               source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.md' AS path,
               CAST(doc_id AS STRING) || '.md' AS filename, source AS area, '.md' AS extension,
               @TS(2024-01-01 00:00:00)@ + doc_id * INTERVAL '1' MINUTE AS observed_at,
               CASE doc_id % 3 WHEN 0 THEN 'wiki' WHEN 1 THEN 'mail' ELSE 'memory' END AS provider
        FROM documents""",
    "f_query": """
        SELECT item_id AS query_id, text AS query FROM benchmark""",
    # --- temporal graph ---------------------------------------------------------------
    "f_episode": """
        SELECT o_orderkey AS episode_id, 'ep-' || CAST(o_orderkey AS STRING) AS name, o_orderdate AS valid_at,
               o_orderpriority AS project, o_orderdate + INTERVAL '1' DAY AS created_at,
               'reasoning_kind=' || CASE o_orderkey % 3 WHEN 0 THEN 'decision' WHEN 1 THEN 'plan' ELSE 'insight' END
                 || ' project=' || o_orderpriority || ' evidence=' || CAST(o_orderkey % 5 + 1 AS STRING)
                 || ' turn(s) memory_id=m' || CAST(o_orderkey AS STRING) AS source_description
        FROM orders""",
    # Every part, and for each tenth one an entity that no note or fact holds.
    "f_entity": """
        SELECT CASE WHEN lonely = 1 THEN p_partkey + 10000000 ELSE p_partkey END AS entity_id,
               CASE p_partkey % 9
                 WHEN 0 THEN CASE p_partkey % 5 WHEN 0 THEN 'run_' || p_type || '.py' WHEN 1 THEN 'HEAD_' || upper(p_type)
                   WHEN 2 THEN CAST(p_size AS STRING) || ' layers' WHEN 3 THEN 'phase ' || CAST(p_size % 9 AS STRING) ELSE 'drawSegment' END
                 ELSE CASE p_partkey % 7 WHEN 1 THEN upper(p_name) WHEN 2 THEN @GREPL(p_name;' ';'-')@ WHEN 3 THEN p_name || 's'
                        ELSE p_name END || ' ' || CAST(p_partkey % 40 + 40 * lonely AS STRING) END AS name,
               CASE WHEN p_partkey % 4 = 0 THEN 'wiki' ELSE 'memory' END AS origin,
               CASE p_partkey % 6 WHEN 0 THEN 'Software' WHEN 1 THEN 'Person' WHEN 2 THEN 'Place' ELSE 'Thing' END AS entity_type,
               @TS(2023-01-01 00:00:00)@ + (p_partkey * 37 % 5000) * INTERVAL '1' HOUR AS created_at
        FROM (SELECT *, 0 AS lonely FROM part UNION ALL SELECT *, 1 AS lonely FROM part WHERE p_partkey % 10 = 0) p""",
    # A vector for each name: six in a row lean on one given vector, more or less.
    "f_name_vector": """
        SELECT n.name, @VMIX(x.embedding;y.embedding;n.w)@ AS vector
        FROM (SELECT name, @IDIV(e;6)@ % (SELECT count(*) FROM embeddings) AS i, (e * 7 + 13) % (SELECT count(*) FROM embeddings) AS j,
                CAST(CASE e % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 0.2 WHEN 2 THEN 0.28 WHEN 3 THEN 0.34 WHEN 4 THEN 0.45 ELSE 0.0 END AS DOUBLE) AS w
              FROM (SELECT name, min(entity_id) % 10000000 AS e FROM f_entity GROUP BY name) m) n
        JOIN embeddings x ON x.vec_id = n.i JOIN embeddings y ON y.vec_id = n.j""",
    "f_mention": """
        SELECT DISTINCT l_orderkey AS episode_id, l_partkey AS entity_id FROM lineitem
        UNION ALL SELECT DISTINCT l_orderkey, l_partkey + 10000000 FROM lineitem WHERE l_partkey % 20 = 10 AND l_orderkey % 97 = 1""",
    "f_note": """
        SELECT s_suppkey AS note_id, 'notes/' || CAST(s_nationkey AS STRING) || '/' || s_name || '.md' AS path FROM supplier""",
    "f_dated_note": """
        SELECT s_suppkey AS note_id, 'notes/' || CAST(s_nationkey AS STRING) || '/' || s_name || '.md' AS path, @TS(1998-06-01 00:00:00)@ + (s_suppkey * 37 % 700) * INTERVAL '1' DAY AS created_at FROM supplier""",
    # Promotions of the memories that the episodes name, tried once or twice, some into another graph.
    "f_episode_promotion": """
        SELECT 'm' || CAST(o_orderkey AS STRING) AS memory_id, CASE WHEN o_orderkey % 11 = 0 THEN 'scratch' ELSE 'main' END AS graph_name,
               CASE WHEN (o_orderkey + n) % 7 = 0 THEN 'failed' ELSE 'succeeded' END AS status, o_orderdate + (o_orderkey % 300 + 40 * n) * INTERVAL '1' DAY AS promoted_at
        FROM (SELECT *, @UPTO(o_orderkey % 2)@ AS n FROM orders WHERE o_orderkey % 5 <> 0) x""",
    "f_note_mention": """
        SELECT DISTINCT l_suppkey AS note_id, l_partkey AS entity_id FROM lineitem""",
    "f_fact_episode": """
        SELECT DISTINCT CAST(l_suppkey AS STRING) || '>' || CAST(l_partkey AS STRING) || '@' || substr(CAST(l_shipdate AS STRING), 1, 10) AS fact_id,
               l_orderkey AS episode_id
        FROM lineitem""",
    "f_fact": """
        SELECT fact_id, source_id, target_id, fact, valid_at,
               CASE WHEN min_order % 2 = 0 THEN lead(valid_at) OVER (PARTITION BY source_id, target_id ORDER BY valid_at) END AS invalid_at
        FROM (
          SELECT CAST(l_suppkey AS STRING) || '>' || CAST(l_partkey AS STRING) || '@' || substr(CAST(l_shipdate AS STRING), 1, 10) AS fact_id,
                 l_suppkey AS source_id, l_partkey AS target_id,
                 'supplier ' || CAST(l_suppkey AS STRING) || ' ships part ' || CAST(l_partkey AS STRING) AS fact,
                 min(l_shipdate) AS valid_at, min(l_orderkey) AS min_order
          FROM lineitem
          GROUP BY l_suppkey, l_partkey, substr(CAST(l_shipdate AS STRING), 1, 10)) g""",
    # --- derived memories and the review ledger ----------------------------------------
    "f_memory": """
        SELECT CAST(event_id AS STRING) || '::heuristic@1.' || CAST(v AS STRING) AS memory_id, event_id, v,
               '1.' || CAST(v AS STRING) AS policy_version, conversation_id, harness, observed_at,
               CASE WHEN event_id % 10 <= 2 THEN 'episodic' WHEN event_id % 10 <= 5 THEN 'durable_candidate'
                    WHEN event_id % 10 <= 7 THEN 'ambiguous' ELSE 'non_memory' END AS category,
               CASE event_id % 8 WHEN 0 THEN 'decision' WHEN 1 THEN 'plan' WHEN 2 THEN 'retrospective' WHEN 3 THEN 'rejected_alternative'
                    WHEN 4 THEN 'insight' WHEN 5 THEN 'question' WHEN 6 THEN 'diagnosis' ELSE 'preference' END AS reasoning_kind,
               CASE (event_id + v) % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' WHEN 3 THEN 'superseded' ELSE 'auto_accepted' END AS approval_state,
               CAST(event_id % 100 AS DOUBLE) / 100 AS confidence,
               'thread-' || CAST(conversation_id % 37 AS STRING) AS thread_key,
               CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'proj-' || CAST(conversation_id % 5 AS STRING) END AS project,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE observed_at - (event_id % 30) * INTERVAL '1' DAY END AS event_date,
               CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'exact' WHEN 2 THEN 'day' ELSE 'month' END AS date_precision,
               'Memory ' || CAST(event_id AS STRING) || ' about ' || event_type AS statement,
               'Q: what about ' || event_type || '? | why: value seen | alt: wait ' || CAST(event_id % 3 AS STRING)
                 || ' | status: ' || CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' ELSE 'stalled' END
                 || ' | thread: thread-' || CAST(conversation_id % 37 AS STRING) AS reason,
               CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' ELSE 'stalled' END AS status,
               observed_at + (v + 1) * INTERVAL '1' HOUR AS created_at
        FROM (SELECT *, @UPTO(event_id % 3)@ AS v FROM f_events) x""",
    "f_evidence": """
        SELECT memory_id, event_id + pos AS event_id, pos
        FROM (SELECT memory_id, event_id, @UPTO(event_id % 6)@ AS pos FROM f_memory) x""",
    "f_audit": """
        SELECT event_id * 10 + v * 3 + n AS audit_id, memory_id,
               created_at + (n + 1) * INTERVAL '1' HOUR AS at,
               CASE n WHEN 0 THEN 'queued' WHEN 1 THEN 'approved' ELSE 'rejected' END AS prior_state,
               CASE n WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'approved' END AS new_state,
               'batch-' || CAST((event_id + n) % 7 AS STRING) AS batch_id,
               CASE WHEN n = 1 THEN 'human' ELSE 'bulk' END AS actor
        FROM (SELECT *, @UPTO(event_id % 3)@ AS n FROM f_memory WHERE event_id % 4 <> 3) x""",
    "f_promotion": """
        SELECT memory_id, event_id, 'main' AS graph_name, CASE WHEN event_id % 9 = 0 THEN 'failed' ELSE 'succeeded' END AS status,
               created_at + INTERVAL '2' HOUR AS promoted_at, conversation_id, harness, project
        FROM f_memory WHERE approval_state IN ('approved', 'auto_accepted') AND event_id % 3 <> 1
        UNION ALL
        SELECT 'gone-' || CAST(event_id AS STRING), event_id, 'main', 'succeeded', observed_at, conversation_id, harness, NULL
        FROM f_events WHERE event_id % 97 = 0""",
    "f_job": """
        SELECT CAST(event_id AS STRING) || '::heuristic@1.0' AS job_id, event_id, conversation_id, 'heuristic' AS policy, '1.0' AS policy_version,
               CASE WHEN event_id % 9 = 0 THEN 'failed' ELSE 'succeeded' END AS status, 1 + event_id % 3 AS attempts
        FROM f_events WHERE event_id % 5 <> 2 AND conversation_id % 7 <> 3""",
    # --- evaluation -----------------------------------------------------------------
    "f_snapshot": """
        SELECT 'early' AS snapshot, @TS(2024-01-01 04:00:00)@ AS as_of
        UNION ALL SELECT 'middle', @TS(2024-01-01 12:00:00)@
        UNION ALL SELECT 'now', @TS(2034-01-01 00:00:00)@""",
}


def _render(sql: str, dialect: dict) -> str:
    return re.sub(r"@([A-Z]+)\((.*?)\)@", lambda m: dialect[m.group(1)](m.group(2)), sql, flags=re.S)


def _needed(text: str, names) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", text))
    return [n for n in names if n in words]


def _closure(text: str) -> list[str]:
    """View names the text needs, dependencies first."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in out:
            return
        for dep in _needed(VIEWS[name], VIEWS):
            if dep != name:
                visit(dep)
        out.append(name)

    for name in _needed(text, VIEWS):
        visit(name)
    return out


def duckdb_ctes(body: str) -> str:
    return ",\n".join(f"{n} AS ({_render(VIEWS[n], _DUCK)})" for n in _closure(body))


TEXT_TABLES = ("documents", "conversations", "pages")
SPLIT_BYTES = 128 * 1024 * 1024


def _few_splits(spark: SparkSession, path: str) -> int:
    """Slots to spread a table over when its files give fewer splits than there are slots,
    else 0. A text table in one row group would otherwise be tokenised by one task; at scale
    the files split by themselves and nothing is moved."""
    slots = spark.sparkContext.defaultParallelism
    return slots if plan_size(spark.read.parquet(path)) < slots * SPLIT_BYTES else 0


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or an adaptor view over the given tables."""
    if name in RAW:
        path = f"{sf_dir}/{name}.parquet"
        n = _few_splits(spark, path) if name in TEXT_TABLES else 0
        return spark.read.parquet(path).repartition(n) if n else spark.read.parquet(path)
    if name not in VIEWS:
        raise AttributeError(name)
    names = _closure(name)
    text = " ".join(VIEWS[n] for n in names)
    ctes = []
    for r in (r for r in RAW if re.search(rf"\bFROM {r}\b", text)):
        path = f"{sf_dir}/{r}.parquet"
        n = _few_splits(spark, path) if r in TEXT_TABLES else 0
        ctes.append(f"{r} AS (SELECT {f'/*+ REPARTITION({n}) */' if n else ''} * FROM parquet.`{path}`)")
    ctes += [f"{n} AS ({_render(VIEWS[n], _SPARK)})" for n in names]
    return spark.sql("WITH " + ",\n".join(ctes) + f"\nSELECT * FROM {name}")

"""Graph invariants and the duplicate-pair contract."""

import random

from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.operators import graph as g


def norm(spark, *names):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    return [r.k for r in df.select("i", tx.normalize_entity(F.col("n")).alias("k")).orderBy("i").collect()]


def test_normalised_names(spark):
    a = norm(spark, "GitHub", "Github", "LM Studio", "LMStudio", "Cityscapes", "cityscape", "Batteries", "battery", "Glass", "Gla", "HTTPS", "HTTP")
    assert a[0] == a[1] and a[2] == a[3] and a[4] == a[5] and a[6] == a[7] and a[8] != a[9] and a[10] != a[11]


def flags(spark, fn, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    return [r.f for r in df.select("i", fn(F.col("a"), F.col("b")).alias("f")).orderBy("i").collect()]


def test_acronyms_and_containment(spark):
    assert flags(spark, tx.is_acronym, [("MCP", "Model Context Protocol"), ("EVCS", "Electric Vehicle Charging Station"), ("MCP", "MCP server"), ("M", "Mac")]) == [True, True, False, False]
    assert flags(spark, tx.is_contained, [("Alex", "Alex Morgan"), ("Spark", "NVIDIA Spark"), ("Alex Morgan", "Alex"), ("the", "the big thing")]) == [True, True, False, False]


def test_pair_tiers(spark):
    ents = spark.createDataFrame(
        [(1, "GitHub Pages", "tool"), (2, "Github pages", "tool"), (3, "MCP", "technique"), (4, "Model Context Protocol", "technique"),
         (5, "Alex", "person"), (6, "Alex Morgan", "person"), (7, "AI", "tool"), (8, "Associative Insights", "tool"), (9, "Obsidian", "tool")],
        "entity_id int, name string, entity_type string")
    p = g.name_pairs(ents)
    kinds = ents.groupBy("name").agg(F.min("entity_type").alias("k"))
    p = p.join(kinds.select(F.col("name").alias("a"), F.col("k").alias("ka")), "a").join(kinds.select(F.col("name").alias("b"), F.col("k").alias("kb")), "b")
    got = {(r.a, r.b): r.tier for r in g.tier_pairs(p.withColumn("sim", F.lit(0.85))).collect()}
    assert got == {("GitHub Pages", "Github pages"): "auto", ("MCP", "Model Context Protocol"): "review", ("Alex", "Alex Morgan"): "review", ("AI", "Associative Insights"): "weak"}


def test_versions_never_pair(spark):
    pairs = [("Solar Panel 4.5", "Solar Panel 4.6"), ("Condo 12A", "Condo 12B"), ("Cat6a cables", "Cat6a cable")]
    assert flags(spark, g.version_conflict, pairs) == [True, True, False]


TIERS = [
    ("GitHub", "Github", None, None, 0.99, {}, "auto"), ("Cityscape", "Cityscapes", "domain", "project", 0.95, {}, "review"), ("levels", "Level", None, "product", 0.9, {}, "review"),
    ("Cat6a cables", "Cat6a cable", "product", "product", 0.9, {}, "auto"), ("Condo 12A", "Condo 12B", "place", "place", 0.95, {}, "never-version"),
    ("Claude", "Claude Code", None, None, 0.95, {"families": [["Claude", "Claude Code"]]}, "never-family"),
    ("Gemini Flash", "Gemini Pro", None, None, 0.96, {"keep": ["Gemini Flash", "Gemini Pro"]}, "never-gold-keep"), ("Gemini Flash", "Gemini Pro", None, None, 0.96, {"keep": ["Gemini Pro"]}, "review"),
    ("Spark", "NVIDIA Spark", None, None, 0.80, {"keep": ["Spark", "NVIDIA Spark"]}, "review"), ("Claude Sonnet 4.5", "Claude Sonnet 4.6", "model", "model", 0.97, {}, "never-version"),
    ("docs", "Google Docs", None, None, 0.85, {}, None), ("John", "John Cramer", "person", "person", 0.5, {"persons": ["John Cramer"], "ambiguous": ["john"]}, "weak"),
    ("CMF_MCP_AUTH_TOKEN", "CMF_MCP_AUTH_HEADER", None, None, 0.95, {}, "weak"), ("MCP", "MCP server", None, None, 0.70, {}, None), ("MCP", "MCP tool", None, None, 0.87, {}, "weak"),
    ("Alex", "Alex Morgan", None, None, 0.40, {"persons": ["Alex Morgan"]}, "review"), ("Charles", "Charles Howell", None, "person", 0.40, {}, "review"), ("Alex", "Alex Morgan", None, None, 0.40, {}, None),
    ("CTM", "CTM Legal Group", None, "org", 0.83, {}, "review"), ("Docker", "Docker Desktop", None, None, 0.89, {}, "weak"), ("Jacobian lens", "J-lens", None, None, 0.93, {}, "review"),
    ("Obsidian", "Notion", None, None, 0.80, {}, None), ("Chicago", "Chicago Bears", "place", "org", 0.95, {}, None), ("AI", "Associative Insights", None, "product", 0.5, {}, "weak"),
    ("CCC", "Cisco Cloud Control", None, "product", 0.5, {"ambiguous": ["CCC"]}, "weak"), ("MCP", "Model Context Protocol", None, "tool", 0.42, {}, "review")]


def test_tier_contract(spark):
    """Each case is two names with the cosine of their vectors; those of one configuration together."""
    rows = [(i, a, b, ka, kb, float(sim)) for i, (a, b, ka, kb, sim, _, _) in enumerate(TIERS)]
    df = spark.createDataFrame(rows, "i int, a string, b string, ka string, kb string, sim double")
    a, b = F.col("a"), F.col("b")
    rule = F.when(tx.normalize_entity(a) == tx.normalize_entity(b), "normalized").when(tx.is_acronym(a, b), "acronym").when(tx.is_contained(a, b), "containment").otherwise("embedding")
    df = df.withColumn("rule", rule).coalesce(1).cache()
    for config in {str(c[5]): c[5] for c in TIERS}.values():
        mine = [i for i, c in enumerate(TIERS) if c[5] == config]
        got = {r.i: r.tier for r in g.tier_pairs(df.where(F.col("i").isin(mine)), **config).collect()}
        assert got == {i: TIERS[i][6] for i in mine if TIERS[i][6]}, config


def test_name_pairs_meet_their_vectors(spark):
    ents = spark.createDataFrame([(1, "MCP", None), (2, "Model Context Protocol", "tool"), (3, "Obsidian", None), (4, "Notion", None)], "entity_id int, name string, entity_type string")
    vectors = spark.createDataFrame([("MCP", [1.0, 0.0]), ("Obsidian", [0.6, 0.8]), ("Notion", [0.64, 0.77])], "name string, vector array<double>")
    got = {(r.a, r.b, r.rule): r.sim for r in g.with_vectors(g.name_pairs(ents), vectors).collect()}
    assert got[("MCP", "Model Context Protocol", "acronym")] is None and got[("Notion", "Obsidian", "embedding")] > 0.99 and len(got) == 2


def test_components_on_random_graph_and_long_chain(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1400)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for x in parent}
    got = {r.id: r.component for r in g.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_merge_keeps_every_fact(spark, tables):
    mapping = g.duplicate_groups(tables.f_entity)
    mentions, facts = g.merge_entities(mapping, tables.f_mention, tables.f_fact)
    assert facts.count() == tables.f_fact.count()
    dropped = mapping.where("entity_id <> canonical_id").select("entity_id")
    assert mentions.join(dropped, "entity_id", "left_semi").isEmpty()
    assert mentions.count() == mentions.distinct().count()


def test_snapshot_has_no_future(spark, tables):
    as_of = F.lit("1998-01-01").cast("timestamp_ntz")
    ep = g.availability(tables.f_episode, tables.f_promotion)
    s = g.snapshot(ep, tables.f_mention, tables.f_fact, tables.f_fact_episode, as_of)
    late = ep.where(F.col("available_at") > as_of).select("episode_id")
    assert s["mentions"].join(late, "episode_id", "left_semi").isEmpty()
    assert s["fact_episodes"].join(late, "episode_id", "left_semi").isEmpty()
    cited = s["fact_episodes"].select("fact_id").distinct()
    assert s["facts"].join(cited, "fact_id", "left_anti").isEmpty()


def test_as_of_join_with_text_values(spark):
    moments = spark.createDataFrame([(1, "2024-01-02", 7), (1, "2024-01-01", 8), (2, "2024-01-05", 9)], "k int, at string, n int").withColumn("at", F.col("at").cast("timestamp_ntz"))
    line = spark.createDataFrame([(1, "2024-01-02", "b"), (1, "2024-01-02", "a"), (2, "2023-01-01", "é")], "k int, at string, id string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    assert {r.n: r.id for r in g.newest_at(moments, line, ["k"], "at", "id").collect()} == {7: "b", 8: None, 9: "é"}


def test_notes_by_the_paths_of_the_time(spark):
    notes = spark.createDataFrame([(1, "a.md"), (2, "b.md"), (3, "c.md")], "note_id int, path string").withColumn("created_at", F.lit("2020-01-01").cast("timestamp_ntz"))
    held = spark.createDataFrame([(1, 10), (2, 10), (2, 20), (2, 30), (3, 40)], "note_id int, entity_id int")
    mentions = spark.createDataFrame([(5, 30)], "episode_id int, entity_id int")
    facts = spark.createDataFrame([("f", 40, 50)], "fact_id string, source_id int, target_id int")
    paths = spark.createDataFrame([("a.md",)], "path string")
    r = g.prune_notes(notes, held, mentions, facts, F.lit("2030-01-01").cast("timestamp_ntz"), paths)
    assert {x.note_id for x in r["removed_notes"].collect()} == {2, 3} and {x.entity_id for x in r["removed_entities"].collect()} == {20}
    assert g.prune_notes(notes, held, mentions, facts, F.lit("2030-01-01").cast("timestamp_ntz"))["removed_notes"].count() == 0

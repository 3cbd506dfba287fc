"""Retrieval evaluation as of past moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memlake.operators.scan import top_k
from memlake.session import broadcast_if_small, cut_lineage


def effective_gold(gold: DataFrame, updates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(snapshot, case_id, name): base gold with the updates in force at each cut-off.

    Updates (case_id, update_no, from_at, op, name) apply in order, adds before retires; the
    last operation on a name decides. Snapshots are a handful of rows held as one array.
    """
    snaps = snapshots.agg(F.sort_array(F.collect_list(F.struct("as_of", "snapshot")))).scalar()
    base = gold.select("case_id", "name", F.lit(-1).alias("update_no"), F.lit("add").alias("op"), F.lit(None).cast("timestamp_ntz").alias("from_at"))
    ops = base.unionByName(updates.select("case_id", "name", "update_no", "op", "from_at"))
    at = ops.withColumn("s", F.explode(snaps)).where(F.col("from_at").isNull() | (F.col("from_at") <= F.col("s.as_of")))
    last = at.groupBy(F.col("s.snapshot").alias("snapshot"), "case_id", "name").agg(
        F.max_by("op", F.struct("update_no", F.when(F.col("op") == "retire", 1).otherwise(0))).alias("op"))
    return last.where("op = 'add'").select("snapshot", "case_id", "name")


def grade(cases: DataFrame, results: DataFrame, gold: DataFrame, promoted_at: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One grade per (snapshot, policy, case).

    ``results``: snapshot, policy, case_id, rank, name (null without provenance), invalid_at.
    A result is a temporal leak when its name only became available after the cut-off.
    """
    r = results.join(promoted_at, "name", "left").join(broadcast_if_small(snapshots), "snapshot")
    r = r.join(gold.withColumn("is_gold", F.lit(True)), ["snapshot", "case_id", "name"], "left")
    per = r.groupBy("snapshot", "policy", "case_id").agg(
        F.min(F.when(F.col("is_gold"), F.col("rank"))).alias("gold_rank"), F.count_if(F.col("promoted_at") > F.col("as_of")).alias("leaks"),
        (F.count("name") / F.count(F.lit(1))).alias("provenance_rate"), F.count_if(F.col("invalid_at").isNotNull()).alias("superseded"), F.count(F.lit(1)).alias("results"))
    g = gold.join(promoted_at, "name", "left").join(broadcast_if_small(snapshots), "snapshot").groupBy("snapshot", "case_id").agg(
        F.lit(True).alias("has_gold"), F.bool_or(F.coalesce(F.col("promoted_at") <= F.col("as_of"), F.lit(False))).alias("available"))
    frame = _case_arms(cases, results)
    j = frame.join(per, ["snapshot", "policy", "case_id"], "left").join(g, ["snapshot", "case_id"], "left")
    has, avail = F.coalesce("has_gold", F.lit(False)), F.coalesce("available", F.lit(False))
    return j.select(
        "snapshot", "policy", "case_id", "gold_rank", avail.alias("gold_available"),
        F.when(has & ~avail, F.col("gold_rank").isNull()).alias("abstained_correctly"), F.coalesce("leaks", F.lit(0)).alias("leaks"),
        F.coalesce("provenance_rate", F.lit(1.0)).alias("provenance_rate"), F.coalesce("superseded", F.lit(0)).alias("superseded"), F.coalesce("results", F.lit(0)).alias("results"))


def _case_arms(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Every case under every (snapshot, policy) arm; the arms ride along as one array."""
    arms = results.agg(F.sort_array(F.collect_set(F.struct("snapshot", "policy")))).scalar()
    return cases.select("case_id", F.explode(arms).alias("a")).select("a.snapshot", "a.policy", "case_id")


def summarize(grades: DataFrame, k: int) -> DataFrame:
    """hit@k, MRR, abstention and leaks per snapshot and policy."""
    ok, un = F.col("gold_available"), F.col("abstained_correctly").isNotNull()
    hit = ok & (F.col("gold_rank") <= k)
    return grades.groupBy("snapshot", "policy").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(ok).alias("answerable"), (F.count_if(hit) / F.nullif(F.count_if(ok), F.lit(0))).alias("hit_at_k"),
        (F.coalesce(F.sum(F.when(ok, 1.0 / F.col("gold_rank"))), F.lit(0.0)) / F.nullif(F.count_if(ok), F.lit(0))).alias("mrr"),
        (F.count_if(F.col("abstained_correctly")) / F.nullif(F.count_if(un), F.lit(0))).alias("abstention"), F.sum("leaks").alias("leaks"),
        F.avg("provenance_rate").alias("provenance_rate"), F.sum("superseded").alias("superseded"))


def apply_policies(ranked: DataFrame, policies: DataFrame) -> DataFrame:
    """Rankings of several retrieval policies (policy, k, min_score) from one scored pool.
    Policies are configuration rows held as one array, so the pool is read once."""
    ps = policies.agg(F.sort_array(F.collect_list(F.struct("policy", "k", "min_score")))).scalar()
    x = ranked.withColumn("p", F.explode(ps)).where((F.col("rank") <= F.col("p.k")) & (F.col("score") >= F.col("p.min_score")))
    return x.withColumn("policy", F.col("p.policy")).drop("p")


def judge_scores(rows: DataFrame) -> DataFrame:
    """Agreement of a judge with final verdicts, per item type and in all (type, final, judge)."""
    r = rows.where(F.col("final").isNotNull())
    g = r.groupingSets([[], [F.col("item_type")]], F.col("item_type")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("final").isin("approve", "reject")).alias("decided"),
        F.count_if(F.col("final").isin("approve", "reject") & (F.col("judge") == F.col("final"))).alias("agreed"),
        F.count_if((F.col("judge") == "approve") & (F.col("final") != "approve")).alias("false_approve"),
        F.count_if(F.coalesce(F.col("judge") != "approve", F.lit(True)) & (F.col("final") == "approve")).alias("missed"),
        F.count_if(F.col("judge") == "flag").alias("flags"),
        F.count_if(F.coalesce(F.col("judge") == "approve", F.lit(False)) == (F.col("final") == "approve")).alias("same"), F.count_if(F.col("judge").isNull()).alias("no_answer"))
    return g.select(F.coalesce("item_type", F.lit("all")).alias("scope"), "n", F.round(F.col("agreed") / F.greatest("decided", F.lit(1)), 4).alias("agree"),
                    "false_approve", "missed", F.round(F.col("flags") / F.col("n"), 4).alias("flag_rate"), F.round(F.col("same") / F.col("n"), 4).alias("binary_agree"), "no_answer")


def inference_metrics(guesses: DataFrame) -> DataFrame:
    """Accuracy when guessed, abstention and confident errors of (guess, gold)."""
    lab, gu = F.col("gold").isNotNull(), F.col("guess").isNotNull()
    wrong, loose = F.count_if(lab & gu & (F.col("guess") != F.col("gold"))), F.count_if(~lab & gu)
    n, nl, ng = F.count(F.lit(1)), F.count_if(lab), F.count_if(lab & gu)
    return guesses.agg(
        nl.alias("labeled"), ng.alias("guessed"), (1 - wrong / F.nullif(ng, F.lit(0))).alias("accuracy_when_guessed"), (F.count_if(~gu) / n).alias("abstain_rate"),
        (wrong / F.nullif(nl, F.lit(0))).alias("confident_wrong_rate"), ((wrong + loose) / n).alias("conservative_wrong_rate"))


def uncertain_paths(commits: DataFrame, changes: DataFrame, as_of: Column, auto_prefix: str = "Auto-sync", latency: int = 300) -> DataFrame:
    """Files whose state at ``as_of`` the history cannot settle: those the next commit
    changed, unless that is an auto-commit made well after the cut-off."""
    before = commits.where(F.col("at") <= as_of).orderBy(F.desc("at"), F.desc("commit_id")).limit(1).select(F.lit(1).alias("has_prior"))
    after = commits.where(F.col("at") > as_of).orderBy("at", "commit_id").limit(1)
    late_auto = F.col("subject").startswith(auto_prefix) & (F.timestamp_diff("SECOND", as_of, F.col("at")) > latency)
    nxt = after.where(~late_auto & (before.agg(F.count(F.lit(1))).scalar() > 0)).select("commit_id")
    return changes.join(broadcast_if_small(nxt), "commit_id").select("commit_id", "path").distinct()


def rank_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cases whose first gold rank moved between two runs; a missing rank is worst."""
    a = before.select("case_id", F.coalesce("gold_rank", F.lit(99)).alias("rank_before"))
    b = after.select("case_id", F.coalesce("gold_rank", F.lit(99)).alias("rank_after"))
    j = a.join(b, "case_id")
    change = F.when(F.col("rank_after") < F.col("rank_before"), "improved").when(F.col("rank_after") > F.col("rank_before"), "regressed").otherwise("same")
    return j.withColumn("change", change)


def oracle_projects(gold: DataFrame, projects: DataFrame) -> DataFrame:
    """Most common project of each case's gold; ties to the least name."""
    c = gold.join(projects, "name").groupBy("case_id", "project").agg(F.count(F.lit(1)).alias("n"))
    return top_k(c, ["case_id"], [F.desc("n"), F.col("project")], 1).select("case_id", "project")


def remap_gold(gold: DataFrame, mapping: DataFrame) -> DataFrame:
    """Gold member names replaced by their roll-up's name, once each."""
    return gold.join(mapping.select(F.col("member").alias("name"), "rollup"), "name", "left").select("case_id", F.coalesce("rollup", "name").alias("name")).distinct()


def expansion_gain(cases: DataFrame, gold: DataFrame, direct: DataFrame, expanded: DataFrame) -> DataFrame:
    """Per case: gold found directly, and with expanded items as well."""
    def hits(found: DataFrame, name: str) -> DataFrame:
        return gold.join(found.select("case_id", "name").distinct(), ["case_id", "name"], "left_semi").groupBy("case_id").agg(F.count(F.lit(1)).alias(name))

    j = cases.select("case_id").join(hits(direct, "d"), "case_id", "left").join(hits(direct.select("case_id", "name").union(expanded.select("case_id", "name")), "e"), "case_id", "left")
    d, e = F.coalesce("d", F.lit(0)) > 0, F.coalesce("e", F.lit(0)) > 0
    return j.select("case_id", d.alias("direct_hit"), e.alias("expanded_hit"), (e & ~d).alias("recovered"))


#: Similarities that a best match is looked for above, before all down to the least are met.
FLOORS = (0.8, 0.7)


def compare_runs(old: DataFrame, new: DataFrame, least: float = 0.6) -> DataFrame:
    """Best match, at or over ``least``, of each new statement among the old run's of the
    same conversation. Similarity is twice the shared words over the words of both.

    Equal word sets are matched once for all their statements. Sets then meet on their
    rarest words only: two sets as similar as ``least`` must share one of the first
    n - ceil(n * least / (2 - least)) + 1 words of either in order of rarity, so common
    words never form candidates and no match is missed. High floors go first: a statement
    whose best match is over one needs no candidates of a lower floor.
    """
    def sets(df: DataFrame, name: str) -> DataFrame:
        w = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("statement"), F.lit("[a-z0-9]+"), F.lit(0))))
        return df.select("conversation_id", F.col("memory_id").alias(name), w.alias("w")).where(F.size("w") > 0)

    o, n = sets(old, "old_id"), sets(new, "new_id")
    oset = cut_lineage(o.groupBy("conversation_id", "w").agg(F.min("old_id").alias("old_id")))
    nset = cut_lineage(n.select("conversation_id", "w").distinct())
    df = oset.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))

    def prefix(s: DataFrame, name: str, floor: float) -> DataFrame:
        t = s.select("conversation_id", F.col("w").alias(name), F.explode("w").alias("word")).join(df, "word", "left")
        ranked = t.groupBy("conversation_id", name).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("r"))
        size = F.size("r")
        keep = size - F.ceil(size * floor / (2 - floor) - 1e-9).cast("int") + 1
        return ranked.select("conversation_id", name, F.explode(F.transform(F.slice("r", 1, keep), lambda x: x["word"])).alias("word"))

    def matched(left: DataFrame, floor: float) -> DataFrame:
        pairs = prefix(left, "nw", floor).join(prefix(oset.select("conversation_id", "w"), "ow", floor), ["conversation_id", "word"]).select("conversation_id", "nw", "ow").distinct()
        sim = F.round(2 * F.size(F.array_intersect("nw", "ow")) / (F.size("nw") + F.size("ow")), 6)
        found = pairs.withColumn("similarity", sim).where(F.col("similarity") >= floor).join(oset.withColumnRenamed("w", "ow"), ["conversation_id", "ow"])
        return found.groupBy("conversation_id", "nw").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "old_id")).alias("b"))

    best = None
    for floor in [x for x in FLOORS if x > least]:
        # Over the floor by a rounded digit, so no match as good can be under it.
        sure = cut_lineage(matched(nset, floor).where(-F.col("b.s") > floor))
        best = sure if best is None else best.union(sure)
        nset = cut_lineage(nset.join(sure.select("conversation_id", F.col("nw").alias("w")), ["conversation_id", "w"], "left_anti"))
        if nset.isEmpty():
            break
    else:
        rest = matched(nset, least)
        best = rest if best is None else best.union(rest)
    return n.join(best.withColumnRenamed("nw", "w"), ["conversation_id", "w"]).select("new_id", F.col("b.old_id").alias("old_id"), (-F.col("b.s")).alias("similarity"))

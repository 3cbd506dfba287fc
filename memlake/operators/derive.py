"""Rule-based derivation of memories from events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions import dates, rules, text as tx
from memlake.operators.scan import Running, running, time_chunk


def has(text: Column, pattern: str) -> Column:
    return tx.matches(text, pattern)


def classify(text: Column, heading: Column, dated: Column) -> Column:
    """Struct (category, reason) for a candidate; ``dated`` is the (at, precision) struct of F6.

    Durable language without action verbs is durable; action language needs a date to be
    episodic; a date alone proves nothing. Long episodic text is too long to trust.
    """
    head = F.coalesce(heading, F.lit(""))
    has_date, precision = dated.isNotNull(), F.coalesce(dated["precision"], F.lit("none"))
    verbs, change = has(text, rules.EPISODIC_VERBS), has(text, rules.PREFERENCE_CHANGE)
    durable = (has(head, rules.DURABLE_HEADING) | has(text, rules.DURABLE_WORDS)) & ~change
    episodic = has(head, rules.EPISODIC_HEADING) | verbs | change

    def outcome(category: str, *reason) -> Column:
        return F.struct(F.lit(category).alias("category"),
                        F.concat(*[F.lit(r) if isinstance(r, str) else r for r in reason]).alias("reason"))

    raw = (
        F.when(durable & ~verbs, outcome("durable_candidate", "durable language"))
        .when(durable & has_date, outcome("episodic", "dated state change (", precision, ")"))
        .when(durable, outcome("ambiguous", "state change without a date"))
        .when(episodic & has_date, outcome("episodic", "dated event (", precision, ")"))
        .when(episodic & has(text, rules.RELATIVE_TIME), outcome("ambiguous", "relative time only"))
        .when(episodic, outcome("ambiguous", "event without a date"))
        .when(has_date, outcome("ambiguous", "date (", precision, ") without episodic or durable language"))
        .otherwise(outcome("ambiguous", "undated and unclear"))
    )
    too_long = (raw["category"] == "episodic") & (F.length(text) > rules.MAX_EPISODIC_CHARS)
    return F.when(too_long, outcome("ambiguous", "too long for an episodic statement")).otherwise(raw)


def classify_candidates(df: DataFrame) -> DataFrame:
    """``text`` and ``heading`` to event date, precision, category and reason. A date in the
    heading counts when the text has none."""
    dated = F.coalesce(dates.extract_date(F.col("text")), dates.extract_date(F.coalesce(F.col("heading"), F.lit(""))))
    d = df.withColumn("__d", dated)
    d = d.withColumn("__c", classify(F.col("text"), F.col("heading"), F.col("__d")))
    return d.withColumns({
        "event_date": F.col("__d.at"), "date_precision": F.coalesce(F.col("__d.precision"), F.lit("none")),
        "category": F.col("__c.category"), "reason": F.col("__c.reason")}).drop("__d", "__c")


def confidence(category: Column, precision: Column) -> Column:
    base = F.element_at(F.create_map(*[F.lit(x) for kv in rules.BASE_CONFIDENCE.items() for x in kv]), category)
    bonus = F.element_at(F.create_map(*[F.lit(x) for kv in rules.PRECISION_BONUS.items() for x in kv]), precision)
    return F.least(F.lit(1.0), base + bonus)


def approval_state(category: Column, score: Column, threshold: float) -> Column:
    return (F.when(category == "non_memory", "rejected")
            .when((category == "episodic") & (score >= threshold), "auto_accepted").otherwise("queued_for_review"))


def heuristic_policy(events: DataFrame) -> DataFrame:
    """One derivation per event: only user turns count, and a reconstructed event may lend
    its own date to an undated text."""
    body = tx.strip(F.coalesce(F.col("text"), F.lit("")))
    heading = F.coalesce(F.col("heading"), F.lit("")) if "heading" in events.columns else F.lit("")
    e = events.withColumn("__own", dates.extract_date(body))
    lends = F.col("reconstructed") & F.col("__own").isNull()
    text = F.when(lends, F.concat(F.lit("On "), F.to_date("observed_at").cast("string"), F.lit(", "), body)).otherwise(body)
    given = F.struct(F.col("observed_at").alias("at"), F.lit("exact").alias("precision"))
    e = e.withColumn("__d", F.when(lends, given).otherwise(F.coalesce(F.col("__own"), dates.extract_date(heading))))
    e = e.withColumn("__c", classify(text, heading, F.col("__d")))
    empty, foreign = body == "", F.col("actor_type") != "user"
    category = F.when(empty | foreign, "non_memory").otherwise(F.col("__c.category"))
    reason = F.when(empty, "empty content").when(foreign, "not the user's own words").otherwise(F.col("__c.reason"))
    kept = ~(empty | foreign)
    precision = F.when(kept, F.coalesce(F.col("__d.precision"), F.lit("none"))).otherwise("none")
    e = e.withColumns({"statement": body, "category": category, "reason": reason,
                       "event_date": F.when(kept, F.col("__d.at")), "date_precision": precision})
    return e.withColumn("confidence", F.when(kept, confidence(F.col("category"), F.col("date_precision"))).otherwise(0.0)).drop("__own", "__d", "__c")


def derive(events: DataFrame, jobs: DataFrame, prior: DataFrame, policy: str, version: str, threshold: float) -> DataFrame:
    """New derivations of the events no succeeded job covers; each links the newest earlier
    derivation of its event under ``supersedes``."""
    done = jobs.where((F.col("policy") == policy) & (F.col("policy_version") == version) & (F.col("status") == "succeeded"))
    fresh = heuristic_policy(events.join(done.select("event_id").distinct(), "event_id", "left_anti"))
    fresh = fresh.withColumn("memory_id", F.concat(F.col("event_id").cast("string"), F.lit(f"::{policy}@{version}")))
    newest = prior.groupBy("event_id").agg(F.max_by("memory_id", F.struct("created_at", "memory_id")).alias("supersedes"))
    state = approval_state(F.col("category"), F.col("confidence"), threshold)
    return fresh.join(newest, "event_id", "left").withColumn("approval_state", state)


def turn_features(turns: DataFrame) -> DataFrame:
    """Boolean evidence features of a turn and the stage they add up to."""
    body = tx.strip(F.col("text"))
    cols = {n: has(body, p) for n, p in rules.TURN_FEATURES.items()}
    cols["completed_action"] = cols["completed_action"] | has(body, rules.PERSONAL_ACTION)
    out = turns.withColumns(cols)
    foreign = reduce(lambda a, b: a | b, [F.col(c) for c in ("pasted_log", "third_party_text", "table_request", "hypothetical")])
    low = F.lower(body)
    return out.withColumns({
        "role_profile_fact": ~foreign & (has(body, rules.ROLE_PROFILE) | has(body, rules.PERSONAL_BIOGRAPHY)),
        "stage": F.when(F.col("completed_action"), "completed").when(F.col("decision"), "deciding")
        .when(F.col("iterative_refinement"), "refining").when(F.col("action_intent") & low.contains("draft"), "drafting")
        .when(F.col("action_intent") & (low.contains("prepare") | low.contains("plan")), "planning")
        .when(F.col("action_intent"), "developing").otherwise("researching")})


def candidate_gate(turns: DataFrame) -> DataFrame:
    """Memory-worthiness gate: category and reason code of a user turn.

    ``anchored`` (optional) says the conversation already has an anchor turn. Only the
    generic rules are built; rules about one person's affairs are not.
    """
    f = turn_features(turns)
    body = tx.strip(F.col("text"))
    anchored = F.col("anchored") if "anchored" in turns.columns else F.lit(False)
    acted = F.col("completed_action")
    bio = F.col("role_profile_fact") & has(body, rules.PERSONAL_BIOGRAPHY)
    dated = dates.extract_date(body).isNotNull()
    command = has(body, rules.GENERIC_COMMAND) & (F.size(F.split(body, r"\s+")) < rules.GENERIC_COMMAND_WORDS)
    first_person = F.col("first_person_singular") | F.col("first_person_org")
    artifact, intent = F.col("named_artifact"), F.col("action_intent")
    none = F.lit("non_memory_no_personal_significance")
    code = (
        F.when(F.col("pasted_log") & ~acted, none)
        .when(F.col("third_party_text") | F.col("table_request") | (F.col("troubleshooting") & ~anchored), none)
        .when(F.col("hypothetical"), "non_memory_hypothetical")
        .when(has(body, rules.GENERIC_IMAGE) | (has(body, rules.GENERIC_DATASET) & ~acted), none)
        .when(F.col("generic_drafting") & ~anchored & ~artifact & ~F.col("role_profile_fact"), "non_memory_generic_drafting")
        .when((has(body, rules.GENERIC_CODE) | has(body, rules.GENERIC_TRIVIA)) & ~acted & ~bio & ~artifact & ~anchored, "non_memory_generic_research")
        .when(command & ~anchored, none)
        .when(bio, "durable_explicit_profile_fact")
        .when(F.col("delivered_portfolio") & ~(intent | artifact), "durable_explicit_profile_fact")
        .when(anchored & F.col("iterative_refinement"), "episodic_significant_artifact_session")
        .when(acted & dated, "episodic_confirmed_action")
        .when(first_person & artifact & (intent | F.col("decision") | F.col("delivered_portfolio")), "episodic_significant_artifact_session")
        .when(acted | (first_person & (artifact | intent)), "ambiguous_personal_context")
        .otherwise(none))
    return f.withColumn("reason_code", code).withColumn("category", F.regexp_extract("reason_code", r"^(non_memory|durable|episodic|ambiguous)", 1))


def redate(items: DataFrame) -> DataFrame:
    """New date against the original: an undated text keeps its original date unless a
    validity phrase shows that date was never the event's."""
    d = items.withColumn("__d", dates.extract_date(F.col("text")))
    boundary = has(F.col("text"), rules.VALIDITY_BOUNDARY)
    old, new = F.col("original_at"), F.col("__d.at")
    at = F.when(new.isNotNull(), new).when(~boundary, old)
    changed = F.when(new.isNull(), boundary & old.isNotNull()).otherwise(old.isNotNull() & (new != old))
    return d.withColumn("event_date", at).withColumn("redated", changed).drop("__d")


def lookahead_correction(memories: DataFrame, turns: DataFrame, order: list[str], n: int = 6) -> DataFrame:
    """First of the next ``n`` user turns that corrects a memory's turn.

    User turns are numbered once per conversation; the lookahead is then an equality on
    (conversation, number), never a join of all pairs in a conversation.
    """
    users = turns.where(F.col("actor_type") == "user")
    user_no = running(turns, ["conversation_id"], order, time_chunk(F.col("observed_at")),
                      Running(sums={"user_no": (F.col("actor_type") == "user").cast("bigint")}))
    at = memories.join(user_no.select("event_id", "conversation_id", "user_no"), "event_id")
    ahead = at.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("user_no", F.col("user_no") + F.col("__k"))
    hits = user_no.where((F.col("actor_type") == "user") & has(F.col("text"), rules.CORRECTION)).select(
        "conversation_id", "user_no", F.col("event_id").alias("corrected_by"))
    found = ahead.join(hits, ["conversation_id", "user_no"]).groupBy("memory_id").agg(
        F.min_by("corrected_by", "__k").alias("corrected_by"), F.min("__k").alias("turns_ahead"))
    return memories.join(found, "memory_id", "left")


def apply_overrides(items: DataFrame, overrides: DataFrame) -> DataFrame:
    """Candidates with overrides by source id: ``exclude`` drops, ``reclassify`` replaces the
    category, ``consolidate`` gathers its ids under one target, ``split`` leaves single ids.

    ``items``: memory_id, source_id, category. Returns one row per resulting candidate.
    """
    j = items.join(overrides, "source_id", "left").where(F.coalesce("action", F.lit("")) != "exclude")
    target = (F.when(F.col("action") == "consolidate", F.col("target"))
              .when(F.col("action") == "split", F.concat_ws("#", "memory_id", F.col("source_id").cast("string")))
              .otherwise(F.col("memory_id")))
    category = F.when(F.col("action") == "reclassify", F.col("target")).otherwise(F.col("category"))
    return j.select(target.alias("memory_id"), category.alias("category"), "source_id").groupBy("memory_id").agg(
        F.min("category").alias("category"), F.count_distinct("source_id").alias("n_sources"), F.min("source_id").alias("first_source"))


def provenance_violations(items: DataFrame, active_user_turns: DataFrame) -> DataFrame:
    """Source ids that resolve to no active user turn, or that a candidate cites twice."""
    cited = items.groupBy("memory_id", "source_id").agg(F.count(F.lit(1)).alias("times"))
    known = active_user_turns.select(F.col("event_id").alias("source_id")).distinct().withColumn("known", F.lit(True))
    j = cited.join(known, "source_id", "left")
    problem = F.when(F.col("known").isNull(), "unresolved").when(F.col("times") > 1, "duplicate")
    return j.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("memory_id", "source_id", "problem")


def import_accounting(turns: DataFrame) -> DataFrame:
    """One row: conversations, messages, user messages, and duplicates by id and by text."""
    body = F.lower(tx.strip(F.regexp_replace("text", r"\s+", " ")))
    fp = F.left(F.sha2(body, 256), F.lit(16))
    per_print = turns.where(F.col("actor_type") == "user").groupBy(fp.alias("fp")).agg(F.count(F.lit(1)).alias("c"))
    prints = per_print.agg(F.sum("c").alias("user_messages"), (F.sum("c") - F.count(F.lit(1))).alias("duplicate_fingerprints"))
    per_id = turns.groupBy("conversation_id", "event_id").agg(F.count(F.lit(1)).alias("c"))
    ids = per_id.groupBy("conversation_id").agg(F.sum("c").alias("m"), (F.sum("c") - F.count(F.lit(1))).alias("d")).agg(
        F.count(F.lit(1)).alias("conversations"), F.sum("m").alias("messages"), F.sum("d").alias("duplicate_message_ids"))
    return ids.withColumns({c: prints.select(c).scalar() for c in ("user_messages", "duplicate_fingerprints")})

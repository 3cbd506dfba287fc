"""Scalar rules on the cases that matter."""

import time

from pyspark.sql import functions as F

from memlake.functions import dates, text as tx
from memlake.operators import derive as d, windows as w


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first().x


def test_dates(spark):
    cases = {
        "Met on 2026-08-31T14:30:05 there": ("2026-08-31 14:30:05", "exact"), "March 5, 2024": ("2024-03-05 00:00:00", "exact"),
        "the 7th June 2022": ("2022-06-07 00:00:00", "exact"), "in Sept. 2021": ("2021-09-01 00:00:00", "month"), "since 1999 (2001)": ("1999-01-01 00:00:00", "year"),
        "valid through December 2026": None, "Checked 2024-02-31 then March 2024": ("2024-03-01 00:00:00", "month"), "version 2024": None,
        "expires 2025-01-01, renewed later than that on 2024-06-01": ("2024-06-01 00:00:00", "exact"),
    }
    for text, want in cases.items():
        got = one(spark, text, dates.extract_date)
        assert (None if got is None else (str(got.at), got.precision)) == want, text


def test_classification(spark):
    rows = [("Android log 2025-12-23 14:33:16 foo", "ambiguous"), ("We decided on 2024-03-05 to move.", "episodic"), ("We decided to move.", "ambiguous"),
            ("I prefer tea.", "durable_candidate"), ("Changed preference to tea on 2024-03-05", "episodic"), ("We fixed it on 2024-03-05. " + "x" * 600, "ambiguous")]
    df = spark.createDataFrame([(i, t, "") for i, (t, _) in enumerate(rows)], "i int, text string, heading string")
    got = [r.category for r in d.classify_candidates(df).orderBy("i").collect()]
    assert got == [w for _, w in rows]


def test_underscores(spark):
    assert one(spark, "a_b _ c _d __ e_", tx.sanitize_fulltext) == "a_b ＿ c _d __ e_"


def test_gap_format(spark):
    df = spark.createDataFrame([(5400.0,), (5340.0,), (24660.0,), (172800.0,)], "s double")
    assert [r.g for r in df.select(tx.format_gap(F.col("s")).alias("g")).collect()] == ["1.5h", "89m", "6.8h", "2.0d"]


def test_redaction(spark):
    assert one(spark, "key sk-ABCDEFGHIJKLMNOPQRSTUVWX!", tx.redact) == "key [REDACTED]!"


def test_word_bounds_are_ascii_as_in_sql(spark):
    """A word bound lies between an ASCII word character and an accented letter, too."""
    df = spark.createDataFrame([("c:1", "l'éour ée"), ("c:2", "leour ée")], "event_id string, text string")
    assert [r.first_person_org for r in d.turn_features(df).orderBy("event_id").collect()] == [True, False]
    turns = spark.createDataFrame([(1, "user", "testä äwhy ä")] * 3, "conversation_id long, actor_type string, text string")
    assert [r.reason for r in w.triage(turns, ["conversation_id"]).collect()] == ["reasoning signal: deliberation-marker"]
    assert one(spark, "on é2024-03-05é", dates.extract_date).precision == "exact"


def test_a_snippet_of_very_many_hits(spark):
    """Places are ranked once, not compared with each other: a text of 60,000 hits takes no minutes."""
    text = "x" * 300 + "the onenth " + "y" * 600 + " the" * 60_000
    began = time.time()
    got = one(spark, text, lambda c: tx.snippet(c, F.lit("the onenth part")))
    assert time.time() - began < 20 and got.count(" … ") == 2 and got.split(" … ")[0].endswith("the the...")
    assert one(spark, "no such word", lambda c: tx.snippet(c, F.lit("other"))) == "no such word"
    assert one(spark, None, lambda c: tx.snippet(c, F.lit("other"))) is None

"""Plan shape: filters at the scan, shuffles and broadcasts of costly queries, checkpoint folders."""

import os
import re
import subprocess
import sys

from memlake.plans import all_queries
from tests.conftest import SF

QUERIES = all_queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    from memlake.operators.journal import read_events
    from memlake.plans.registry import Tables

    text = plan(read_events(Tables(spark, SF).f_events, None, 7, "2024-01-05", "2024-01-20"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(user_id,7\)", text) and "GreaterThanOrEqual(ts" in text


def test_counts_read_only_what_they_need(spark):
    text = plan(QUERIES["A2_captured_vs_reconstructed"](spark, SF))
    assert re.search(r"ReadSchema: struct<event_id:bigint>", text)


def test_checkpoints_need_a_shared_folder_off_local_masters():
    import pytest

    from memlake.session import checkpoint_dir

    class Settings:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Settings()

    class Session:
        conf, sparkContext = Settings(), Context()

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())


def test_a_real_session_without_a_named_folder(tmp_path):
    """Another process, whose configuration names no checkpoint folder."""
    code = """
from memlake.session import build_session, checkpoint_dir, cut_lineage
s = build_session(cpus=1, memory="1g")
assert s.conf.get("spark.checkpoint.dir", None) is None and s.sparkContext.getConf().get("spark.checkpoint.dir") is None
one, two = checkpoint_dir(s), checkpoint_dir(s)
assert one == two and cut_lineage(s.range(3)).count() == 3
print("folder", one)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYSPARK_SUBMIT_ARGS"} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.getcwd()}
    run = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    folder = re.search(r"^folder (.+)$", run.stdout, re.M)
    assert folder, run.stderr[-2000:]
    assert not os.path.exists(folder[1])  # removed with the application


def test_lexical_search_shuffles_only_the_best(spark):
    text = plan(QUERIES["R1_lexical_top20"](spark, SF))
    assert text.count("MapInArrow") == 1 and text.count("Exchange hashpartitioning") == 1


def test_costly_queries_use_no_nested_loops(spark):
    for name in ("R2_bm25_top10", "C9_merge_threads", "G10_snapshot_facts", "L6_duplicate_hints", "S10_parse_sections", "W2_time_gap_windows", "G6_connected_components", "R5_expand_to_notes"):
        text = plan(QUERIES[name](spark, SF))
        assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text, name

"""The registered corpus queries at the smallest scale, with their SQL, and the pipeline."""

import math
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from memlake.llm import decontaminate, line_dedup, queries, stages, toxicity
from memlake.llm.common import table
from tests.conftest import SF
from tools.check import compare

FULL = {f"op{n}": "documents" for n in (1, 2, 3, 4, 5, 7, 9, 10)} | {"op8": "pages", "op11": "pages"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLES:
        assert not compare(df, duck, queries.ORACLES[name])
    else:
        source = FULL.get(name.split("_")[0])
        assert df.count() == table(spark, SF, source).count() if source else df.count() > 0


def test_pipeline_against_its_stages_in_plain_python(spark):
    """Every stage again on the rows its predecessor kept."""
    rows = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    scores = toxicity.report(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()
    kept = {r.doc_id: rows[r.doc_id] for r in scores if r.score < toxicity.THRESHOLD}
    docs = table(spark, SF, "documents").where(F.col("doc_id").isin(list(kept)))
    cleaned = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(docs).collect()}
    shingles = {}
    for d, t in cleaned.items():
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        shingles[d] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    ids = sorted(shingles)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    single = {d: cleaned[d] for d in ids if find(d) == d}
    windows = {w for r in table(spark, SF, "benchmark").collect() for w in decontaminate.windows(decontaminate.words(r.text))}
    final = {d for d, t in single.items() if not any(tuple(w) in windows for k in {len(x) for x in windows} for ws in [decontaminate.words(t)] for w in (ws[i:i + k] for i in range(len(ws) - k + 1)))}
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in got.select("doc_id").collect()} == final
    assert 0 < len(final) < len(rows)


def test_stages_keep_columns_and_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.collect()
    assert stages.near_dedup(spark, odd, SF).where("doc_id IN (1, 2, 3)").count() == 1
    assert stages.packing(spark, odd, SF).where("piece = 0").count() == odd.count()
    assert math.isclose(stages.line_dedup(spark, odd, SF).count(), odd.count())


def test_near_dedup_of_a_repeated_id_with_other_texts(spark, make):
    """Id 1 stands for two texts; each has a copy under another id, and one of each group stays."""
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = make([(1, one), (1, two), (2, one), (3, two + " more"), (4, "alone"), (4, "alone"), (None, one), (5, None), (6, "")])
    got = sorted(((r.doc_id, r.text) for r in stages.near_dedup(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, one), (1, two), (4, "alone"), (None, one), (5, None)], key=str)


def test_label_samples_hold_an_id_once(spark, make):
    labels = spark.createDataFrame([(d, 1, d % 2) for d in range(1, 30)], "doc_id bigint, quality int, toxic int")
    rows = toxicity.sample(make([(1, f"copy {k}") for k in range(50)] + [(d, f"t{d}") for d in range(2, 30)]), labels, "toxic", 100).collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.text == "copy 0" for r in rows if r.doc_id == 1)

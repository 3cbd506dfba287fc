"""Exact, near and line dedup against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from memlake.llm import exact_dedup, line_dedup, simhash

WHITE = re.compile("[\x20\x09-\x0d]")


def test_exact_cases(odd):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == odd.count()
    texts = defaultdict(list)
    for r in odd.collect():
        texts[WHITE.sub("", r.text or "")].append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in texts.items()}
    kept = Counter()
    for r in rows:
        group = by_hash[r.text_sha256]
        best = min(group)
        assert r.group_size == len(group) and r.keep_id == (None if best[1] else best[2])
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1} and len(kept) == len(by_hash)


def test_exact_tells_colliding_chunks_apart(spark, monkeypatch):
    part = "array<struct<h:bigint,s:binary>>"
    rows = spark.sql(f"""SELECT * FROM VALUES (1L, 1L, 5, 'a', from_json('[{{"h":7,"s":"YQ=="}}]', '{part}')), (2L, 2L, 5, 'b', from_json('[{{"h":7,"s":"Yg=="}}]', '{part}')),
        (3L, 3L, 5, 'a', from_json('[{{"h":7,"s":"YQ=="}}]', '{part}')), (4L, 4L, 5, 'c', from_json('[{{"h":8,"s":"Yw=="}}]', '{part}')) AS v(uid, doc_id, n_points, text_sha256, parts)""")
    monkeypatch.setattr(exact_dedup, "recipes", lambda docs: rows)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(None).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}


def test_empty_tables(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert simhash.near_components(empty).count() == 0
    assert line_dedup.drop_boilerplate(empty).count() == 0


def plain_fingerprint(text, size=4):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_by_links(fps, ids, bits=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_cases(odd):
    docs = {(r.doc_id, r.text) for r in odd.collect()}
    got = simhash.near_components(odd).collect()
    assert len(got) == odd.count()
    ids, fps = zip(*[(d, plain_fingerprint(t)) for d, t in docs])
    want = {(d, fp, c) for d, fp, c in zip(ids, fps, least_by_links(fps, ids))}
    assert {(r.doc_id, r.fp % 2**64, r.component_id) for r in got} == want


def test_groups_grow_with_the_points():
    counts = [simhash.group_count(n) for n in (1, 10**6, 10**8, 10**9, 10**10, 10**30)]
    assert counts == sorted(counts) and counts[0] == counts[1] == 7 and counts[-1] == 13 and len(set(counts)) >= 4


@pytest.mark.parametrize("block,groups", [(8, 7), (512, 7), (512, 9)])
def test_links_connect_a_crowd_and_a_chain(spark, monkeypatch, block, groups):
    """Many points around one centre, a chain of four-bit steps, and strangers."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(0)
    centre = int(rng.integers(0, 2**63))
    crowd = {centre} | {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))}
    chain, x = [], int(rng.integers(0, 2**63))
    for k in range(12):
        chain.append(x)
        x ^= 0xF << (4 * k)
    points = sorted(crowd | set(chain) | {int(v) for v in rng.integers(0, 2**63, 200)})
    df = spark.createDataFrame([(simhash.signed(p),) for p in points], "fp bigint").repartition(4)
    edges = simhash.links(df, groups=groups)
    roots = {r.fp % 2**64: r.root % 2**64 for r in simhash.components(edges).collect()}
    want = least_by_links(points, list(range(len(points))))
    classes, expected = defaultdict(set), defaultdict(set)
    for p, w in zip(points, want):
        classes[roots.get(p, p)].add(p)
        expected[w].add(p)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, expected.values()))
    assert block < 512 or edges.count() < 6 * len(points)  # a crowd's links, not all its pairs


def test_embedding_bounds_the_distance(spark):
    xs = [int(v) for v in np.random.default_rng(1).integers(0, 2**63, 50)]
    df = spark.createDataFrame([(simhash.signed(a), simhash.signed(b)) for a, b in zip(xs, xs[1:])], "a bigint, b bigint")
    low = F.bit_count(simhash.embed(F.col("a")).bitwiseXOR(simhash.embed(F.col("b"))))
    for r in df.select("a", "b", low.alias("low")).collect():
        a, b = r.a % 2**64, r.b % 2**64
        assert r.low == sum(abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2)) <= (a ^ b).bit_count()


def test_components_raise_at_the_cap(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        simhash.components(edges, max_rounds=1)


def test_line_dedup_ratio_and_copies(make):
    rows = [(i, f"Menu\nown line {i}\n  Menu  \n\nrare {i // 3}", "a") for i in range(30)]
    rows += [(100 + i, "A copied page\nwith two lines", "a") for i in range(40)]  # one page of host a
    rows += [(200 + i, f"Menu\nb {i}", "b") for i in range(4)]  # fewer pages than the minimum
    rows += [(300, None, "a"), (301, "", None), (302, "Menu", None)]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(make(rows), ratio=0.2).collect()}
    assert len(got) == len(rows)
    assert got[5].text == "own line 5\n\nrare 1" and (got[5]["__n_lines"], got[5]["__n_dropped"]) == (5, 2)
    assert got[100].text == "A copied page\nwith two lines" and got[201].text == "Menu\nb 1"
    assert got[300].text is None and got[300]["__n_lines"] == 0 and got[302].text == "Menu"


def test_wide_simhash_finds_edited_copies_and_spares_others(spark, make, odd, empty):
    from memlake.llm import wide_simhash as wide

    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 4))
    base = [[word() for _ in range(300)] for _ in range(60)]
    rows, want = [], {}
    for k, words in enumerate(base):
        for c in range(3):
            copy = list(words)
            for at in rng.choice(300, 2 * c, replace=False):  # none, then two, then four words
                copy[at] = word()
            rows.append((10 * k + c, " ".join(copy)))
            want[10 * k + c] = 10 * k
    got = {r.doc_id: r.component_id for r in wide.near_components(make(rows)).collect()}
    assert all(got[d] == c or d == got[d] for d, c in want.items())  # none goes to another's group
    assert sum(got[d] == c for d, c in want.items()) >= 0.99 * len(want)
    assert wide.near_components(odd).count() == odd.count() and wide.near_components(empty).count() == 0


@pytest.mark.parametrize("block", [8, 512])
def test_wide_links_equal_brute_force_within_cells(spark, monkeypatch, block):
    from memlake.llm import wide_simhash as wide

    monkeypatch.setattr(wide, "BLOCK", block)
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, wide.LANES)
    points = [tuple(int(x) for x in centre)]
    for _ in range(120):
        flips = rng.choice(256, rng.integers(1, 18), replace=False)
        p = [int(x) for x in centre]
        for f in flips:
            p[f // 64] ^= 1 << int(f % 64)
        points.append(tuple(p))
    points += [tuple(int(x) for x in rng.integers(0, 2**63, wide.LANES)) for _ in range(80)]
    df = spark.createDataFrame([(i, *map(simhash.signed, p)) for i, p in enumerate(points)], "id bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint").repartition(3)
    edges = wide.cell_links(df.withColumn("cell", F.lit(1).cast("bigint")))  # one crowded cell
    for r in edges.collect():
        assert r.a < 121 and r.b < 121
    roots = {r.fp: r.root for r in simhash.components(edges).collect()}
    assert all(roots.get(i) == 0 for i in range(121))


@pytest.mark.parametrize("pivots", [2, 8])
def test_near_copies_link_at_four_fifths_of_shingles_and_not_below(make, monkeypatch, pivots):
    from memlake.llm import wide_simhash as wide

    monkeypatch.setattr(wide, "BLOCK", 8)
    monkeypatch.setattr(wide, "PIVOTS", pivots)
    rng = np.random.default_rng(9)
    rows = []

    def add(words, edits):  # an edit inside changes five of 196 shingles
        copy = list(words)
        for at in edits:
            copy[at] = f"new{len(rows)}x{at}"
        rows.append((len(rows), " ".join(copy)))

    for k in range(40):
        words = [f"w{k}x{i}" for i in range(200)]
        add(words, ())
        add(words, range(20, 180, 40) if k % 2 else range(20, 200, 35))  # 0.815, or 0.735 with six edits
    crowd = [f"c{i}" for i in range(200)]
    for _ in range(50):  # copies of copies: some pairs are over 0.8, some chained, some below
        add(crowd, rng.choice(range(10, 190, 6), rng.integers(1, 6), replace=False))
    sets = {d: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} for d, t in rows for w in [t.split()]}
    want = {d: d for d in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and want[a] != want[b]:
                low, high = sorted((want[a], want[b]))
                want = {d: low if r == high else r for d, r in want.items()}
    got = {r.doc_id: r.component_id for r in wide.near_components(make(rows)).collect()}
    assert got == want and len(set(want.values())) > 60


def test_a_block_of_a_group_holds_a_row_of_its_outsiders_not_all(spark):
    from memlake.llm import wide_simhash as wide

    members = spark.range(4000).selectExpr("0L AS root", "id", "id % 2 = 0 AS inner", "8 AS sides", "4 AS rows")
    blocks = wide.dealt(members).cache()
    sizes = [r["count"] for r in blocks.groupBy("root", "row", "side").count().collect()]
    assert len(sizes) == 32 and max(sizes) < 1300  # about 4000 / 8 and 2000 / 4
    own, other = blocks.where("own").select("row", "side", "id"), blocks.where("NOT own").select("row", "side", F.col("id").alias("o"))
    assert own.join(other, ["row", "side"]).select("id", "o").distinct().count() == 2000 * 4000  # every pair meets


def test_pairs_of_crowded_cells_are_brought_down_to_links_as_they_come(monkeypatch):
    from memlake.llm import wide_simhash as wide

    most, plain = [], wide.spanning
    monkeypatch.setattr(wide, "spanning", lambda i, j, ids: (most.append(len(i)), plain(i, j, ids))[1])
    monkeypatch.setattr(wide, "PAIRS", 500)
    cell, ids = np.repeat(np.arange(4), 100), np.random.default_rng(1).permutation(400)
    a, b = wide.run_links(cell, ids, np.zeros((400, wide.LANES), np.uint64), 0)
    assert max(most) < 500 + 2 * 400  # all pairs are 19,800
    root = ids.reshape(4, 100).min(axis=1)
    assert sorted(zip(ids[a], ids[b])) == sorted((x, root[c]) for x, c in zip(ids, cell) if x != root[c])


def test_released_subwords_are_held_no_more():
    from memlake.llm import subwords
    from memlake.llm.queries import vocabulary

    subwords.subwords(vocabulary("byte_bpe_50k.json"))
    subwords.release()
    assert subwords.subwords.cache_info().currsize == 0


def test_components_of_a_small_table_leave_one_file_a_round(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(101, 100)], "a bigint, b bigint")
        found = simhash.components(edges)
        assert found.rdd.getNumPartitions() == 1
        assert sorted(map(tuple, found.collect())) == [(k, 0) for k in range(41)] + [(100, 100), (101, 100)]
    finally:
        spark.conf.set(name, "true")


def test_components_take_both_directions_from_one_evaluation(spark):
    def drawn(batches):
        """Threes in one component each, by other edges whenever the plan is run."""
        for _ in batches:
            draw = np.random.default_rng().integers(0, 2, 60)
            pairs = [(3 * k + x, 3 * k + y) for k, d in enumerate(draw) for x, y in (((0, 1), (1, 2)) if d else ((2, 0), (1, 0)))]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs])], names=["a", "b"])

    edges = spark.range(0, 1, 1, 1).mapInArrow(drawn, "a bigint, b bigint")
    assert sorted(map(tuple, simhash.components(edges).collect())) == [(k, k - k % 3) for k in range(180)]


def test_labels_of_a_large_table_are_not_broadcast(spark, monkeypatch):
    """A round of 60,000 labels sends none through the driver, though they are below Spark's own threshold."""
    plans, write = [], simhash.cut_lineage

    def spy(df):
        out = write(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(simhash, "cut_lineage", spy)
    edges = spark.range(60_000).selectExpr("id + 1 AS a", "id - id % 4 AS b").where("a <> b")
    labels = simhash.components(edges)
    assert labels.count() == 60_001 and {r.root for r in labels.select("root").distinct().collect()} == {0}
    rounds = [p for p in plans if "Join" in p]
    assert rounds and all("isFinalPlan=true" in p and "SortMergeJoin" in p and "Broadcast" not in p for p in rounds)

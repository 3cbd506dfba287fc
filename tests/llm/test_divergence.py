"""Source divergence against a plain statement of its rules."""

import re
from collections import Counter

from pyspark.sql import functions as F

from memlake.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, rank int, value long, p double"


def plain(rows, min_docs, top):
    docs = [((lang or ""), (source or ""), re.findall(divergence.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        df = Counter(t for g, _, w in docs if g == lang for t in set(w))
        kept = {t for t, n in df.items() if n >= min_docs}
        counts = {s: Counter() for g, s, _ in docs if g == lang}
        for g, s, w in docs:
            if g == lang:
                counts[s].update(t for t in w if t in kept)
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(q[t] - p[s][t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out |= {(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found)}
    return out


def rows_of(df):
    got = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_plain_rules(spark):
    vocabulary = ["alpha", "Beta", "gamma", "delta", "épsilon", "ZETA", "x1y", "tail", "日本", "😀"]
    rows = []
    for k in range(260):
        words = [vocabulary[(k * j + j * j) % 10] for j in range(k % 13)]
        rows.append((" ".join(words) + ("." if k % 2 else ""), ["en", "de", None, "alone"][0 if k % 3 else k % 4], None if k % 17 == 0 else f"s{k % 7}"))
    rows += [("the same copied text", "en", f"s{k % 5}") for k in range(60)] + [(None, "en", "silent"), ("", "empty", "a"), (None, "empty", "b"), ("word " * 40_000, "en", "s1")]
    rows = [(t, lang, "only" if lang == "alone" else s) for t, lang, s in rows]
    df = spark.createDataFrame([(k, *r, "t", 1, 2, 0.5) for k, r in enumerate(rows)], SCHEMA).repartition(5)
    want = plain(rows, 4, 3)
    assert rows_of(divergence.audit(df, min_docs=4, top=3)) == want
    # many chunks, blocks and copy lists give the same
    assert rows_of(divergence.audit(df, min_docs=4, top=3, chunk_terms=3, block=2, list_sources=2)) == want
    assert {r[:4] for r in want if r[0] == "empty"} == {("empty", "a", "pair", "b"), ("empty", "b", "pair", "a")}
    assert divergence.audit(df.where(F.lit(False))).count() == 0


def test_shares_beyond_64_bits(spark):
    n = 40_000_000_000
    row = spark.range(1).select(F.lit(n).alias("n"), F.lit(3 * n).alias("total"), F.lit(1000).cast("bigint").alias("terms")).select(divergence.share("n", "total", "terms").alias("p"))
    assert row.first().p == 1 + 1_000_000_000 * (n + 5) // (3 * n + 5000)

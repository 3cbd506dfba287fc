"""Trained operators: held-out accuracy, small exact checks, odd inputs."""

import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest

from memlake.llm.queries import vocabulary
from memlake.llm import attention_lm as lm, crf_quality as crf, toxicity as tox, url_filter as url
from memlake.llm.common import table
from tests.conftest import SF

SMALL = SF.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SMALL, "labels")


def test_toxicity_held_out(spark, labels):
    got = {r.doc_id: r for r in tox.report(table(spark, SMALL, "documents"), labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for d, r in got.items())
    held = [d for d in truth if got[d].held_out]
    bad, good = [got[d].score for d in held if truth[d]], [got[d].score for d in held if not truth[d]]
    assert np.mean([b > g for b, g in product(bad, good)]) > 0.85
    assert sum(g >= 0.7 for g in good) <= 0.03 * len(good)


def test_toxicity_learns_gaps_and_inserted_letters():
    rng = np.random.default_rng(0)
    syllables = ["la", "mor", "ti", "sen", "pa", "dor", "ve", "rin"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    docs = [[word() for _ in range(60)] for _ in range(200)]
    for d in docs[:80]:
        d[5:5] = ["blockhead", "numbskull"]
    model = tox.fit([sorted(set(d)) for d in docs], np.array([1] * 80 + [0] * 120))
    texts = ["pa dor blockhead ti", "pa dor bl-ock.head ti", "pa dor blockxhead ti", "ve n u m b s k u l l rin", "pa dor ti morsen", "", " ", "x" * 5000, "pa " * 3000 + "numbskull"]
    s = tox.scored(texts, model, {})
    assert (s[:4] > 0.7).all() and (s[4:8] < 0.3).all() and s[8] > 0.7


def test_string_kernel_matches_enumeration():
    def phi(w):
        codes = [int(c) for c in tox.letters([w])[0][0]]
        out, norm = np.zeros(tox.LETTERS ** 3), 0.0
        for i in range(len(codes)):
            for j in range(i + 1, len(codes)):
                for k in range(j + 1, min(len(codes), i + tox.SPAN)):
                    if codes[i] and codes[j] and codes[k]:
                        v = tox.DECAY ** (k - i - 2)
                        out[(codes[i] * tox.LETTERS + codes[j]) * tox.LETTERS + codes[k]] += v
                        norm += v * v
        return out / math.sqrt(max(norm, 1e-6))

    words = ["moron", "m-o-ron", "éa", "a", "banana"]
    weights = np.random.default_rng(1).standard_normal(tox.LETTERS ** 3).astype(np.float32)
    assert np.allclose(tox.weigh(words, weights), [phi(w) @ weights for w in words], atol=1e-4)
    assert np.allclose(tox.features(words).T, [phi(w) for w in words], atol=1e-4)


def test_untrained_and_odd_texts(spark, odd, empty, labels):
    none = labels.where("false")
    for operator, name in ((tox, "toxic"), (crf, "quality")):
        got = operator.report(odd, labels).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert operator.report(empty, labels).count() == 0
        constant = {r.score for r in operator.report(odd, none).collect()}
        assert len(constant) == 1
    assert tox.keep_clean(odd, none).columns == odd.columns and tox.keep_clean(odd, none).count() == odd.count()


def test_quality_held_out(spark, labels):
    got = {r.doc_id: r for r in crf.report(table(spark, SMALL, "documents"), labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [d for d in truth if got[d].held_out]
    good, bad = [got[d].score for d in held if truth[d]], [got[d].score for d in held if not truth[d]]
    assert np.mean([g > b for g, b in product(good, bad)]) > 0.95 and np.mean(np.array(good) >= 0.5) > 0.97


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(4)
    unary, pair = rng.standard_normal((2, 4, 2)), rng.standard_normal((2, 2))
    mask = np.array([[True] * 4, [True, True, False, False]])
    marginal, pairs, z = crf.chain(unary, mask, pair)
    total, want_pairs = 0.0, np.zeros((2, 2))
    for d, n in ((0, 4), (1, 2)):
        paths = list(product((0, 1), repeat=n))
        w = np.array([math.exp(sum(unary[d, t, s] for t, s in enumerate(p)) + sum(pair[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        total += math.log(w.sum())
        for t in range(n):
            assert np.isclose(marginal[d, t, 1], sum(x for x, p in zip(w, paths) if p[t]) / w.sum())
        for x, p in zip(w, paths):
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += x / w.sum()
    assert np.isclose(z, total) and np.allclose(pairs, want_pairs)


def test_url_parts_and_rules(spark):
    cases = [
        (1, "http://A.Example.com/en/7x?q", "a.example.com", "/en/7x", "example.com/en/7", "allow"), (2, "https://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
        (3, "http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"), (4, "x://b.net/de/8", "b.net", "/de/8", "net/de/", "allow"),
        (5, "x://b.example.net/de/8#f", "b.example.net", "/de/8", "example.net/de/8", "block"), (6, "http://org/es/1", "org", "/es/1", "org/es/", "block"),
        (7, None, "", "", None, None), (8, "no scheme", "", "", None, None), (9, "http://h.com?a=/en/", "h.com", "", None, None), (10, "http://", "", "", None, None),
        (11, "a://b://c/d", "b:", "//c/d", None, None), (12, "http://É.com/en/é", "É.com", "/en/é", "com/en/", "block"), (12, "http://É.com/en/é", "É.com", "/en/é", "com/en/", "block")]
    pages = spark.createDataFrame([c[:2] for c in cases], "page_id bigint, url string").selectExpr("*", "'x' AS host", "1 AS rule", "2 AS y")
    got = sorted(url.judge(pages).collect(), key=lambda r: r.page_id)
    assert len(got) == len(cases)
    for c, r in zip(cases, got):
        assert (r.host, r.path, r.rule) == c[2:5] and r.verdict in ("allow", "block") and (c[5] is None or r.verdict == c[5])
    assert url.judge(pages.where("false")).count() == 0
    text = url.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text


def test_url_trees_learn_from_given_labels(spark):
    rows = [(i, f"http://site{i % 7}.com/a/{i}" if i % 2 else f"http://s-{i}-p.biz/{i * 7919}?x=1&y=2&z={i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    known = pages.where("page_id % 3 <> 0").selectExpr("url", "CAST(page_id % 2 = 0 AS INT) AS y")
    got = url.judge(pages, rules=[url.Rule("allow", "nowhere", "/")], labels=known).where("page_id % 3 = 0").collect()
    assert np.mean([(r.verdict == "block") == (r.page_id % 2 == 0) for r in got]) > 0.97


def plain_url(text):
    """(host, path, rule) by the contract's words."""
    if text is None or "://" not in text:
        return "", "", None
    rest = text.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in url.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.host + r.path)).name if fits else None


def test_url_parts_against_plain_python(spark):
    rng = np.random.default_rng(4)
    parts = ["http", "://", "example", ".com", ".net", "org", "/en/", "/de/", "/es/", "7", "8", "?", "#", ".", "A.", "é", "", " "]
    texts = [None, "", "://", "x://a.example.net/de/8y", "http://example.com/en/7" + "x" * 100_000] + ["http://" * (k % 4 > 0) + "".join(rng.choice(parts, rng.integers(1, 9))) for k in range(2_000)]
    given = [r.url for r in table(spark, SF, "pages").collect()]
    pages = spark.createDataFrame(list(enumerate(texts + given)), "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url.ruled(url.parsed(pages)).collect()}
    assert got == {k: plain_url(t) for k, t in enumerate(texts + given)}
    assert len({g[2] for g in got.values()}) == len(url.RULES) + 1


def test_url_splits_and_leaves_against_plain_python(spark):
    rng = np.random.default_rng(7)
    rows = [(1, f, int(b), float(g), float(h)) for f in ("depth", "length") for b, g, h in zip(range(6), rng.normal(size=6), rng.random(6) + 0.5)]
    def gain(f, cut):
        side = lambda keep: (sum(r[3] for r in rows if r[1] == f and keep(r[2])), sum(r[4] for r in rows if r[1] == f and keep(r[2])))
        (lg, lh), (rg, rh) = side(lambda b: b <= cut), side(lambda b: b > cut)
        return lg ** 2 / (lh + url.RIDGE) + rg ** 2 / (rh + url.RIDGE) - (lg + rg) ** 2 / (lh + rh + url.RIDGE) if min(lh, rh) * 4 >= url.LEAST else 0
    feature, cut, left, right = url.best_splits(rows)[1]
    assert np.isclose(gain(feature, cut), max(gain(f, c) for f in ("depth", "length") for c in range(5)))
    splits, values = {1: ("depth", 2), 2: ("length", 1), 7: ("depth", 9)}, {4: 0.1, 5: 0.2, 3: -1.0, 6: 0.5, 7: 0.7, 14: 1.4, 15: 1.5}
    def walk(row, node=1):
        while node in splits:
            f, c = splits[node]
            node = 2 * node + (row[f] > c)
        return values.get(node, 0.0)
    cases = [{"depth": d, "length": n} for d in range(12) for n in range(4)]
    df = spark.createDataFrame([(c["depth"], c["length"]) for c in cases], "depth int, length int")
    assert [r.v for r in df.coalesce(1).select(url.value_of(splits, values).alias("v")).collect()] == [walk(c) for c in cases]


def test_attention_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in lm.initial(10).items()}
    x, target, weight = rng.standard_normal((2, lm.WINDOW, lm.WIDTH)), rng.integers(0, lm.CLASSES, (2, lm.WINDOW)), rng.random((2, lm.WINDOW))
    loss = lambda: -(np.take_along_axis(lm.forward(p, x)[0], target[..., None], 2)[..., 0] * weight).sum()
    y, cache = lm.forward(p, x)
    grads, dx = lm.backward(p, y, cache, target, weight)
    for name, at in (("qkv", (3, 20)), ("o", (1, 2)), ("w1", (4, 5)), ("w2", (6, 7)), ("place", (8, 3)), ("b1", (2,)), ("b2", (3,))):
        p[name][at] += 1e-5
        up = loss()
        p[name][at] -= 2e-5
        down = loss()
        p[name][at] += 1e-5
        assert np.isclose((up - down) / 2e-5, grads[name][at], rtol=1e-3, atol=1e-6), name


def test_attention_is_causal_and_scores_once():
    p = lm.initial(10)
    x = np.random.default_rng(1).standard_normal((1, lm.WINDOW, lm.WIDTH)).astype(np.float32)
    y, _ = lm.forward(p, x)
    x[0, 20:] += 1
    assert np.allclose(lm.forward(p, x)[0][0, :20], y[0, :20], atol=1e-5)
    lengths = np.array([1, 31, 32, 33, 56, 57, 500])
    seen = Counter()
    for t, f, s in zip(*lm.windows(lengths)):
        for k in range(s, lm.WINDOW):
            if f + k < lengths[t]:
                seen[t, f + k] += 1
    assert set(seen.values()) == {1} and len(seen) == lengths.sum()


def test_attention_windows_overlap_by_a_quarter():
    """A token past a text's first window is scored with at least eight tokens before it."""
    text, first, scored = lm.windows(np.array([33, 57, 500]))
    assert (scored[first > 0] >= 8).all() and (scored[first > 0] >= lm.WINDOW // 4).all()


def test_fit_sample_takes_each_id_once_and_grows(spark, make):
    docs = make([(1, f"copy {k}") for k in range(40)] + [(d, f"text {d}") for d in range(2, 12)] + [(None, "no id")])
    got = {r.doc_id: r.text for r in lm.fit_sample(docs).collect()}
    assert len(got) == 11 and got[1] == "copy 0"
    many = spark.range(40_000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text")
    assert abs(lm.fit_sample(many, 1_000, 0.02).count() - 1_800) < 200
    assert abs(lm.fit_sample(many.where("doc_id < 20000"), 1_000, 0.02).count() - 1_400) < 200


def test_the_fit_reads_every_training_text(spark, make, monkeypatch):
    """Rounds together, and epochs together, read each word of each training row, repeats and rows
    without an id included, whatever their number; with few documents every one reads all."""
    docs = make([(d if d % 50 else None, f"w{d}. " * (d % 40)) for d in range(700)])
    train = docs.where(~lm.fold(docs.doc_id, 7, 2)).repartition(12)  # a parcel each
    want = Counter(w for r in train.collect() for w in lm.tokens(r.text))
    rows = lm.encoded(train, vocabulary("word_bpe_49k.json")).collect()
    own = [lm.parcel([r[c] for c in lm.COLUMNS]) for r in rows]
    assert sum(len(p.codes) for p in own) == sum(p.lengths.sum() for p in own) == sum(want.values())
    assert [r["windows"] for r in rows] == [sum(-(-(n + 1) // lm.WINDOW) for n in p.lengths) for p in own]

    sums, gathered = [], lm.gathered
    def spy(found, width, how):
        k, v = gathered(found, width, how)
        if width == lm.GROUPS:
            sums.append(v[k == k.max()].sum())  # the last row counts units
        return k, v
    monkeypatch.setattr(lm, "gathered", spy)
    monkeypatch.setattr(lm, "SLICE_DOCS", 50)
    lm.fit(train, vocabulary("word_bpe_49k.json"))
    units = sum(-(-len(t) // lm.UNIT) for t in (lm.tokens(r.text) for r in train.collect()))
    assert len(sums) == lm.ROUNDS and np.isclose(sum(sums), units) and max(sums) < 0.3 * units
    monkeypatch.setattr(lm, "SLICE_DOCS", 1_000)
    sums.clear()
    lm.fit(train, vocabulary("word_bpe_49k.json"))
    assert len(sums) == lm.ROUNDS and np.allclose(sums, units)


def test_parameter_rows_round_trip():
    p = lm.initial(10, seed=2)
    back = lm.with_rows(p, lm.parameter_rows(p))
    assert set(back) == set(p) and all((back[k] == p[k]).all() for k in p)


def test_batched_scores_against_a_loop_over_tokens(monkeypatch):
    """Each token from its own window alone: the window that scores it, cut after it."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    encoder = lm.subwords(vocabulary)
    size = encoder.tokenizer.get_vocab_size(with_added_tokens=True)
    net = lm.Network(vocabulary, np.random.default_rng(0).standard_normal((size, lm.GROUPS)).astype(np.float32), lm.initial(size))
    texts = ["", "One.", " ".join(f"word{i % 7}{'.' if i % 9 == 0 else ''}" for i in range(150)), "a b c"]
    own = [lm.tokens(t) for t in texts]
    words = [w for t in own for w in t]
    kind, vectors = net.read(words, encoder)
    per_text = np.array([len(t) + 1 for t in own])
    monkeypatch.setattr(lm, "SCORED", 3)
    got = lm.class_logs(net, vectors, kind, per_text)
    want, at = [], 0
    for t in own:
        v, c = vectors[at:at + len(t)], [*kind[at:at + len(t)], lm.CLASSES - 1]
        at += len(t)
        for i in range(len(t) + 1):
            k = 0 if i < lm.WINDOW else -(-(i + 1 - lm.WINDOW) // lm.STRIDE)
            first = k * lm.STRIDE
            x = np.zeros((1, lm.WINDOW, lm.WIDTH), np.float32)
            for place in range(i - first + 1):
                x[0, place] = net.p["class"][lm.CLASSES - 1] if first + place == 0 else v[first + place - 1]
            want.append(lm.forward(net.p, x)[0][0, i - first, c[i]])
    assert np.allclose(got, want, atol=1e-4)


@pytest.mark.parametrize("head", [50, 50_000])
def test_language_model_counts(spark, odd, make, monkeypatch, head):
    """Base scores and counts against plain Python, with and without a join for rarer words."""
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "ROUNDS", 2)
    docs = odd.unionByName(table(spark, SF, "documents").limit(60).selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "n_chars", "1D AS score", "true AS kept", "'u' AS uid"))
    rows = docs.select("doc_id", "text").collect()
    split = lambda t: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c, ends = Counter(), 0
    for d, t in rows:
        if not held(d):
            c.update(split(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    want = sorted((str(d), held(d), len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1)), 4))
                  for d, t in rows for w in [split(t)])
    got = lm.report(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_language_model_beats_the_base_and_takes_empty_tables(spark, empty):
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    held = [r for r in lm.report(table(spark, SMALL, "documents"), vocabulary).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)
    assert np.mean([r.score > r.base_score for r in held]) > 0.95
    assert lm.report(empty, vocabulary).count() == 0


def test_a_worker_keeps_the_words_it_has_read_for_its_next_task(spark, make):
    """Many more tasks than cores, so that workers run several, give the scores of one task; so
    does a cache that overflows."""
    net = lm.Network(vocabulary("word_bpe_49k.json"), np.random.default_rng(0).normal(size=(60_000, lm.GROUPS)).astype(np.float32), lm.initial(60_000))
    docs = make([(d, " ".join(f"w{(d * k) % 97}x{k}." for k in range(d % 50))) for d in range(400)])
    def scores(df):
        return {r.doc_id: (r.n_tokens, round(r.rest_log, 4), sorted((t.word, t.tf) for t in r.tail)) for r in lm.partial_scores(df, net, {b"w0x0.": 3}, np.zeros(lm.CLASSES), 1).collect()}
    want = scores(docs.coalesce(1))
    assert scores(docs.repartition(60)) == want and len(want) == 400
    held = lm.Words()
    first = held.codes([b"a", b"b.", b"a"], net, {b"a": 9}, lm.subwords(net.vocabulary))
    assert first.tolist() == [0, 1, 0] and len(held.vectors) == len(held.kinds) == len(held.logs) == 2
    held.clear()
    assert held.codes([b"b."], net, {}, lm.subwords(net.vocabulary)).tolist() == [0] and len(held.vectors) == 1

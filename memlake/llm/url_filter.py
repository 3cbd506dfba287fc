"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Everything is column expressions and aggregates. Features are small integers (bins), so the
labelled URLs shrink to one weighted row per distinct feature vector; each level of each tree
is one aggregate over them, of at most nodes x features x bins rows, and the fitted trees are
nested CASE expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from memlake.llm.common import ascii_lower
from memlake.session import cut_lineage

TREES, DEPTH, RATE, RIDGE, LEAST = 10, 3, 0.3, 1.0, 2.0
BINS = 12
#: Weight of the overall block rate in a suffix's own.
SMOOTHING = 20.0
FEATURES = ["length", "depth", "digits", "entropy", "parameters", "labels", "hyphens", "host_length", "suffix", "top"]


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains where the path starts with its path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/")]


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path. Host: after the first "://" up to "/", "?", "#" or the end;
    path: from there up to "?" or "#". Null and other texts have both empty."""
    at = F.instr(F.coalesce("url", F.lit("")), "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", "url", ascii_lower(host).alias("host"), path.alias("path"))


def ruled(parts: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Adds ``rule`` and ``ruled`` (its verdict), null where none fits; the longest wins. Rules
    are part of the plan, so their number is meant to stay in the hundreds."""
    def fit(r: Rule) -> Column:
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        return F.when(fits, F.struct(F.lit(len(r.name)).alias("size"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")))

    best = F.array_max(F.array(*map(fit, rules)))
    return parts.withColumn("__best", best).select(*parts.columns, F.col("__best.rule").alias("rule"), F.col("__best.verdict").alias("ruled"))


def entropy(text: Column) -> Column:
    """Bits per character of a text's own character shares."""
    n = F.greatest(F.length(text), F.lit(1))
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.coalesce(F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p)), F.lit(0.0))


def binned(x: Column, width: float) -> Column:
    return F.least(F.floor(x / width), F.lit(BINS - 1)).cast("int")


def lexical(parts: DataFrame) -> DataFrame:
    """Adds the binned features that a URL has of itself, and its host's suffixes."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    n = F.greatest(F.length(url), F.lit(1))
    labels = F.split(host, r"\.")
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    return parts.withColumns({
        "length": binned(F.length(url), 12), "depth": binned(count(path, "/[^/]"), 1), "digits": binned(count(url, "[0-9]") / n, 0.04),
        "entropy": binned(F.greatest(entropy(url) - 2, F.lit(0.0)), 0.25), "parameters": binned(count(url, "[?&][^?&=#]+="), 1),
        "labels": binned(F.size(labels), 1), "hyphens": binned(count(host, "[-_]"), 1), "host_length": binned(F.length(host), 4),
        "domain": F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), "."), "tld": F.element_at(labels, -1)})


def suffix_rates(labelled: DataFrame, key: str) -> DataFrame:
    """(key, bin) of each host suffix's smoothed block rate. Summed in the map tasks."""
    mean = labelled.agg(F.avg("y")).first()[0] or 0.0
    rates = labelled.groupBy(key).agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    rate = (F.col("y") + SMOOTHING * mean) / (F.col("n") + SMOOTHING)
    return cut_lineage(rates.select(F.col(key).alias(f"__{key}"), binned(rate, 1 / BINS).alias("bin")))


def with_suffixes(parts: DataFrame, domains: DataFrame, tops: DataFrame) -> DataFrame:
    """Adds ``suffix`` and ``top``; an unseen suffix takes the bin -1. Both sides of the joins
    arrive by plain exchanges or a broadcast, so a hot suffix can be split."""
    for rates, key, name in ((domains, "domain", "suffix"), (tops, "tld", "top")):
        parts = parts.join(rates, F.col(key) == F.col(f"__{key}"), "left").withColumn(name, F.coalesce("bin", F.lit(-1))).drop("bin", f"__{key}")
    return parts


def leaf_of(splits: dict[int, tuple[str, int]], node: int = 1) -> Column:
    """Node of a row in a tree of {node: (feature, last bin on the left)}; children of node k
    are 2k and 2k + 1."""
    if node not in splits:
        return F.lit(node)
    feature, cut = splits[node]
    return F.when(F.col(feature) <= cut, leaf_of(splits, 2 * node)).otherwise(leaf_of(splits, 2 * node + 1))


def value_of(splits: dict[int, tuple[str, int]], values: dict[int, float], node: int = 1) -> Column:
    if node not in splits:
        return F.lit(float(values.get(node, 0.0)))
    feature, cut = splits[node]
    return F.when(F.col(feature) <= cut, value_of(splits, values, 2 * node)).otherwise(value_of(splits, values, 2 * node + 1))


def best_splits(rows: list) -> dict[int, tuple[str, int, float, float]]:
    """{node: (feature, cut, left value, right value)} of the best split with a gain, from the
    (node, feature, bin) sums of gradients and their curvature."""
    sums: dict[tuple[int, str], list[tuple[int, float, float]]] = {}
    for node, feature, b, g, h in rows:
        sums.setdefault((node, feature), []).append((b, g, h))
    best: dict[int, tuple] = {}
    for (node, feature), bins in sorted(sums.items()):
        g, h = sum(x[1] for x in bins), sum(x[2] for x in bins)
        left_g = left_h = 0.0
        for b, own_g, own_h in sorted(bins)[:-1]:
            left_g, left_h = left_g + own_g, left_h + own_h
            right_g, right_h = g - left_g, h - left_h
            gain = left_g ** 2 / (left_h + RIDGE) + right_g ** 2 / (right_h + RIDGE) - g ** 2 / (h + RIDGE)
            if min(left_h, right_h) * 4 >= LEAST and gain > (best[node][0] if node in best else 1e-6) + 1e-9:
                best[node] = (gain, feature, b, RATE * left_g / (left_h + RIDGE), RATE * right_g / (right_h + RIDGE))
    return {node: found[1:] for node, found in best.items()}


def boosted(labelled: DataFrame) -> Column:
    """Log odds of "block", fitted to (features, y) rows."""
    vectors = cut_lineage(labelled.groupBy(*FEATURES).agg(F.sum("y").cast("double").alias("y"), F.count(F.lit(1)).cast("double").alias("n")))
    y, n = vectors.agg(F.sum("y"), F.sum("n")).first()
    if not n:
        return F.lit(-1.0)
    odds = F.lit(math.log((y + 1) / (n - y + 1)))
    total = [odds]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES]))
    for _ in range(TREES):
        score = reduce(lambda a, b: a + b, total)
        p = 1 / (1 + F.exp(-score))
        splits: dict[int, tuple[str, int]] = {}
        values: dict[int, float] = {}
        for _ in range(DEPTH):
            rows = vectors.select(leaf_of(splits).alias("node"), (F.col("y") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"), each.alias("e"))
            sums = rows.groupBy("node", "e.feature", "e.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            found = {k: v for k, v in best_splits([tuple(r) for r in sums]).items() if k not in splits}
            if not found:
                break
            for node, (feature, cut, left, right) in found.items():
                splits[node] = (feature, cut)
                values |= {2 * node: left, 2 * node + 1: right}
        if not splits:
            break
        total.append(value_of(splits, values))
    return reduce(lambda a, b: a + b, total)


def judge(pages: DataFrame, rules: list[Rule] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    The rule's verdict holds where one fits; elsewhere the trees', block from even odds up.
    ``labels`` (url, y: 1 for block) trains them; without it the pages that a rule decides are
    the labelled URLs. Without any label the trees allow. Null and empty URLs have empty host
    and path and are judged by the trees like any other.
    """
    parts = ruled(lexical(parsed(pages)), rules)
    if labels is None:
        known = parts.where("ruled IS NOT NULL").withColumn("y", (F.col("ruled") == "block").cast("int"))
    else:
        known = lexical(parsed(labels.withColumn("page_id", F.col("y").cast("int")))).withColumnRenamed("page_id", "y")
    known = cut_lineage(known.select(*[f for f in FEATURES if f not in ("suffix", "top")], "domain", "tld", "y"))
    rates = suffix_rates(known, "domain"), suffix_rates(known, "tld")
    score = boosted(with_suffixes(known, *rates))
    scored = with_suffixes(parts, *rates).withColumn("score", 1 / (1 + F.exp(-score)))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")

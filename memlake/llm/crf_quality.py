"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its evidence is the share of several character classes in it and in
the lines next to it; neighbouring labels lean on each other by a transition weight. Forward
and backward sums give each line's probability of being good; their mean, weighted by line
length, is the document's quality, brought to a calibrated score by a logistic fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memlake.llm.common import fold
from memlake.llm.subwords import parcels
from memlake.llm.toxicity import logistic, sample

#: Bound of the training sample: so many labelled documents of each class, least hash first.
SAMPLE = 1500
CUTS = (0.01, 0.05, 0.15, 0.4)
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t\r", "stop": b".,;:", "loud": b"!?", "bar": b"|/\\<>{}[]=_~^", "symbol": b"#$%&*+@"}
#: What a line is measured by: shares of character classes, and of words that were there just before.
MEASURES = [*CLASSES, "again"]
#: A random value per byte: the sum over a word is its signature.
_SIGN = np.random.default_rng(1).integers(1, 1 << 62, 256, dtype=np.int64)


def line_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts of each class per line, bytes per line, lines per text). A text has one line
    more than newlines."""
    data = "\n".join(texts).encode("utf-8", "replace") + b"\n"
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts = np.zeros((len(ends), len(MEASURES)))
    for k, members in enumerate(CLASSES.values()):
        own = np.zeros(256, np.uint8)
        own[list(members)] = 1
        total = np.concatenate([[0], np.cumsum(own[raw], dtype=np.int32)])
        counts[:, k] = total[ends] - total[starts]
    counts[:, -1] = again(raw, ends)
    return counts, (ends - starts).astype(np.float64), np.array([t.count("\n") + 1 for t in texts], np.int64)


def again(raw: np.ndarray, line_ends: np.ndarray) -> np.ndarray:
    """Bytes per line in words equal to one of the two words before them in the line."""
    stops = np.flatnonzero((raw == 32) | (raw == 10))
    total = np.cumsum(_SIGN[raw])[stops]
    sign, size = np.diff(total, prepend=0) - _SIGN[raw[stops]], np.diff(stops, prepend=-1)
    line = np.searchsorted(line_ends, stops)
    same = np.zeros(len(stops), bool)
    for back in (1, 2):
        same[back:] |= (sign[back:] == sign[:-back]) & (size[back:] == size[:-back]) & (line[back:] == line[:-back])
    same &= size > 1
    return np.bincount(line[same], weights=size[same], minlength=len(line_ends))


def evidence(counts: np.ndarray, length: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Indicator features of each line and of its two neighbours in the same text."""
    share = counts / np.maximum(length, 1)[:, None]
    words = 1 / np.maximum(share[:, list(CLASSES).index("blank")], 0.01)
    own = [share > c for c in CUTS] + [length[:, None] > np.array([0, 20, 80, 400]), words[:, None] > np.array([4, 7, 10, 20])]
    own = np.concatenate(own, axis=1).astype(np.float32)
    first = np.zeros(len(own), bool)
    first[np.concatenate([[0], np.cumsum(per_text)[:-1]])] = True
    last = np.append(first[1:], True)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.concatenate([np.ones((len(own), 1), np.float32), own, before, after, first[:, None], last[:, None]], axis=1)


def buckets(per_text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, line index matrix, mask) of texts with like numbers of lines."""
    starts = np.cumsum(per_text) - per_text
    size = np.ceil(np.log2(per_text)).astype(int)
    for s in np.unique(size):
        own = np.flatnonzero(size == s)
        steps = np.arange(per_text[own].max())
        mask = steps[None] < per_text[own][:, None]
        yield own, np.where(mask, starts[own][:, None] + steps[None], 0), mask


def chain(unary: np.ndarray, mask: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over (texts, lines, 2) scores: line marginals, summed pair marginals and
    the summed log partition. Padding lines are to the right."""
    n, steps, _ = unary.shape
    fwd, bwd = np.zeros_like(unary), np.zeros_like(unary)
    fwd[:, 0] = unary[:, 0]
    for t in range(1, steps):
        new = np.logaddexp(fwd[:, t - 1, :1] + pair[0], fwd[:, t - 1, 1:] + pair[1]) + unary[:, t]
        fwd[:, t] = np.where(mask[:, t, None], new, fwd[:, t - 1])
    for t in range(steps - 2, -1, -1):
        ahead = unary[:, t + 1] + bwd[:, t + 1]
        new = np.logaddexp(ahead[:, :1] + pair[:, 0], ahead[:, 1:] + pair[:, 1])
        bwd[:, t] = np.where(mask[:, t + 1, None], new, 0)
    z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
    marginal = np.exp(np.minimum(fwd + bwd - z[:, None, None], 0))
    pairs = np.zeros((2, 2))
    if steps > 1:
        joint = fwd[:, :-1, :, None] + pair + (unary[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]
        pairs = (np.exp(np.minimum(joint, 0)) * mask[:, 1:, None, None]).sum(axis=(0, 1))
    return marginal, pairs, float(z.sum())


@dataclass
class Quality:
    weights: np.ndarray  # features x (bad, good)
    pair: np.ndarray  # transition scores
    scale: np.ndarray  # logistic weights over (log odds of quality, quality)

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability that a line is good, bytes per line, lines per text)."""
        counts, length, per_text = line_counts(texts)
        unary = evidence(counts, length, per_text) @ self.weights
        good = np.empty(len(unary))
        for _, index, mask in buckets(per_text):
            marginal, _, _ = chain(unary[index], mask, self.pair)
            good[index[mask]] = marginal[..., 1][mask]
        return good, length, per_text

    def quality(self, texts: list[str]) -> np.ndarray:
        good, length, per_text = self.marginals(texts)
        starts = np.cumsum(per_text) - per_text
        weight = length + 1e-3  # a text of blank lines only is the mean of its lines
        return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        return 1 / (1 + np.exp(-np.clip(inputs(self.quality(texts)) @ self.scale[:-1] + self.scale[-1], -30, 30)))


def inputs(quality: np.ndarray) -> np.ndarray:
    q = np.clip(quality, 1e-4, 1 - 1e-4)
    return np.column_stack([np.log(q / (1 - q)), q])


#: Without both classes among the labels every score is one half.
UNTRAINED = Quality(np.zeros((3 * (len(CUTS) * len(MEASURES) + 8) + 3, 2)), np.zeros((2, 2)), np.zeros(3))


def fit(texts: list[str], y: np.ndarray, odds: float = 1.0, rounds: int = 200, ridge: float = 1e-3) -> Quality:
    """``odds``: good documents for a bad one among all labels, to which scores are calibrated.
    Line labels start as the document's. A line regression then clears those lines of bad
    documents that look like good ones (never all of a document), and the chain is trained on
    what is left by gradient steps."""
    if len(set(y.tolist())) < 2:
        return UNTRAINED
    counts, length, per_text = line_counts(texts)
    x = evidence(counts, length, per_text)
    owner = np.repeat(np.arange(len(texts)), per_text)
    label = y[owner].astype(int)
    for _ in range(2):
        # Both classes weigh alike, whatever their share of the sample's lines.
        once = logistic(x[:, 1:], label.astype(float), ridge=1.0)
        p = 1 / (1 + np.exp(-(x[:, 1:] @ once[:-1] + once[-1])))
        worst = np.full(len(texts), 2.0)
        np.minimum.at(worst, owner, p)
        label = np.where((y[owner] == 0) & ((p < label.mean()) | (p <= worst[owner])), 0, 1)
    weights, pair = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    groups = list(buckets(per_text))
    truth = np.eye(2)[label]
    seen = np.zeros((2, 2))
    same = owner[1:] == owner[:-1]
    np.add.at(seen, (label[:-1][same], label[1:][same]), 1)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(pair), np.zeros_like(pair)]
    for step in range(1, rounds + 1):
        unary, expected, pairs = x @ weights, np.zeros((len(x), 2)), np.zeros((2, 2))
        for _, index, mask in groups:
            marginal, own, _ = chain(unary[index], mask, pair)
            expected[index[mask]] = marginal[mask]
            pairs += own
        grads = (x.T @ (truth - expected) / len(x) - ridge * weights, (seen - pairs) / len(x) - ridge * pair)
        for k, (value, g) in enumerate(zip((weights, pair), grads)):  # Adam
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    model = Quality(weights, pair, np.zeros(3))
    model.scale = logistic(inputs(model.quality(texts)), y.astype(float), ridge=0.1)
    model.scale[-1] += np.log(odds * max(1, (y == 0).sum()) / max(1, (y == 1).sum()))
    return model


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Quality:
    """Fit on at most ``size`` labelled documents of each class, none of the held-out fold;
    scores are calibrated to the classes' shares among all training labels."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~fold(F.col("doc_id"), 3, 1))
    good, n = known.agg(F.sum("quality"), F.count(F.lit(1))).first()
    got = sorted((r[0], r[1], r[2] or "") for r in sample(docs.select("doc_id", "text"), labels, "quality", size).collect())
    return fit([r[2] for r in got], np.array([r[1] for r in got]), odds=((good or 0) + 1) / (n - (good or 0) + 1))


def score(docs: DataFrame, model: Quality) -> DataFrame:
    """``docs`` with __score, the probability that the text is of good quality. A null text
    scores as an empty one, which is one empty line. Whole texts are read; nothing moves."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    out = docs.withColumn("__score", F.lit(0.0))
    names, schema = out.columns, out.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            found = [held.value.score(texts[i:j]) for i, j in parcels(texts)]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names) - 1], pa.array(np.concatenate([np.empty(0), *found]))], names=names)

    return out.mapInArrow(work, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row."""
    s = score(docs.select("doc_id", "text"), train(docs, labels))
    return s.select("doc_id", fold(F.col("doc_id"), 3, 1).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))

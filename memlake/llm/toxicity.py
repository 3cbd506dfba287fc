"""Toxicity by a support vector machine with a subsequence string kernel.

The kernel compares two words by their common subsequences of three letters, each occurrence
weighted down by the length it spans, so inserted, dropped or gapped letters cost a little and
not everything. Landmark words give a Nyström map; a linear machine is trained in it. Since
the kernel's own feature space is small (32 ** 3 letter triples), landmarks and weights fold
into one weight per triple, and scoring a word is a sum over its triples.

A sentence scores as its worst word, or run of single spaced letters; a document as its worst
sentence and the number of its words on the wrong side, brought to a probability by a logistic
fit. Training is multi-instance: a toxic document says only that some sentence of it is toxic,
and the machine picks that sentence's witness words anew each round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memlake.llm.common import fold
from memlake.llm.subwords import parcels, release

#: Bound of the training sample: so many labelled documents of each class, least hash first.
SAMPLE = 1500
LANDMARKS, ROUNDS, MINING, THRESHOLD = 96, 2, 3, 0.7
#: Witnesses of a toxic document: so many words at most, within this share of its worst.
WITNESSES, NEAR = 8, 0.25
#: A witness counts only where so many toxic documents have one like it.
SUPPORT, LIKE = 3, 0.6
DECAY, SPAN, LETTERS, SEGMENT = 0.6, 7, 32, 48
#: Words of clean documents that the machine sees at once, beside the hardest ones.
NEGATIVES = 8_000
CACHE = 300_000
OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]

_CODE = np.zeros(0x10000, np.uint16)  # 0: not a letter, only a gap
_CODE[1] = LETTERS - 1  # the ends of a word
for _c in range(26):
    _CODE[97 + _c] = 1 + _c
for _c in range(0xAA, 0x10000):
    if chr(_c).isalpha():
        _CODE[_c] = 27 + _c % 4


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of words in one padded matrix, and the word each row belongs to. A word of
    over SEGMENT characters gives overlapping segments."""
    rows, owner = [], []
    for k, w in enumerate(words):
        if len(w) <= SEGMENT:
            rows.append(w)
            owner.append(k)
        else:
            for i in range(0, len(w) - SPAN, SEGMENT - SPAN):
                rows.append(w[i:i + SEGMENT])
                owner.append(k)
    width = max(map(len, rows), default=1) + 2
    points = np.array([f"\1{r}\1" for r in rows], dtype=f"U{width}").view(np.uint32).reshape(len(rows), -1)
    return _CODE[np.minimum(points, 0xFFFF)], np.array(owner, np.int64)


def triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float, np.ndarray]]:
    """(triple, weight, present) matrices, one for each pair of gaps."""
    wide = codes.astype(np.int32)
    width = wide.shape[1]
    for a, b in OFFSETS:
        if width > b:
            x, y, z = wide[:, :width - b], wide[:, a:width - b + a], wide[:, b:]
            yield (x * LETTERS + y) * LETTERS + z, DECAY ** (b - 2), (x > 0) & (y > 0) & (z > 0)


def by_length(words: list[str], size: int = 4096) -> Iterator[np.ndarray]:
    """Index chunks of words of like length."""
    order = np.argsort([len(w) for w in words], kind="stable")
    for i in range(0, len(order), size):
        yield order[i:i + size]


def weigh(words: list[str], table: np.ndarray) -> np.ndarray:
    """Normalised sum of ``table`` (triples, or triples x m) over each word's triples; a long
    word takes its best segment."""
    out = np.zeros((len(words), *table.shape[1:]), np.float32)
    for chunk in by_length(words, 4096 if table.ndim == 1 else 512):
        codes, owner = letters([words[i] for i in chunk])
        total = np.zeros((len(codes), *table.shape[1:]), np.float32)
        norm = np.zeros(len(codes), np.float32)
        for t, w, present in triples(codes):
            got = table[t] * (present[..., None] if table.ndim > 1 else present)
            total += w * got.sum(axis=1)
            norm += w * w * present.sum(axis=1)
        total /= np.sqrt(np.maximum(norm, 1e-6)).reshape(-1, *[1] * (table.ndim - 1))
        if len(owner) == len(chunk):
            out[chunk] = total
        else:
            best = np.full((len(chunk), *table.shape[1:]), -np.inf, np.float32)
            np.maximum.at(best, owner, total)
            out[chunk] = best
    return out


def features(words: list[str]) -> np.ndarray:
    """Normalised triple vectors of a few words, as columns."""
    out = np.zeros((LETTERS ** 3, len(words)), np.float32)
    codes, owner = letters(words)
    norm = np.zeros(len(words), np.float32)
    for t, w, present in triples(codes):
        who = np.broadcast_to(owner[:, None], t.shape)
        np.add.at(out, (t[present], who[present]), w)
        np.add.at(norm, owner, w * w * present.sum(axis=1))
    return out / np.sqrt(np.maximum(norm, 1e-6))


def spaced(words: list[str], lengths: np.ndarray, cuts: list[int]) -> list[tuple[int, str]]:
    """(document, letters) of runs of four or more single characters within one document."""
    single = lengths == 1
    if not single.any():
        return []
    edge = np.zeros(len(words) + 1, bool)
    edge[np.minimum(cuts, len(words))] = True
    starts = np.flatnonzero(single & (edge[:-1] | ~np.concatenate([[False], single[:-1]])))
    stops = np.flatnonzero(single & (edge[1:] | ~np.concatenate([single[1:], [False]]))) + 1
    long = stops - starts >= 4
    docs = np.searchsorted(cuts, starts[long], side="right") - 1
    return [(d, "".join(words[i:j])) for d, i, j in zip(docs.tolist(), starts[long].tolist(), stops[long].tolist())]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights with the intercept last, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 12) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps on the violating rows; the
    intercept comes last. y is -1 or 1."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    reg = ridge * np.eye(len(w))
    for _ in range(steps):
        live = y * (x @ w) < 1
        a, c = x[live], weight[live]
        w = np.linalg.solve((a * c[:, None]).T @ a + reg, a.T @ (c * y[live]))
    return w


def support(points: np.ndarray, witness: np.ndarray, top: list[np.ndarray]) -> np.ndarray:
    """Documents that have a witness like each of ``witness``, by the cosine of the map."""
    unit = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-6)
    place = {w: k for k, w in enumerate(witness.tolist())}
    held = np.zeros((len(witness), len(top)), np.float32)
    for d, t in enumerate(top):
        for w in t.tolist():
            if w in place:
                held[place[w], d] = 1
    return np.concatenate([((unit[i:i + 512] @ unit.T >= LIKE).astype(np.float32) @ held > 0).sum(axis=1) for i in range(0, len(unit), 512)])


@dataclass
class Toxicity:
    table: np.ndarray  # weight of each triple
    bias: float
    scale: np.ndarray  # logistic weights over (worst word, log of the count of bad words)

    def words(self, words: list[str]) -> np.ndarray:
        return weigh(words, self.table) + self.bias

    def probability(self, worst: np.ndarray, bad: np.ndarray) -> np.ndarray:
        z = self.scale[0] * np.clip(worst, -2, 3) + self.scale[1] * np.log1p(bad) + self.scale[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Without both classes among the labels there is nothing to learn: every score is zero.
UNTRAINED = Toxicity(np.zeros(LETTERS ** 3, np.float32), -1.0, np.array([0.0, 0.0, -30.0]))


def sample(docs: DataFrame, labels: DataFrame, label: str, size: int) -> DataFrame:
    """(doc_id, y, text) of at most ``size`` labelled training documents of each class; of an id's
    rows the least text."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    known = known.where(~fold(F.col("doc_id"), 3, 1))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("y = 1").orderBy(*order).limit(size).union(known.where("y = 0").orderBy(*order).limit(size))
    ids = F.broadcast(picked.select(F.col("doc_id").alias("__id"), F.col("y").cast("int").alias("__y")))  # 2 x size rows
    rows = docs.join(ids, F.col("doc_id") == F.col("__id"))
    return rows.groupBy("doc_id", F.col("__y").alias("y")).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def bags(rows: DataFrame) -> tuple[list[list[str]], np.ndarray]:
    """Each sampled document's distinct words, over all its sentences, and its label."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = []
            for t in b.column(2).to_pylist():
                words = (t or "").lower().split()
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                own.append(sorted({*words, *(s for _, s in spaced(words, lengths, [0]))}))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.list_(pa.string()))], names=["doc_id", "y", "words"])

    got = sorted(tuple(r) for r in rows.mapInArrow(work, "doc_id bigint, y int, words array<string>").collect())
    return [r[2] for r in got], np.array([r[1] for r in got])


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Toxicity:
    """Fit on at most ``size`` labelled documents of each class, none of the held-out fold."""
    return fit(*bags(sample(docs.select("doc_id", "text"), labels, "toxic", size)))


def fit(own: list[list[str]], y: np.ndarray) -> Toxicity:
    if len(set(y.tolist())) < 2:
        return UNTRAINED
    names: dict[str, int] = {}
    sets = [np.array([names.setdefault(w, len(names)) for w in words], np.int64) for words in own]
    words = list(names)
    pos = [s for s, t in zip(sets, y) if t and len(s)]
    neg = [s for s, t in zip(sets, y) if not t and len(s)]
    if not pos or not neg:
        return UNTRAINED
    in_pos, in_neg = (np.bincount(np.concatenate(g), minlength=len(words)) for g in (pos, neg))

    # First guess: log odds of the triples between toxic and clean documents.
    counts = np.zeros((LETTERS ** 3, 2))
    for chunk in by_length(words):
        codes, owner = letters([words[i] for i in chunk])
        for t, w, present in triples(codes):
            who = chunk[np.broadcast_to(owner[:, None], t.shape)[present]]
            for k, df in enumerate((in_pos, in_neg)):
                counts[:, k] += np.bincount(t[present], weights=w * df[who], minlength=LETTERS ** 3)
    rate = (counts + 1) / (counts.sum(axis=0) + 1)
    odds = np.log(rate[:, 0] / rate[:, 1]).astype(np.float32)
    score = weigh(words, odds)
    score[in_neg > 0] = np.minimum(score[in_neg > 0], 0)

    clean = np.flatnonzero(in_neg)
    clean = clean[np.argsort([zlib.crc32(words[i].encode()) for i in clean], kind="stable")]
    table, bias = odds, 0.0
    for _ in range(ROUNDS):
        # Witnesses: the worst words of each toxic document.
        top = [s[np.argsort(-score[s], kind="stable")[:WITNESSES]] for s in pos]
        top = [t[score[t] > NEAR * score[t[0]]] if score[t[0]] > 0 else t[:1] for t in top]
        witness, often = np.unique(np.concatenate(top), return_counts=True)
        witness, often = witness[in_neg[witness] == 0], often[in_neg[witness] == 0]
        if not len(witness):
            return UNTRAINED
        hard = clean[np.argsort(-score[clean], kind="stable")[:NEGATIVES // 4]]
        bad = np.unique(np.concatenate([clean[:NEGATIVES], hard]))
        marks = [words[i] for i in [*witness[np.argsort(-often * np.maximum(score[witness], 0), kind="stable")][:LANDMARKS // 2], *hard[:LANDMARKS // 4], *clean[:LANDMARKS // 4]]]
        phi = features(list(dict.fromkeys(marks)))
        values, vectors = np.linalg.eigh((phi.T @ phi).astype(np.float64))
        live = values > 1e-4 * values[-1]
        nystrom = (phi @ (vectors[:, live] / np.sqrt(values[live])).astype(np.float32)).astype(np.float32)
        seen = weigh([words[i] for i in witness], nystrom)
        backed = support(seen, witness, top) >= SUPPORT
        if backed.any():
            witness, often, seen = witness[backed], often[backed], seen[backed]
        clear = weigh([words[i] for i in bad], nystrom)
        for _ in range(MINING):  # the hardest clean words join and the machine is trained again
            target = np.concatenate([np.ones(len(witness)), -np.ones(len(bad))])
            share = np.concatenate([often / often.sum(), np.full(len(bad), 1 / len(bad))])
            w = machine(np.concatenate([seen, clear]), target, share)
            table, bias = (nystrom @ w[:-1].astype(np.float32)).astype(np.float32), float(w[-1])
            score = weigh(words, table) + bias
            more = clean[np.argsort(-score[clean], kind="stable")[:NEGATIVES // 4]]
            more = np.setdiff1d(more[score[more] > -1], bad)
            if not len(more):
                break
            bad, clear = np.concatenate([bad, more]), np.concatenate([clear, weigh([words[i] for i in more], nystrom)])
    worst = np.array([score[s].max() if len(s) else -2.0 for s in sets])
    bad = np.array([(score[s] > 0).sum() for s in sets])
    scale = logistic(np.column_stack([np.clip(worst, -2, 3), np.log1p(bad)]), y.astype(float), ridge=0.03)
    return Toxicity(table, bias, scale)


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """``docs`` with __score, the probability that the text is toxic. A null, empty or blank
    text scores as one without a bad word. Whole texts are read; nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    out = docs.withColumn("__score", F.lit(0.0))
    names, schema = out.columns, out.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own = held.value
        known: dict[str, float] = {}
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            found = [scored(texts[i:j], own, known) for i, j in parcels(texts)]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names) - 1], pa.array(np.concatenate([np.empty(0), *found]))], names=names)

    return out.mapInArrow(work, schema)


def scored(texts: list[str], model: Toxicity, known: dict[str, float]) -> np.ndarray:
    """Probabilities; ``known`` keeps the values of words seen before, up to a bound."""
    if len(known) > CACHE:
        known.clear()
    words: list[str] = []
    cuts = []
    for t in texts:
        cuts.append(len(words))
        words += t.lower().split()
    ends = np.append(cuts[1:], len(words)).astype(np.int64)
    values = list(map(known.get, words))
    if None in values:
        new = list(dict.fromkeys(w for w, v in zip(words, values) if v is None))
        known.update(zip(new, model.words(new).tolist()))
        values = list(map(known.get, words))
    f = np.array(values, np.float64)
    worst, bad = np.full(len(texts), -2.0), np.zeros(len(texts))
    full = np.flatnonzero(ends > np.array(cuts))
    if len(full):
        starts = np.array(cuts)[full]
        worst[full] = np.maximum.reduceat(f, starts)
        bad[full] = np.add.reduceat(f > 0, starts)
    runs = spaced(words, np.fromiter(map(len, words), np.int64, len(words)), cuts)
    if runs:
        for (d, _), v in zip(runs, model.words([s for _, s in runs]).tolist()):
            worst[d] = max(worst[d], v)
            bad[d] += v > 0
    return model.probability(worst, bad)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row. Repeated labels of one id count as toxic if
    any does; labels other than 0 and 1, and null ids, teach nothing."""
    s = score(docs.select("doc_id", "text"), train(docs, labels))
    return s.select("doc_id", fold(F.col("doc_id"), 3, 1).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that score under ``threshold``, with their own columns."""
    return score(docs, train(docs, labels)).where(F.col("__score") < threshold).drop("__score")

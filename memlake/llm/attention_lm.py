"""Language-model scores from a small causal self-attention network.

A token is a word or the end of a text. Each is read through its subword ids: their embeddings
and a class made from them (a latent group of subwords, and how the word ends). The network
attends over the tokens before and gives the next one's class; within its class a word has the
probability that its count in the whole training corpus gives it, add-one smoothed as in the
base. An unseen word is the unseen type of its class, as it is one type in the base.

Counts, groups and network are learned from all training documents. These are encoded once, in
parcels dealt into slices; a round of the groups or an epoch of the network takes one slice, so
that all rounds, and all epochs, together read each word of a large corpus once and those of a
small one several times. The groups are sums of expected counts; the network takes steps in each
partition, whose results are averaged after every epoch. Only rows of the parameters, as many as
the vocabulary has subwords, reach the driver.

Texts are scored in overlapping windows, many at once, each token once and with at least
``WINDOW - STRIDE`` tokens of context where the text has them. Counts of the commonest words go
to the tasks as a table of bounded size; the rest meet their counts in a join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from memlake.llm.common import ascii_lower, fold
from memlake.llm.subwords import Subwords, parcels, subwords
from memlake.llm.token_files import scratch
from memlake.session import cut_lineage

#: A round or an epoch takes at least this many training documents, all if there are fewer. A
#: partition of the fit holds about FIT_TASK.
SLICE_DOCS, FIT_TASK = 1_000, 15_000
#: ``fit_sample`` takes this many documents and this share of all, FIT_DOCS a partition.
FIT_BASE, FIT_SHARE, FIT_DOCS = 1_000, 0.02, 500
#: Rounds over the groups' statistics, epochs over the network's windows, windows a step.
ROUNDS, EPOCHS, BATCH = 10, 3, 64
#: Words that are taken to be of one group when groups are fitted.
UNIT = 16
#: Windows scored at once: their arrays stay in a core's cache.
SCORED = 64
WINDOW, STRIDE, WIDTH, HIDDEN = 32, 24, 16, 32
GROUPS, SHAPES = 8, 3
CLASSES = GROUPS * SHAPES + 1  # the last is the end of a text
#: Commonest words whose counts every task holds.
HEAD = 50_000
CACHE = 400_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered."""
    return text.encode("utf-8", "replace").translate(_LOWER).split()


def shapes(words: list[bytes]) -> np.ndarray:
    """0: ends a sentence, 1: ends in another mark, 2: ends in a letter or digit."""
    last = np.array([w[-1] for w in words], np.uint8)
    letter = (last >= 128) | ((last >= 97) & (last <= 122)) | ((last >= 48) & (last <= 57))
    return np.where(letter, 2, np.where(np.isin(last, list(b".!?")), 0, 1))


def pieces(words: list[bytes], encoder: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids in a row and the count of each word. A word without any has id 0."""
    ids, counts = encoder.encode_words([w.decode("utf-8", "replace") for w in words])
    if (counts == 0).any():
        ids = np.insert(ids, np.cumsum(counts)[counts == 0], 0)
        counts = np.maximum(counts, 1)
    return ids.astype(np.int64), counts


@dataclass
class Network:
    """Parameters; ``latent`` is (subwords x groups) log probabilities."""

    vocabulary: str
    latent: np.ndarray
    p: dict[str, np.ndarray]

    def read(self, words: list[bytes], encoder: Subwords) -> tuple[np.ndarray, np.ndarray]:
        """(class, vector) of each word."""
        ids, counts = pieces(words, encoder)
        own = self.classes(ids, counts, shapes(words))
        mean = np.add.reduceat(self.p["piece"][ids], np.cumsum(counts) - counts, axis=0) / counts[:, None].astype(np.float32)
        return own, (mean + self.p["class"][own]).astype(np.float32)

    def classes(self, ids: np.ndarray, counts: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Class of each word, given its subword ids in a row, their number and its shape."""
        group = np.add.reduceat(self.latent[ids], np.cumsum(counts) - counts, axis=0).argmax(axis=1)
        return (group * SHAPES + shape).astype(np.int32)


def initial(size: int, seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    return {
        "piece": (0.1 * r.standard_normal((size, WIDTH))).astype(np.float32), "class": (0.5 * r.standard_normal((CLASSES, WIDTH))).astype(np.float32),
        "place": (0.1 * r.standard_normal((WINDOW, WIDTH))).astype(np.float32), "qkv": draw(WIDTH, 3 * WIDTH), "o": draw(WIDTH, WIDTH),
        "w1": draw(WIDTH, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": draw(HIDDEN, CLASSES), "b2": np.zeros(CLASSES, np.float32)}


SEEN = np.tri(WINDOW, dtype=np.float32)
#: Attention scores and logits are cut at this size, so that their exponentials neither overflow nor vanish.
BOUND = 60


def forward(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(log probabilities of classes, what the backward pass needs) of (windows, places, width)
    inputs: place t holds the token before the one that it predicts."""
    shape = x.shape
    x = (x + p["place"]).reshape(-1, WIDTH)
    q, k, v = np.split((x @ p["qkv"]).reshape(*shape[:2], 3 * WIDTH), 3, axis=2)
    a = q @ k.transpose(0, 2, 1)
    a *= WIDTH ** -0.5
    np.clip(a, -BOUND, BOUND, out=a)
    np.exp(a, out=a)
    a *= SEEN
    a *= 1 / (a @ np.ones((shape[1], 1), a.dtype))
    o = (a @ v).reshape(-1, WIDTH)
    h = o @ p["o"]
    h += x
    r = h @ p["w1"]
    r += p["b1"]
    np.maximum(r, 0, out=r)
    y = r @ p["w2"]
    y += p["b2"]
    np.clip(y, -BOUND, BOUND, out=y)
    y -= np.log(np.exp(y) @ np.ones((CLASSES, 1), y.dtype))
    return y.reshape(*shape[:2], CLASSES), {"x": x, "q": q, "k": k, "v": v, "a": a, "o": o, "h": h, "r": r}


def backward(p: dict[str, np.ndarray], y: np.ndarray, c: dict[str, np.ndarray], target: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the weighted log loss, and those of the inputs."""
    shape = (*y.shape[:2], WIDTH)
    dy = np.exp(y).reshape(-1, CLASSES)
    dy[np.arange(len(dy)), target.ravel()] -= 1
    dy *= weight.reshape(-1, 1)
    g = {"w2": c["r"].T @ dy, "b2": dy.sum(0)}
    dr = dy @ p["w2"].T
    dr *= c["r"] > 0
    g |= {"w1": c["h"].T @ dr, "b1": dr.sum(0)}
    dh = dr @ p["w1"].T
    g["o"] = c["o"].T @ dh
    do = (dh @ p["o"].T).reshape(shape)
    ds = do @ c["v"].transpose(0, 2, 1)
    dqkv = np.empty((*shape[:2], 3 * WIDTH), dy.dtype)
    dqkv[..., 2 * WIDTH:] = c["a"].transpose(0, 2, 1) @ do
    ds -= (do * c["o"].reshape(shape)) @ np.ones((WIDTH, 1), dy.dtype)
    ds *= c["a"]
    ds *= WIDTH ** -0.5
    dqkv[..., :WIDTH] = ds @ c["k"]
    dqkv[..., WIDTH:2 * WIDTH] = ds.transpose(0, 2, 1) @ c["q"]
    flat = dqkv.reshape(-1, 3 * WIDTH)
    g["qkv"] = c["x"].T @ flat
    dh += flat @ p["qkv"].T
    dx = dh.reshape(shape)
    g["place"] = dx.sum(0)
    return g, dx


def windows(lengths: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first token, first scored place) of every window over texts of ``lengths``."""
    n = 1 + np.maximum(0, -(-(lengths - WINDOW) // stride))
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, k * stride, np.where(k > 0, WINDOW - stride, 0)


@dataclass
class Parcel:
    """Texts with words, encoded: words of each text, codes of all words in a row, and by code the
    subword ids in a row, their numbers and the words' shapes."""

    lengths: np.ndarray
    codes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    shape: np.ndarray

    def row(self) -> list[bytes]:
        return [x.astype(np.uint8 if k == "shape" else np.int32).tobytes() for k, x in vars(self).items()]


def parcel(row: list[bytes]) -> Parcel:
    *most, shape = row
    return Parcel(*(np.frombuffer(x, np.int32).astype(np.int64) for x in most), np.frombuffer(shape, np.uint8))


def encode(texts: list[str], encoder: Subwords) -> Parcel | None:
    """None without words."""
    own = [t for t in map(tokens, texts) if t]
    if not own:
        return None
    names: dict[bytes, int] = {}
    codes = np.array([names.setdefault(w, len(names)) for t in own for w in t], np.int64)
    return Parcel(np.array([len(t) for t in own]), codes, *pieces(list(names), encoder), shapes(list(names)))


def group_sums(own: Parcel, table: np.ndarray | None, prior: np.ndarray | None, size: int, seed: int = 3) -> np.ndarray:
    """Expected counts of the subwords in each group, and in the last row of the groups' units:
    one expectation step over units (runs of up to UNIT words of a text), by chance without a
    table."""
    per_text = -(-own.lengths // UNIT)
    k = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    starts = np.repeat(np.cumsum(own.lengths) - own.lengths, per_text) + k * UNIT
    if table is None:
        belongs = np.random.default_rng([seed, len(own.codes), int(own.ids[0])]).dirichlet(np.ones(GROUPS), len(starts))
    else:
        words = np.add.reduceat(table[own.ids], np.cumsum(own.counts) - own.counts, axis=0)
        score = np.add.reduceat(words[own.codes], starts, axis=0) + prior
        score -= score.max(axis=1, keepdims=True)
        belongs = np.exp(score)
        belongs /= belongs.sum(axis=1, keepdims=True)
    unit = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(own.codes))))
    out = np.empty((size + 1, GROUPS))
    for g in range(GROUPS):
        words = np.bincount(own.codes, weights=belongs[:, g][unit], minlength=len(own.counts))
        out[:-1, g] = np.bincount(own.ids, weights=np.repeat(words, own.counts), minlength=size)
    out[-1] = belongs.sum(axis=0)
    return out


def parameter_rows(p: dict[str, np.ndarray]) -> np.ndarray:
    """All parameters but the subwords' vectors as rows of WIDTH numbers."""
    return np.concatenate([np.resize(np.append(p[k].ravel(), np.zeros(-p[k].size % WIDTH, np.float32)), (-(-p[k].size // WIDTH), WIDTH)) for k in sorted(p) if k != "piece"])


def with_rows(p: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    """``p`` with the parameters that ``parameter_rows`` gave."""
    out, at = {"piece": p["piece"]}, 0
    for k in sorted(p):
        if k != "piece":
            n = -(-p[k].size // WIDTH)
            out[k] = rows[at:at + n].ravel()[:p[k].size].reshape(p[k].shape).astype(np.float32)
            at += n
    return out


def touched(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values of ``at``, the place of each of ``at`` among them); values below ``size``."""
    mark = np.zeros(size, bool)
    mark[at] = True
    own = np.flatnonzero(mark)
    place = np.empty(size, np.int64)
    place[own] = np.arange(len(own))
    return own, place[at]


def added(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``rows`` by ``at``."""
    width = rows.shape[1]
    where = (at[:, None] * width + np.arange(width)).ravel()
    return np.bincount(where, weights=rows.ravel(), minlength=size * width).reshape(size, width).astype(np.float32)


def descend(net: Network, parcels_of: Iterable[Parcel], epoch: int, steps: float, epochs: int = EPOCHS) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """One pass of Adam over all windows of the parcels, of which some ``steps`` batches are
    expected: the parameters, with vectors of only those subwords that occur, and these subwords.
    Vectors of subwords move in the steps whose windows hold them."""
    p = {k: v.copy() for k, v in net.p.items()}
    slots = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    used = np.zeros(len(p["piece"]), bool)
    place, step = np.arange(WINDOW), 0
    for own in parcels_of:
        used[own.ids] = True
        starts = np.cumsum(own.counts) - own.counts
        kind = net.classes(own.ids, own.counts, own.shape)
        lengths = own.lengths + 1  # with its end
        text, first, _ = windows(lengths, WINDOW)
        begin = np.cumsum(own.lengths) - own.lengths
        order = np.random.default_rng([11, epoch]).permutation(len(text))
        for b in np.split(order, range(BATCH, len(order), BATCH)):
            step += 1
            length = lengths[text[b], None]
            at = first[b, None] + place  # token in its text
            real = at < length
            tok = np.minimum(begin[text[b], None] + at, len(own.codes) - 1)
            target = np.where(at == length - 1, CLASSES - 1, kind[own.codes[tok]])
            before = own.codes[np.maximum(tok - 1, 0)]
            start = (at == 0).ravel()
            # A distinct word's vector: its subwords' mean and its class; a text starts with the end class.
            word, back = touched(before.ravel(), len(own.counts))
            n = own.counts[word]
            ends = np.cumsum(n)
            piece, flat = touched(own.ids[np.repeat(starts[word] - (ends - n), n) + np.arange(ends[-1])], len(used))
            vectors = p["piece"][piece]
            mean = np.add.reduceat(vectors[flat], ends - n, axis=0) / n[:, None].astype(np.float32)
            which = np.where(start, CLASSES - 1, kind[word][back])
            x = p["class"][which]
            x += mean[back] * ~start[:, None]
            y, cache = forward(p, x.reshape(len(b), WINDOW, WIDTH))
            weight = real.astype(np.float32)
            g, dx = backward(p, y, cache, target, weight / weight.sum())
            dx = dx.reshape(-1, WIDTH)
            g["class"] = added(which, dx, CLASSES)
            per_word = added(back, dx * ~start[:, None], len(word)) / n[:, None].astype(np.float32)
            g["piece"] = added(flat, np.repeat(per_word, n, axis=0), len(piece))
            rate = 0.01 * min(1, (epoch * steps + step) / 20) * (1 - 0.9 * (epoch + min(1, step / steps)) / epochs)
            for k, value in p.items():
                rows = piece if k == "piece" else slice(None)
                m, v = slots[k][0][rows], slots[k][1][rows]
                m += 0.1 * (g[k] - m)
                v += 0.01 * (g[k] ** 2 - v)
                value[rows] -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
                slots[k][0][rows], slots[k][1][rows] = m, v
    own = np.flatnonzero(used)
    return p | {"piece": p["piece"][own]}, own


COLUMNS = ("lengths", "codes", "ids", "counts", "shape")
PARCEL = "slice int, windows int, " + ", ".join(f"{c} binary" for c in COLUMNS)


def encoded(train: DataFrame, vocabulary: str) -> DataFrame:
    """Parcels of the training texts, numbered in turn from each partition's own number on."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = subwords(vocabulary), TaskContext.get().partitionId()
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in parcels(texts):
                if own := encode(texts[i:j], encoder):
                    n = len(windows(own.lengths + 1, WINDOW)[0])
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([n], pa.int32()), *(pa.array([x], pa.binary()) for x in own.row())], names=["slice", "windows", *COLUMNS])
                    number += 1

    return train.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, PARCEL)


def parcels_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Parcel]:
    for b in batches:
        for k in range(b.num_rows):
            yield parcel([c[k].as_py() for c in b.columns])


def fit(train: DataFrame, vocabulary: str) -> Network:
    """Groups and network from all texts of ``train``. Without words the network is the one that
    training begins with."""
    spark = train.sparkSession
    size = subwords(vocabulary).tokenizer.get_vocab_size(with_added_tokens=True)
    docs = train.count()
    units = cut_lineage(encoded(train, vocabulary)).coalesce(max(1, -(-docs // FIT_TASK)))
    net = Network(vocabulary, np.zeros((size, GROUPS), np.float32), initial(size))
    total, numbers, tasks = units.select("windows", "slice", F.spark_partition_id().alias("task")).agg(F.sum("windows"), F.countDistinct("slice"), F.countDistinct("task")).first()
    if not total:
        return net

    def slices(of: int) -> int:
        return max(1, min(of, docs // SLICE_DOCS, numbers))

    def part(k: int, of: int) -> DataFrame:
        return units.where(F.col("slice") % of == k % of).select(*COLUMNS)

    of = slices(ROUNDS)
    table = prior = None
    found: list[np.ndarray] = []
    for k in range(ROUNDS):
        held = spark.sparkContext.broadcast((table, prior))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((size + 1, GROUPS))
            for own in parcels_in(batches):
                sums += group_sums(own, *held.value, size)
            own = np.flatnonzero(sums.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(pa.array(sums[own, g]) for g in range(GROUPS))], names=["k", *(f"v{g}" for g in range(GROUPS))])

        at, sums = gathered(part(k, of).mapInArrow(expect, "k int, " + ", ".join(f"v{g} double" for g in range(GROUPS))), GROUPS, F.sum)
        # The latest sums of every slice, later rounds with more weight.
        found = [*found, np.zeros((size + 1, GROUPS))][-of:]
        found[-1][at] = (k + 1) * sums
        both = sum(found) / (k + 1)
        if not both.any():
            continue
        counts = both[:-1] + 0.02
        table, prior = np.log(counts / counts.sum(axis=0)), np.log(both[-1] / both[-1].sum() + 1e-9)
    net.latent = table.astype(np.float32)

    of = slices(EPOCHS)
    steps = max(1, total / (BATCH * of * tasks))
    for epoch in range(EPOCHS):
        model = spark.sparkContext.broadcast(net)

        def learn(batches: Iterator[pa.RecordBatch], epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            p, used = descend(model.value, parcels_in(batches), epoch, steps)
            if len(used):
                small = parameter_rows(p)
                rows = np.concatenate([small, p["piece"]]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([-1 - np.arange(len(small)), used]), pa.int32()), *(pa.array(rows[:, j]) for j in range(WIDTH))], names=["k", *(f"v{j}" for j in range(WIDTH))])

        k, means = gathered(part(epoch, of).mapInArrow(learn, "k int, " + ", ".join(f"v{j} double" for j in range(WIDTH))), WIDTH, F.avg)
        small = means[k < 0][np.argsort(-k[k < 0])]
        net = Network(vocabulary, net.latent, with_rows(net.p, small) if len(small) else net.p)
        net.p["piece"] = net.p["piece"].copy()
        net.p["piece"][k[k >= 0]] = means[k >= 0]
    return net


def gathered(rows: DataFrame, width: int, how) -> tuple[np.ndarray, np.ndarray]:
    """(k, values) of rows summed or averaged by k: at most one a subword and parameter row."""
    t = rows.groupBy("k").agg(*[how(f"v{j}").alias(f"v{j}") for j in range(width)]).toArrow()
    return t["k"].to_numpy(), np.stack([t[f"v{j}"].to_numpy() for j in range(width)], axis=1) if t.num_rows else np.empty((0, width))


def class_logs(net: Network, vectors: np.ndarray, kind: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Natural log of each token's class given those before, for texts in a row. ``vectors`` and
    ``kind`` are of all words; each text is followed by its end, ``per_text`` counts both."""
    out = np.empty(per_text.sum())
    text, first, scored = windows(per_text)
    begin = np.cumsum(per_text) - per_text
    place = np.arange(WINDOW)
    # Row t of this table is what is read before token t: the end class before a text's first.
    target = np.full(len(out), CLASSES - 1, np.int64)
    word = np.ones(len(out), bool)
    word[begin + per_text - 1] = False
    target[word] = kind
    reads = np.empty((len(out) + 1, WIDTH), np.float32)
    reads[:] = net.p["class"][CLASSES - 1]
    reads[1:][word] = vectors
    for i in range(0, len(text), SCORED):
        t, f, s = text[i:i + SCORED], first[i:i + SCORED], scored[i:i + SCORED]
        at = f[:, None] + place
        real = (at < per_text[t][:, None]) & (place >= s[:, None])
        tok = np.minimum(begin[t][:, None] + at, len(out) - 1)
        y, _ = forward(net.p, reads[tok])
        where = tok[real]
        out[where] = y[real, target[where]]
    return out


def counted(docs: DataFrame) -> DataFrame:
    """(word, c) over the training documents' whole texts, combined in the map tasks."""
    words = F.split(ascii_lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+", -1)
    train = docs.where(~fold(F.col("doc_id"), 7, 2))
    return train.select(F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("c"))


def class_totals(counts: DataFrame, net: Network) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, types) of each class over all counted words."""
    held = counts.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = held.value, np.zeros((2, CLASSES))
        encoder = subwords(own.vocabulary)
        for b in batches:
            kind, _ = own.read([w.encode("utf-8", "replace") for w in b.column(0).to_pylist()], encoder) if len(b) else (np.empty(0, np.int64), None)
            sums += np.stack([np.bincount(kind, weights=b.column(1).to_numpy(), minlength=CLASSES), np.bincount(kind, minlength=CLASSES)])
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64))], names=["kind", "n", "v"])

    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.mapInArrow(work, "kind int, n bigint, v bigint").groupBy("kind").agg(F.sum("n"), F.sum("v")).collect():
        n[r[0]], v[r[0]] = r[1], r[2]
    return n, v


def commonest(counts: DataFrame, most: int) -> dict[bytes, int]:
    """Words above the least count step that leaves at most ``most`` of them, with their counts.
    Steps are an eighth of a doubling, so the histogram is a few hundred rows, and no task sends
    the driver more than its share of the words kept."""
    step = F.floor(F.log2("c") * 8)
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    kept, least = 0, None
    for at, n in sizes:
        kept += n
        if kept > most:
            break
        least = at
    if least is None:
        return {}
    return {r[0].encode("utf-8", "replace"): r[1] for r in counts.where(step >= least).collect()}


class Words:
    """Words read with a model: their codes, and by code their classes, vectors, log counts and
    the words. -1 marks a word whose count the task does not hold."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.kinds, self.vectors, self.logs, self.words = np.empty(0, np.int32), np.empty((0, WIDTH), np.float32), np.empty(0), []

    def codes(self, words: list[bytes], net: Network, head: dict[bytes, int], encoder: Subwords) -> np.ndarray:
        """Codes of ``words``; those not known yet are read."""
        codes = list(map(self.known.get, words))
        if None in codes:
            new = list(dict.fromkeys(w for w, c in zip(words, codes) if c is None))
            kind, vector = net.read(new, encoder)
            log = np.array([head.get(w, -1) for w in new], np.float64)
            self.kinds, self.vectors = np.concatenate([self.kinds, kind]), np.concatenate([self.vectors, vector])
            self.logs = np.concatenate([self.logs, np.where(log < 0, -1, np.log10(np.maximum(log, 0) + 1))])
            self.known.update(zip(new, range(len(self.words), len(self.words) + len(new))))
            self.words += new
            codes = list(map(self.known.get, words))
        return np.array(codes, np.int64)


@lru_cache(maxsize=1)
def words_read(name: str) -> Words:
    """What a Python worker has read with the model of that name, for the tasks it runs one after
    another. Tasks reach it by this call alone: a module's variable that a task's own function
    names is sent with the function, and then is not the module's."""
    return Words()


PART = "uid bigint, doc_id bigint, n_tokens bigint, head_known bigint, head_log double, rest_log double, tail array<struct<word:string,tf:bigint>>"
TAIL = pa.list_(pa.struct([("word", pa.string()), ("tf", pa.int64())]))


def partial_scores(docs: DataFrame, net: Network, head: dict[bytes, int], class_log: np.ndarray, ends: int) -> DataFrame:
    """Per document what a task can tell alone: the class terms of every token, the count terms
    of common words and of the end, and its other words with their numbers."""
    name = uuid.uuid4().hex
    held = docs.sparkSession.sparkContext.broadcast((net, head, class_log, ends))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, head, class_log, ends = held.value
        encoder = subwords(net.vocabulary)
        held_words = words_read(name)
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in parcels(texts, 1_000_000):
                own = [tokens(t) for t in texts[i:j]]
                words = [w for t in own for w in t]
                n = np.array([len(t) for t in own], np.int64)
                if len(held_words.words) > CACHE:
                    held_words.clear()
                at = held_words.codes(words, net, head, encoder)
                kinds, logs, names = held_words.kinds, held_words.logs, held_words.words
                per_text = n + 1
                stops = np.cumsum(per_text)
                terms = class_logs(net, held_words.vectors[at], kinds[at], per_text) / np.log(10)
                word = np.ones(len(terms), bool)
                word[stops - 1] = False
                terms[word] -= class_log[kinds[at]]
                rest = np.add.reduceat(terms, stops - per_text)
                common = logs[at] >= 0
                doc = np.repeat(np.arange(len(own)), n)
                head_log = np.bincount(doc[common], weights=logs[at[common]], minlength=len(own))
                head_known = np.bincount(doc[common], minlength=len(own))
                pair, tf = np.unique(doc[~common] * len(names) + at[~common], return_counts=True)
                cuts = np.searchsorted(pair, np.arange(len(own) + 1) * len(names))
                tail = pa.StructArray.from_arrays([pa.array([names[k].decode("utf-8", "replace") for k in (pair % max(1, len(names))).tolist()], pa.string()), pa.array(tf, pa.int64())], names=["word", "tf"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(uid, uid + len(own)), pa.int64()), pa.array(ids[i:j], pa.int64()), pa.array(per_text), pa.array(head_known + (ends > 0)),
                    pa.array(head_log), pa.array(rest), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), tail, type=TAIL)], names=["uid", "doc_id", "n_tokens", "head_known", "head_log", "rest_log", "tail"])
                uid += len(own)

    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, PART)


def fit_sample(train: DataFrame, base: int = FIT_BASE, part: float = FIT_SHARE) -> DataFrame:
    """For trial fits only, ``report`` fits on all: (doc_id, text) of about ``base`` documents and
    a share of all, by the hash of their ids; of an id's rows the least text. Held, in partitions
    of about FIT_DOCS documents."""
    ids = train.select("doc_id").where("doc_id IS NOT NULL").distinct().count()
    want = min(ids, base + part * ids)
    chosen = train.where("doc_id IS NOT NULL") if want == ids else train.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * want / ids))
    one = chosen.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return cut_lineage(one.repartition(max(1, -(-int(want) // FIT_DOCS)), "doc_id"))


def report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score (both log10 of the probability of the text).

    A null, empty or blank text is its end alone. Rows without an id train and are scored.
    Without training rows every count is zero. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    train = docs.where(~fold(F.col("doc_id"), 7, 2))
    counts = cut_lineage(counted(docs))
    total, types = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    ends = train.count()
    n, v = (total or 0) + ends, types + (ends > 0)
    head = commonest(counts, HEAD)

    net = fit(train, vocabulary)
    tokens_in, types_in = class_totals(counts, net)
    class_log = np.log10(tokens_in + types_in + 1)

    path = scratch(spark, "lm-scores")
    partial_scores(docs, net, head, class_log, ends).write.mode("error").parquet(path)
    part = spark.read.schema(PART).parquet(path)
    rare = part.select("uid", F.explode("tail").alias("t")).select("uid", "t.word", "t.tf")
    c = F.coalesce("c", F.lit(0))
    sums = rare.join(counts, "word", "left").groupBy("uid").agg(F.sum(F.col("tf") * F.log10(c + 1)).alias("tail_log"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("tail_known"))
    j = part.drop("tail").join(sums, "uid", "left")
    end_log = float(np.log10(ends + 1))
    seen = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) + end_log
    return j.select(
        "doc_id", fold(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"), (seen - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("rest_log") + seen - end_log).alias("score"))

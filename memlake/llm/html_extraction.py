"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded down the tree.

A page becomes block nodes in a task (``dom``), each with small binned features: kind of tag,
what its own and the nearest telling ancestor's tags and attribute tokens say, text, link and
punctuation density of its subtree, depth, place among its siblings and their densities. Nodes
inside elements that name their purpose (``article``, ``nav``, ...) are labelled by it; feature
vectors of a bounded sample of pages, summed by Spark, train the trees. Each labelled node
counts in several views: as it is, with less of what names its purpose, so that the trees also
learn what text itself looks like, and moved into what names another purpose, so that they
learn that this counts for more.

Decoding keeps the set of nodes of the highest total evidence in which no node is kept below
one that is dropped; it is found exactly by one pass up and one down. Pages never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memlake.llm.dom import Page, parse
from memlake.session import cut_lineage

#: Pages that the trees are fitted on, and distinct feature vectors of them.
SAMPLE, MOST_VECTORS = 2_000, 60_000
TREES, DEPTH, RATE, RIDGE, LEAST = 40, 4, 0.25, 1.0, 4.0
BINS = 16
#: What tags and attribute tokens say of the text in them.
MAIN_TAGS = set("article main".split())
OTHER_TAGS = set("nav footer header aside form menu dialog search".split())
MAIN_TOKENS = set("article articlebody body content entry main post story text".split())
OTHER_TOKENS = set("""ad ads advert advertisement alert banner breadcrumb breadcrumbs byline comment comments complementary contentinfo cookie cookies copyright disqus
    footer form header login masthead menu meta modal nav navbar navigation newsletter notice pager pagination popup promo related respond reply search share sharing
    sidebar signup social sponsor sponsored subscribe tags toolbar widget""".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Features that a view takes away: of the tags' purpose, and of the attributes.
TAG_FEATURES, TOKEN_FEATURES = ("tag_says", "tag_near"), ("token_says", "token_near")
KINDS = {"p": 1, "text": 2, "li": 4, "ul": 5, "ol": 5, "menu": 5, "td": 6, "th": 6, "tr": 6, "table": 6, "blockquote": 1, "pre": 1, "dd": 4, "dt": 4} | dict.fromkeys(HEADINGS, 3)
FEATURES = ["kind", *TAG_FEATURES, *TOKEN_FEATURES, "depth", "place", "siblings", "chars", "own", "links", "marks", "nodes", "per_node", "share", "before", "left_chars", "left_links", "right_chars", "right_links"]


def says(tag: str, tokens: tuple[str, ...], inside: int) -> tuple[int, int]:
    """What a tag and its tokens say: 1 main, 2 other, 0 nothing. A header or the like inside
    of what is main says nothing; tokens that say both say nothing."""
    own_tag = 1 if tag in MAIN_TAGS else 2 if tag in OTHER_TAGS and not (tag == "header" and inside == 1) else 0
    if tag in ("html", "body") or not tokens:
        return own_tag, 0
    main, other = not MAIN_TOKENS.isdisjoint(tokens), not OTHER_TOKENS.isdisjoint(tokens)
    return own_tag, 0 if main == other else 1 if main else 2


def logs(x: np.ndarray, most: int = BINS - 1) -> np.ndarray:
    return np.minimum(np.log2(x + 1.0).astype(np.int64), most)


def tenths(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.minimum(10 * x // np.maximum(of, 1), 10).astype(np.int64)


def node_features(page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each node, its own characters, label: 1 main, 0 other, -1 not known)."""
    n = len(page.tag)
    parent, end, own = np.array(page.parent), np.array(page.end), np.array(page.chars)
    sums = np.zeros((4, n + 1), np.int64)
    np.cumsum([page.chars, page.linked, page.marks, np.ones(n, int)], axis=1, out=sums[:, 1:])
    chars, linked, marks, nodes = sums[:, end] - sums[:, np.arange(n)]
    tag_says, token_says, tag_near, token_near, label = (np.zeros(n, np.int64) for _ in range(5))
    label[0] = -1
    for k in range(1, n):
        p = page.parent[k]
        a, b = says(page.tag[k], page.tokens[k], int(tag_near[p]))
        tag_says[k], token_says[k] = a, b
        tag_near[k], token_near[k] = a or tag_near[p], b or token_near[p]
        # What is other stays so, whatever stands in it.
        label[k] = 0 if label[p] == 0 or a == 2 or b == 2 else 1 if label[p] == 1 or a == 1 else -1
    around = np.zeros((4, n), np.int64)
    last: dict[int, int] = {}
    for k in range(1, n):
        if (left := last.get(page.parent[k])) is not None:
            around[0, k], around[1, k] = 1 + min(int(np.log2(chars[left] + 1.0)), 14), 1 + 10 * linked[left] // max(chars[left], 1)
            around[2, left], around[3, left] = 1 + min(int(np.log2(chars[k] + 1.0)), 14), 1 + 10 * linked[k] // max(chars[k], 1)
        last[page.parent[k]] = k
    total = np.full(n, max(int(chars[0]), 1))
    x = np.stack([
        np.array([KINDS.get(t, 0) for t in page.tag]), tag_says, tag_near, token_says, token_near, np.minimum(page.depth, BINS - 1),
        tenths(np.array(page.at), np.array(page.children)[parent] - 1), logs(np.array(page.children)[parent]), logs(chars), logs(own), tenths(linked, chars),
        np.minimum(100 * marks // np.maximum(chars, 1), BINS - 1), logs(nodes), logs(chars // nodes), tenths(chars, total), tenths(sums[0, :n], total), *around], axis=1)
    return x.astype(np.uint8), own, label


def views(x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labelled rows as they are, without tags' purpose, without that and attributes, and moved:
    main text as it would be labelled inside of something else, and the other way round."""
    tags, tokens = ([FEATURES.index(f) for f in names] for names in (TAG_FEATURES, TOKEN_FEATURES))

    def put(rows: np.ndarray, near: str | None, value: int) -> np.ndarray:
        """Rows with no purpose named but by a tag or token above."""
        rows = rows.copy()
        rows[:, tags + tokens] = 0
        if near:
            rows[:, FEATURES.index(near)] = value
        return rows

    bare = x.copy()
    bare[:, tags] = 0
    main, other = x[label == 1], x[label == 0]
    within = main.copy()
    within[:, FEATURES.index("token_near")] = 2
    moved = [(within, 0), (put(main, "tag_near", 2), 0), (put(main, "token_near", 2), 0), (put(other, "tag_near", 1), 1), (put(other, "token_near", 1), 1)]
    rows = [x, bare, put(x, None, 0), *(r for r, _ in moved)]
    return np.concatenate(rows), np.concatenate([label, label, label, *(np.full(len(r), y) for r, y in moved)]).astype(np.uint8)


@dataclass
class Trees:
    """Log odds of main text: a constant and complete trees of one depth, leaf values in order."""

    start: float
    feature: np.ndarray  # trees x inner nodes, in breadth-first order
    cut: np.ndarray  # the last bin that goes left
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[row, feature[at]] > cut[at])
            out += value[at - (2 ** DEPTH - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Boosted trees by Newton steps on the logistic loss over weighted feature vectors. Both
    labels weigh alike in sum. Without both there are no trees, and all text is main text."""
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    none = Trees(1.0, np.zeros((0, inner), int), np.zeros((0, inner), int), np.zeros((0, leaves)))
    if not len(y) or y.min() == y.max():
        return none
    weight = weight / np.where(y == 1, weight[y == 1].sum(), weight[y == 0].sum()) * len(y) / 2
    score, features, cuts, values = np.zeros(len(y)), [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS)
        for level in range(DEPTH):
            first, width = 2 ** level - 1, 2 ** level
            best = np.full(width, 1e-6)
            for f in range(x.shape[1]):
                cell = (at - first) * BINS + x[:, f]
                cg, ch = (np.bincount(cell, s, width * BINS).reshape(width, BINS).cumsum(axis=1) for s in (g, h))
                G, H = cg[:, -1:], ch[:, -1:]
                gain = cg ** 2 / (ch + RIDGE) + (G - cg) ** 2 / (H - ch + RIDGE) - G ** 2 / (H + RIDGE)
                gain[(np.minimum(ch, H - ch) * 4 < LEAST)] = 0
                top = gain.argmax(axis=1)
                found = gain[np.arange(width), top]
                better = found > best + 1e-9
                best[better] = found[better]
                feature[first:first + width][better], cut[first:first + width][better] = f, top[better]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        leaf = at - inner
        value = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        score += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(0.0, np.array(features), np.array(cuts), np.array(values))


def decode(page: Page, evidence: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which nodes stay: the highest sum of evidence, weighted by a node's own text, of all sets
    in which the parent of every kept node is kept. The root always stays."""
    gain = (np.clip(evidence, -8, 8) * (0.1 + own / 40)).tolist()
    parent = page.parent
    for k in range(len(gain) - 1, 0, -1):
        if gain[k] > 0:
            gain[parent[k]] += gain[k]
    keep = np.zeros(len(gain), bool)
    keep[0] = True
    for k in range(1, len(gain)):
        keep[k] = gain[k] > 0 and keep[parent[k]]
    return keep


def text_of(page: Page, keep: np.ndarray) -> str:
    """Kept pieces in page order: white space turned into one space inside and between blocks."""
    parts, last = [], -1
    for node, block, text in page.pieces:
        if keep[node]:
            if block != last:
                parts.append(" ")
                last = block
            parts.append(text)
    return " ".join(unescape("".join(parts)).split())


def train(pages: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` pages, those of the least hash; of a repeated page_id one."""
    ids = pages.where("html IS NOT NULL").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    chosen = pages.select("page_id", "html").join(F.broadcast(cut_lineage(ids.select(F.col("page_id").alias("__id")))), F.col("page_id").eqNullSafe(F.col("__id")), "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for html in b.column(0):
                x, _, label = node_features(parse(html.as_py() or ""))
                known = label >= 0
                vectors, counts = np.unique(np.column_stack(views(x[known], label[known])), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(counts)], names=["v", "n"])

    one = chosen.groupBy("page_id").agg(F.min("html").alias("html")).select("html")
    found = one.mapInArrow(work, "v binary, n long").groupBy("v").agg(F.sum("n").alias("n")).orderBy(F.xxhash64("v"), "v").limit(MOST_VECTORS).toArrow()
    if not found.num_rows:
        return fit(np.zeros((0, len(FEATURES)), np.uint8), np.zeros(0), np.zeros(0))
    table = np.frombuffer(b"".join(found["v"].to_pylist()), np.uint8).reshape(-1, len(FEATURES) + 1)
    return fit(table[:, :-1], table[:, -1].astype(float), found["n"].to_numpy().astype(float))


def main_text(html: str, trees: Trees) -> str:
    page = parse(html)
    x, own, _ = node_features(page)
    return text_of(page, decode(page, trees.score(x), own))


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    A null or empty html, or one without main text, gives an empty text. Repeated rows are read
    each. Pages of which none names the purpose of its elements are kept whole, but for scripts,
    styles, forms' fields and the like. An empty table gives no rows.
    """
    rows = pages.select("page_id", "url", "html")
    held = pages.sparkSession.sparkContext.broadcast(train(rows, sample))
    out = rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n_chars"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                read = [parse(h.as_py() or "") for h in part.column(2)]
                nodes = [node_features(p) for p in read]
                scores = held.value.score(np.concatenate([x for x, _, _ in nodes]))
                cuts = np.cumsum([0, *(len(x) for x, _, _ in nodes)])
                texts = [text_of(p, decode(p, scores[i:j], own)) for p, (_, own, _), i, j in zip(read, nodes, cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(work, out.schema)

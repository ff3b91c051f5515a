"""Main-text extraction by a tree-structured graphical model over DOM nodes.

Each node has a hidden state, content or not.  A log-linear potential scores the
state by the node's tag, the words of its class, id and role, those of its next three
ancestors, and its text (length, share in links, sentence marks, place); a potential for each parent and child scores
their pair of states by the kind of the child.  The graph is a tree, so sum-product
messages, once up and once down, give exact marginals.  Weights maximise the
likelihood of labelled pages (``labelled_pages``; their number is a parameter), by
gradients that are observed minus expected counts.

A page's text is that of the nodes whose marginal is at least one half.

Cases: null or empty html has empty text; markup of any depth or fault is read;
repeated rows are each extracted; null ids are kept; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import nothing_held, rows_of, small_batches
from tidewell.llm.dom import INLINE, Page, parse, text_of
from tidewell.llm.labelled_pages import labelled_pages

#: Labelled pages that a model is fitted on, and steps of the fit.
PAGES, STEPS = 1600, 300
#: How far up a node sees tags and names.
ANCESTORS = 3
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption tr tbody thead table ul ol dl figure".split())
GROUPS = 4


def group_of(tag: str, words: list[str]) -> int:
    """Kind of a child: plain text block, other block, block with a name, inline."""
    if tag in INLINE:
        return 3
    return 2 if words else 0 if tag in _TEXT else 1


def _bin(x: float, edges: tuple[float, ...]) -> int:
    k = 0
    while k < len(edges) and x >= edges[k]:
        k += 1
    return k


def node_features(page: Page) -> list[list[str]]:
    n = len(page.tag)
    chars, linked, marks, first = [0] * n, [0] * n, [0] * n, [-1] * n
    total = 0
    for node, text, link in page.pieces:
        if node >= 0:
            size = len(text)
            chars[node] += size
            if link:
                linked[node] += size
            marks[node] += text.count(". ") + text.count("? ") + text.count("! ") + text.endswith((".", "?", "!"))
            if first[node] < 0:
                first[node] = total
            total += size
    own = list(chars)
    parent = page.parent
    for k in range(n - 1, 0, -1):  # parents come before their children
        p = parent[k]
        chars[p] += chars[k]
        linked[p] += linked[k]
        marks[p] += marks[k]
        if first[k] >= 0 and (first[p] < 0 or first[k] < first[p]):
            first[p] = first[k]
    out = []
    for k in range(n):
        f = ["bias", "tag=" + page.tag[k]]
        f.extend("word=" + w for w in page.words[k])
        c = chars[k]
        f.append(f"size={_bin(c, (1, 10, 40, 120, 400, 1500, 6000))}")
        f.append(f"own={_bin(own[k], (1, 10, 40, 120, 400))}")
        if c:
            f.append(f"links={_bin(linked[k] / c, (0.01, 0.2, 0.5, 0.8))}")
            f.append(f"marks={_bin(100 * marks[k] / c, (0.01, 0.5, 1.5))}")
            f.append(f"share={_bin(c / max(total, 1), (0.02, 0.1, 0.3, 0.6, 0.9))}")
            f.append(f"place={_bin(first[k] / max(total, 1), (0.01, 0.1, 0.5, 0.9))}")
        f.append(f"depth={min(page.depth[k], 8)}")
        above = parent[k]
        if above >= 0:
            f.append("under=" + page.tag[above])
        for _ in range(ANCESTORS):
            if above < 0:
                break
            f.append("in=" + page.tag[above])
            f.extend("in=." + w for w in page.words[above])
            above = parent[above]
        out.append(f)
    return out


@dataclass
class Forest:
    """Pages as one forest: nodes of a depth are handled together."""

    parent: np.ndarray
    group: np.ndarray
    depth: np.ndarray
    features: np.ndarray
    node: np.ndarray
    sizes: list[int]

    @staticmethod
    def of(pages: list[Page], index: dict[str, int], grow: bool = False) -> Forest:
        parent, group, depth, features, node, sizes, base = [], [], [], [], [], [], 0
        for page in pages:
            for k, own in enumerate(node_features(page)):
                if grow:
                    for f in own:
                        index.setdefault(f, len(index))
                known = [index[f] for f in own if f in index]
                features.extend(known)
                node.extend([base + k] * len(known))
            parent.extend(p + base if p >= 0 else -1 for p in page.parent)
            group.extend(group_of(t, w) for t, w in zip(page.tag, page.words, strict=True))
            depth.extend(page.depth)
            sizes.append(len(page.tag))
            base += len(page.tag)
        return Forest(*(np.array(x, np.int64) for x in (parent, group, depth, features, node)), sizes)


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def sum_product(forest: Forest, unary: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 of each node, and of the four states of each node with its parent.

    ``edge[g, p, c]`` is the potential of parent state p and child state c."""
    n = len(forest.parent)
    below = np.zeros((n, 2))
    below[:, 1] = unary
    up, down = np.zeros((n, 2)), np.zeros((n, 2))
    order = np.argsort(forest.depth, kind="stable")
    cuts = np.searchsorted(forest.depth[order], np.arange(forest.depth.max(initial=0) + 2))
    levels = [order[cuts[d] : cuts[d + 1]] for d in range(len(cuts) - 1)]
    psi = edge[forest.group]
    for level in reversed(levels[1:]):
        for s in (0, 1):
            up[level, s] = _both(psi[level, s, 0] + below[level, 0], psi[level, s, 1] + below[level, 1])
        np.add.at(below, forest.parent[level], up[level])
    joint = np.zeros((n, 2, 2))
    for level in levels[1:]:
        p = forest.parent[level]
        above = below[p] + down[p] - up[level]
        for s in (0, 1):
            down[level, s] = _both(psi[level, 0, s] + above[:, 0], psi[level, 1, s] + above[:, 1])
        joint[level] = psi[level] + above[:, :, None] + below[level][:, None, :]
    total = below + down
    marginal = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500)))
    joint -= joint.max((1, 2), keepdims=True)
    joint = np.exp(joint)
    joint /= joint.sum((1, 2), keepdims=True)
    return marginal, joint


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    edge: np.ndarray

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        if not pages:
            return []
        forest = Forest.of(pages, self.index)
        unary = np.bincount(forest.node, weights=self.weights[forest.features], minlength=len(forest.parent))
        found, _ = sum_product(forest, unary, self.edge)
        return np.split(found, np.cumsum(forest.sizes)[:-1])

    def texts(self, htmls: list[str]) -> list[str]:
        pages = [parse(h) for h in htmls]
        return [text_of(p, (m >= 0.5).tolist()) for p, m in zip(pages, self.marginals(pages), strict=True)]


def fit(htmls: list[str], steps: int = STEPS, ridge: float = 1e-4) -> Model:
    pages = [parse(h) for h in htmls]
    index: dict[str, int] = {}
    forest = Forest.of(pages, index, grow=True)
    labels = np.array([y for p in pages for y in p.label], float)
    n, child = len(labels), forest.parent >= 0
    pair = (labels[forest.parent[child]] * 2 + labels[child]).astype(int)
    seen = np.zeros((GROUPS, 4))
    np.add.at(seen, (forest.group[child], pair), 1)
    w, edge = np.zeros(len(index)), np.zeros((GROUPS, 2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(edge), np.zeros_like(edge)]
    for step in range(1, steps + 1):
        unary = np.bincount(forest.node, weights=w[forest.features], minlength=n)
        marginal, joint = sum_product(forest, unary, edge)
        gw = np.bincount(forest.features, weights=(labels - marginal)[forest.node], minlength=len(w)) / len(pages) - ridge * w
        expected = np.zeros((GROUPS, 4))
        np.add.at(expected, forest.group[child], joint[child].reshape(-1, 4))
        ge = ((seen - expected) / len(pages)).reshape(GROUPS, 2, 2) - ridge * edge
        for k, (value, gradient) in enumerate(((w, gw), (edge, ge))):
            state[2 * k][...] = 0.9 * state[2 * k] + 0.1 * gradient
            state[2 * k + 1][...] = 0.99 * state[2 * k + 1] + 0.01 * gradient**2
            value += 0.1 * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**step)) + 1e-6)
    return Model(index, w, edge)


@functools.lru_cache(maxsize=2)
def default_model(pages: int = PAGES) -> Model:
    return fit(labelled_pages(pages))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id, url, text`` of every page from its whole html; one pass, no shuffle."""
    small_batches(pages.sparkSession)
    model = model or default_model()
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_held()
        for batch in batches:
            yield rows_of(out, {"page_id": batch.column("page_id").to_pylist(), "url": batch.column("url").to_pylist(), "text": model.texts(batch.column("html").to_pylist())})

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string")

"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` code points (the last may be shorter; an
empty text is one empty passage).  Each passage is encoded by counts of character
classes, word shapes and repetitions; a small network embeds it, gated attention
``softmax(w . (tanh(V h) * sigmoid(U h)))`` weighs the passages, and the weighted
sum of the embeddings is scored by a logistic unit.  All parameters are learned
together from document labels by full gradients (Adam), on a bounded sample of
labelled rows, of which every passage counts: the driver holds ``FEATURES`` small
floats for each 400 code points of at most 2 x ``SAMPLE`` texts.

Only the text enters a score.  Passages are vectors of ``FEATURES`` numbers, so a
document of any length is scored from its whole text in memory linear in it.

Cases: null text is the empty text and gets a score like any; labels that are null
or not 0/1 and labelled ids without a document are not used; if no labelled row of
both classes is left, every score is 0.5; repeated rows are scored alike; of rows that share
a labelled id the smallest text is learned from; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import id_and_text, nothing_held, rows_of, small_batches

#: Code points of a passage.
PASSAGE = 400
#: Most labelled rows of each class that a model is fitted on (chosen by the hash of their id).
SAMPLE = 1500
#: Passages of whole bags that one step of the gradient holds at once, or those of one bag: bounds memory, not what counts.
CHUNK = 20_000
HIDDEN, ATTENTION, STEPS = 12, 8, 250
_SEED = 7

# Classes of code points: 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 stop and comma, 6 other ASCII mark, 7 non-ASCII lower or letter, 8 non-ASCII upper, 9 other
_CLASS = np.full(0x10000, 9, np.int8)
for _c in range(0x10000):
    _s = chr(_c)
    if _s.isdigit():
        _CLASS[_c] = 2
    elif _c in (10, 13):
        _CLASS[_c] = 4
    elif _s.isspace():
        _CLASS[_c] = 3
    elif _s in ".,;:'\"-?()":
        _CLASS[_c] = 5
    elif _c < 128 and not _s.isalnum():
        _CLASS[_c] = 6
    elif _s.isupper():
        _CLASS[_c] = 1 if _c < 128 else 8
    elif _s.isalpha():
        _CLASS[_c] = 0 if _c < 128 else 7
CLASSES = 10
FEATURES = CLASSES + 10


def passages(text: str) -> np.ndarray:
    """Passages x FEATURES, all from vector operations over the whole text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(points)
    if n == 0:
        out = np.zeros((1, FEATURES))
        out[0, -1] = 1.0
        return out
    kind = _CLASS[np.minimum(points, 0xFFFF)]
    count = (n + PASSAGE - 1) // PASSAGE
    of = np.arange(n) // PASSAGE
    shares = np.bincount(of * CLASSES + kind, minlength=count * CLASSES).reshape(count, CLASSES).astype(float)
    sizes = np.bincount(of, minlength=count).astype(float)
    blank = (kind == 3) | (kind == 4)
    begins = ~blank & np.concatenate([[True], blank[:-1]])
    starts = np.flatnonzero(begins)
    out = np.zeros((count, FEATURES))
    out[:, :CLASSES] = shares / sizes[:, None]
    if len(starts):
        ends = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
        lengths = ends - starts
        hashes = _word_hashes(points.astype(np.uint64) + np.uint64(1), starts, ends)
        at = of[starts]
        words = np.bincount(at, minlength=count).astype(float)
        order = np.lexsort((hashes, at))
        same = (hashes[order][1:] == hashes[order][:-1]) & (at[order][1:] == at[order][:-1])
        repeated = np.bincount(at[order][1:][same], minlength=count)
        again = np.bincount(at[1:][(hashes[1:] == hashes[:-1]) & (at[1:] == at[:-1])], minlength=count)
        some = np.maximum(words, 1)
        mean = np.bincount(at, weights=lengths, minlength=count) / some
        square = np.bincount(at, weights=lengths.astype(float) ** 2, minlength=count) / some
        last, first = kind[ends - 1], kind[starts]
        out[:, CLASSES] = repeated / some
        out[:, CLASSES + 1] = again / some
        out[:, CLASSES + 2] = mean / 10
        out[:, CLASSES + 3] = np.sqrt(np.maximum(square - mean**2, 0)) / 10
        out[:, CLASSES + 4] = np.bincount(at, weights=last == 6, minlength=count) / some
        out[:, CLASSES + 5] = np.bincount(at, weights=(first == 1) | (first == 8), minlength=count) / some
        out[:, CLASSES + 6] = np.bincount(at, weights=(lengths == 1) & (first == 6), minlength=count) / some
        out[:, CLASSES + 7] = np.bincount(at, weights=lengths > 20, minlength=count) / some
        out[:, CLASSES + 8] = np.minimum(words / 100, 1)
    return out


_INVERSE = pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _word_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch: sum of point x base^place by prefix sums, shifted to the stretch's start by inverse powers."""
    n = len(points)
    up = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    up[0] = 1
    down = np.full(n, _INVERSE, np.uint64)
    down[0] = 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum(points * np.multiply.accumulate(up), dtype=np.uint64)])
    return (sums[ends] - sums[starts]) * np.multiply.accumulate(down)[starts]


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]
    cut: float = 0.0

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 for each bag of passages."""
        if not bags:
            return np.zeros(0)
        x = (np.concatenate(bags) - self.mean) / self.spread
        sizes = [len(b) for b in bags]
        logit, _ = _forward(self.weights, x, np.cumsum([0, *sizes[:-1]]), np.repeat(np.arange(len(bags)), sizes))
        return 1 / (1 + np.exp(-np.clip(logit - self.cut, -30, 30)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logit of each bag: the rows from its start to the next; ``bag`` has each row's."""
    h = np.tanh(x @ w["E"] + w["e"])
    t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    gate = t * s
    raw = gate @ w["a"]
    e = np.exp(raw - np.maximum.reduceat(raw, starts)[bag])
    alpha = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(alpha[:, None] * h, starts)
    return z @ w["o"] + w["b"], (h, t, s, gate, alpha, z)


def _gradient(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, bag: np.ndarray, labels: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
    """Of the log loss, each bag's with its share."""
    logit, (h, t, s, gate, alpha, z) = _forward(w, x, starts, bag)
    d = share * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels)
    g = {"b": d.sum(), "o": z.T @ d}
    dz = d[:, None] * w["o"]
    pull = dz[bag]
    toward = (h * pull).sum(1)
    draw = alpha * (toward - np.add.reduceat(alpha * toward, starts)[bag])
    g["a"] = gate.T @ draw
    dgate = draw[:, None] * w["a"]
    dt, ds = dgate * s * (1 - t**2), dgate * t * s * (1 - s)
    g["V"], g["U"] = h.T @ dt, h.T @ ds
    dh = (alpha[:, None] * pull + dt @ w["V"].T + ds @ w["U"].T) * (1 - h**2)
    g["E"], g["e"] = x.T @ dh, dh.sum(0)
    return g


def fit(bags: list[np.ndarray], labels: np.ndarray) -> Model | None:
    """Gated attention and everything below it, by Adam on the balanced log loss."""
    labels = np.asarray(labels, float)
    if len(labels) == 0 or labels.min() == labels.max():
        return None
    x = np.concatenate(bags)
    mean, spread = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / spread
    n = len(bags)
    bag = np.repeat(np.arange(n), [len(b) for b in bags])
    rng = np.random.default_rng(_SEED)
    shape = {"E": (FEATURES, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "a": (ATTENTION,), "o": (HIDDEN,), "b": ()}
    w = {k: rng.normal(0, 1 / np.sqrt(v[0]) if len(v) == 2 else 0.3 if v else 0, v) for k, v in shape.items()}
    first = {k: np.zeros(v) for k, v in shape.items()}
    second = {k: np.zeros(v) for k, v in shape.items()}
    share = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    ends = np.cumsum([len(b) for b in bags])
    starts = np.concatenate([[0], ends[:-1]])
    parts, low = [], 0
    while low < n:  # stretches of bags
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + CHUNK, side="right")))
        parts.append((slice(low, high), slice(int(starts[low]), int(ends[high - 1]))))
        low = high
    for step in range(1, STEPS + 1):
        g = {k: np.zeros(v) for k, v in shape.items()}
        for docs, rows in parts:
            for k, v in _gradient(w, x[rows], starts[docs] - rows.start, bag[rows] - docs.start, labels[docs], share[docs]).items():
                g[k] += v
        for k in w:
            g[k] = g[k] + 1e-4 * w[k]
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
            w[k] = w[k] - 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, spread, w)


def held_out(key: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text leaves 1 modulo 3: never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` labelled rows of each class that are not held out (bounded by that parameter)."""
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out())
    marked = marked.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")  # ids without a document take no place of the sample
    chosen = None
    for value in (0, 1):  # a top-k each: partial in every task, no sort of the table
        part = marked.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = chosen.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("label").alias("low")).filter("label = low").collect()
    named = {r.doc_id: r.label for r in rows}
    out = pa.schema([("doc_id", pa.int64()), ("bag", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_held()
        for batch in batches:
            yield rows_of(out, {"doc_id": batch.column("doc_id").to_pylist(), "bag": [passages(t).astype("<f4").tobytes() for t in batch.column("text").to_pylist()]})

    if not named:
        return None
    wanted = spark.createDataFrame([(i,) for i in named], "doc_id long")
    texts = id_and_text(docs).join(F.broadcast(wanted), "doc_id", "left_semi")  # at most 2 x sample ids
    one = texts.groupBy("doc_id").agg(F.min("text").alias("text"))  # so at most 2 x sample rows leave, however often an id repeats
    bags = {r.doc_id: r.bag for r in one.mapInArrow(encode, "doc_id long, bag binary").toLocalIterator()}
    ids = sorted(bags)
    return fit([np.frombuffer(bags[i], "<f4").reshape(-1, FEATURES).astype(float) for i in ids], np.array([named[i] for i in ids]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score`` of every whole text; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_held()
        for batch in batches:
            yield rows_of(out, {"doc_id": batch.column("doc_id").to_pylist(), "score": text_scores(model, batch.column("text").to_pylist())})

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def text_scores(model: Model | None, found: list[str]) -> np.ndarray:
    if model is None:
        return np.full(len(found), 0.5)
    return np.round(model.scores([passages(t) for t in found]), 9)


def accepted(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores at least ``least``; one pass, no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_held()
        for batch in batches:
            scores = text_scores(model, [t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(scores >= least))

    return docs.mapInArrow(run, docs.schema)

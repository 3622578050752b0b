"""Quality classifier from positive and unlabelled texts.

A small network is trained on the non-negative unbiased risk: with class prior p, loss l and
scores f,  p E_pos[l(f)] + max(0, E_unl[l(-f)] - p E_pos[l(-f)]);  when the bracket turns
negative, a step goes up its slope instead.  Positives are rows labelled 1.  Unlabelled texts are
the sampled rows with their labels hidden.  The prior is estimated as the share of positives
among sampled labels.  Last, the network's output is scaled to a probability on the sampled
labels, so that a score of 0.7 means what it says.

Fitting takes at most ``FIT_ROWS`` labelled rows, first by a hash of their id, never of the
held-out fold; their features, some 30 numbers each, are all that reaches the driver.  Scoring
reads every whole text in one map stage and moves none.

Inputs are the text alone: shares of character classes, repetition, word and line shapes.  A
NULL text is an empty one.  Repeated rows get one score each.  A NULL id is in no fold and has
no label.  Where labels hold no row or one class, every score is the prior (1 without labels).
Extra columns are kept by ``scored``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.llm import words as W

FIT_ROWS = 10_000
HIDDEN, STEPS, RATE = 24, 500, 0.02
THRESHOLD = 0.7


def _bytes_in(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


UPPER, LOWER, DIGIT = (_bytes_in(bytes(range(a, b))) for a, b in ((65, 91), (97, 123), (48, 58)))
#: character classes whose share of a text is a feature
CLASSES = [
    UPPER, DIGIT, _bytes_in(b"|"), _bytes_in(b"!"), _bytes_in(b"?"), _bytes_in(b"#$%&*@^~=+_"), _bytes_in(b"<>{}[]\\"),
    _bytes_in(b"."), _bytes_in(b","), _bytes_in(b":;"), _bytes_in(b"()\"'"), _bytes_in(b"/-"), _bytes_in(b"\n"),
    _bytes_in(bytes(range(128, 256))), _bytes_in(bytes(range(9)) + bytes(range(14, 32))),
]
SYMBOL = _bytes_in(b"|!?#$%&*@^~=+_<>{}[]\\")


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row of numbers per text; all of them are bounded whatever the text's length."""
    words = W.read_words(texts)
    raw = np.frombuffer(words.data + b"\n", np.uint8)
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    n_bytes = np.maximum(sizes - 1, 1)
    shares = [np.add.reduceat(c[raw], starts, dtype=np.int64) / n_bytes for c in CLASSES]
    counts = np.maximum(words.counts, 1)

    def per_word(flag: np.ndarray) -> np.ndarray:
        return np.bincount(words.doc[: len(flag)], flag, minlength=words.n_docs) / counts

    size = words.end - words.start
    same = np.zeros(len(size), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    order = np.lexsort((words.hashes, words.doc))
    h, d = words.hashes[order], words.doc[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.empty(0, np.int64)
    often = np.diff(np.concatenate([first, [len(h)]]))
    distinct = np.bincount(d[first], minlength=words.n_docs)
    most = np.zeros(words.n_docs)
    np.maximum.at(most, d[first], often)
    last = raw[words.end - 1] if len(size) else np.empty(0, np.uint8)
    head = raw[words.start] if len(size) else np.empty(0, np.uint8)
    lines = np.add.reduceat((raw == 10).astype(np.int64), starts)
    columns = shares + [
        per_word(size) / 10, per_word(size > 20), per_word(size <= 2), per_word(same), distinct / counts, most / counts,
        per_word(SYMBOL[last]), per_word(SYMBOL[head] & SYMBOL[last]), per_word(UPPER[head]), per_word(UPPER[head] & UPPER[last]),
        per_word(DIGIT[last]), np.log1p(words.counts) / 10, np.log1p(words.counts / lines) / 5,
        np.minimum(distinct / np.sqrt(counts), 20) / 10, (words.counts == 0).astype(float),
    ]
    return np.stack(columns, axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """Standardised features, one hidden layer, and the scale of its output."""

    def __init__(self, x: np.ndarray, label: np.ndarray):
        self.prior = float(label.mean()) if len(label) else 1.0
        self.fitted = 0.0 < self.prior < 1.0
        if self.fitted:
            self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
            self._fit(self._scaled(x), label == 1)
            self._scale(self.margin(x), label)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def _forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(z @ self.weights[0] + self.weights[1])
        return hidden, hidden @ self.weights[2] + self.weights[3]

    def _fit(self, z: np.ndarray, positive: np.ndarray) -> None:
        rng = np.random.default_rng(7)
        self.weights = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        n, n_pos, p = len(z), int(positive.sum()), self.prior
        for step in range(1, STEPS + 1):
            hidden, f = self._forward(z)
            loss = lambda v: np.logaddexp(0, -v)
            negative = loss(-f).mean() - p * loss(-f[positive]).mean()
            down = _sigmoid(f) / n  # slope of the unlabelled part
            down[positive] -= p * _sigmoid(f[positive]) / n_pos
            if negative >= 0:
                slope = down
                slope[positive] -= p * _sigmoid(-f[positive]) / n_pos
            else:
                slope = -down
            inner = np.outer(slope, self.weights[2]) * (1 - hidden**2)
            grads = [z.T @ inner, inner.sum(axis=0), hidden.T @ slope, slope.sum(keepdims=True)]
            for k, g in enumerate(grads):
                g = g + 1e-4 * self.weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.weights[k] = self.weights[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def _scale(self, f: np.ndarray, label: np.ndarray) -> None:
        """Newton steps for the probability sigmoid(a f + b), with a light pull to a = 1."""
        self.a, self.b = 1.0, 0.0
        for _ in range(30):
            q = _sigmoid(self.a * f + self.b)
            w = np.maximum(q * (1 - q), 1e-9)
            grad = np.array([((q - label) * f).sum() + (self.a - 1), (q - label).sum() + 1e-3 * self.b])
            curve = np.array([[(w * f * f).sum() + 1, (w * f).sum()], [(w * f).sum(), w.sum() + 1e-3]])
            move = np.linalg.solve(curve, grad)
            self.a, self.b = self.a - np.clip(move[0], -2, 2), self.b - np.clip(move[1], -2, 2)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self._forward(self._scaled(x))[1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.a * self.margin(x) + self.b) if self.fitted else np.full(len(x), self.prior)


def in_held_out_fold(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Model:
    """The classifier, from at most ``rows`` labelled rows outside the held-out fold."""
    chosen = (
        labels.select(F.col(id_col).alias("doc"), F.col(label_col).cast("double").alias("label"))
        .filter(F.col("doc").isNotNull() & F.col("label").isin(0.0, 1.0) & ~in_held_out_fold("doc"))
        .groupBy("doc").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc"), "doc").limit(rows)
    )
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc")  # at most ``rows`` narrow rows

    def measure(batches):
        for batch in batches:
            data = batch["text"].to_pylist()
            for a, b in W.in_pieces(data):
                x = features(data[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc"].slice(a, b - a), batch["label"].slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))],
                    names=["doc", "label", "x"],
                )

    kind = dict(sample.dtypes)["doc"]
    got = sample.mapInArrow(measure, f"doc {kind}, label double, x array<double>").orderBy("doc", "x").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), -1 if len(got) else 0)
    return Model(x, got["label"].to_numpy(float))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns, with ``score``."""
    keep = [c for c in docs.columns if c != "score"]
    own = docs.select(F.struct(*keep).alias("all_"), F.col(text_col).cast("binary").alias("text_"))

    def rate(batches):
        for batch in batches:
            data = batch["text_"].to_pylist()
            parts = [model.score(features(data[a:b])) for a, b in W.in_pieces(data)]
            table = pa.Table.from_struct_array(batch["all_"])
            yield from table.append_column("score", pa.array(np.concatenate([*parts, np.empty(0)]))).to_batches()

    return own.mapInArrow(rate, docs.select(*keep).schema.add("score", "double"))

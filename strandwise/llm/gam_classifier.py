"""Quality classifier: a generalised additive model with pairwise interactions.

The score is a logistic curve over a sum of lookup tables: one table for each feature, learned by cyclic
boosting of shallow trees on binned features, and one for each of a few feature pairs, chosen by how much
a cut of both features still gains once the single tables are fitted.  Scoring bins the features and adds
table entries, vectorised over a batch.

The tables are fitted on about ``TRAIN_ROWS`` labelled documents at most (a row of features each), outside
the held-out fold.  Null and empty texts have all counts zero and are scored like any other.  With labels
of one kind or none, every score is the smoothed share of label 1.  Repeated rows are scored alike.
One document stands for each labelled id, so the bound holds for rows too.  Rows with null ids are scored and never
learned from; texts are read whole whatever their length; an empty table gives an empty result; columns other than
id and text are never read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, slices

#: Bound on labelled documents that the tables are fitted on.
TRAIN_ROWS = 16_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
FEATURES = [
    "log_words", "word_len", "long_words", "distinct", "top_word", "adjacent_repeat", "symbols", "bars", "capitals",
    "digits", "stops", "marks", "dup_lines", "words_a_line", "capital_starts", "other_bytes",
]
_UPPER, _DIGITS, _HIGH = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256))


def text_features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    chars = max(int(lengths.sum()), 1)
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    adjacent = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    gone = lambda chars: len(raw) - len(raw.translate(None, chars))
    return [
        np.log1p(len(words)), chars / n, float((lengths > 12).sum()) / n, np.log((len(count) + 1) / (n + 1)), max(count.values(), default=0) / n,
        adjacent / n, gone(b"#*$%&<>@^~=+_\\") / chars, gone(b"|[]{}") / chars, gone(_UPPER) / chars, gone(_DIGITS) / chars, gone(b".,;:") / n,
        gone(b"!?") / n, (len(lines) - len(set(lines))) / max(len(lines), 1), np.log(n / max(len(lines), 1)),
        sum(map(bytes.istitle, words)) / n, gone(_HIGH) / size,
    ]


@dataclass
class Gam:
    prior: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)], 1) if len(edges) else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.prior)
        fine = self.bins(x, self.edges)
        for k, t in enumerate(self.tables):
            f += t[fine[:, k]]
        rough = self.bins(x, self.coarse)
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            f += t[rough[:, a], rough[:, b]]
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Bin edges: halfway between quantiles that differ."""
    out = []
    for k in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def _stump_pair(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values by bin of a tree with up to three leaves (two cuts) on one feature."""

    def split(a: int, b: int):
        gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        gt, ht = g[a:b].sum(), h[a:b].sum()
        gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
        k = int(np.argmax(gain)) if len(gain) else -1
        return (gain[k], a + k + 1) if k >= 0 else (-1.0, -1)

    cuts = [0, len(g)]
    for _ in range(2):
        best = max((split(a, b) for a, b in zip(cuts, cuts[1:], strict=False)), default=(-1.0, -1))
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Best cut of two features at once: its gain over no cut, and the four leaves as a table."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gt, ht = cg[-1, -1], ch[-1, -1]
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    parts = [(a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b)]
    parts.append((gt - sum(p[0] for p in parts), ht - sum(p[1] for p in parts)))
    gain = sum(p[0] ** 2 / (p[1] + ridge) for p in parts) - gt**2 / (ht + ridge)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    leaf = [[-p[0][i, j] / (p[1][i, j] + ridge) for p in parts[k : k + 2]] for k in (0, 2)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf[0][0], leaf[0][1], leaf[1][0], leaf[1][1]
    return float(gain[i, j]), out


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, rate: float = 0.1, ridge: float = 2.0) -> Gam:
    """Cyclic boosting: each round gives every feature's table one shallow tree, then likewise every pair's."""
    p0 = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(p0 / (1 - p0))))
    if not len(y) or y.min() == y.max():
        return model
    model.edges, model.coarse = _cuts(x, BINS), _cuts(x, PAIR_BINS)
    fine, rough = model.bins(x, model.edges), model.bins(x, model.coarse)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    f = np.full(len(y), model.prior)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for k, t in enumerate(model.tables):
            if len(t) > 1:
                g, h = slopes()
                step = rate * _stump_pair(np.bincount(fine[:, k], g, len(t)), np.bincount(fine[:, k], h, len(t)), ridge)
                t += step
                f += step[fine[:, k]]
    shape = [len(e) + 1 for e in model.coarse]

    def grids(a, b):
        g, h = slopes()
        at = rough[:, a] * shape[b] + rough[:, b]
        return [np.bincount(at, v, shape[a] * shape[b]).reshape(shape[a], shape[b]) for v in (g, h)]

    ranked = sorted(combinations([k for k in range(len(shape)) if shape[k] > 1], 2), key=lambda ab: -_quadrants(*grids(*ab), ridge)[0])
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((shape[a], shape[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            step = rate * _quadrants(*grids(a, b), ridge)[1]
            t += step
            f += step[rough[:, a], rough[:, b]]
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, folds: int = 5) -> DataFrame:
    """(doc_id, score) of every row, the model fitted on ``labels.quality`` outside fold 0."""
    renamed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([text_features(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    sample = labelled_sample(renamed, labels, "quality", train_rows, folds).select("text", "y")
    got = sample.mapInArrow(rows, "x array<double>, y int").toPandas()  # at most about train_rows rows of numbers
    got = got.iloc[np.lexsort([*np.array(got["x"].tolist()).reshape(len(got), -1).T, got["y"]])] if len(got) else got
    model = fit_gam(np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES)), (got["y"].to_numpy() > 0).astype(float))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([text_features(t) for t in b.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return renamed.mapInArrow(run, f"doc_id {kind}, score double")

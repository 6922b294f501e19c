"""Document quality from a linear-chain conditional random field over lines.

Every non-blank line gets surface features of itself and of the lines around it; a two-label chain
(bad, good) gives each line's forward-backward marginal, and their mean weighted by line length is the
document's quality, calibrated to a probability by a logistic curve.

The chain is trained on about TRAIN_DOCS labelled documents with about TRAIN_BYTES bytes at most, none of
more than a sixteenth of that (documented bounds), each line taking its document's label. Edge cases: null, empty and blank texts have no lines and score 0; texts of any length
are scored whole; rows without a label, without an id, or of an id with both labels never train, and of
several texts of an id the least one does; with no labels at all every other text scores 0.5; repeated
rows score alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import common

TRAIN_DOCS, TRAIN_BYTES = 4000, 64 << 20
_OWN = 16  # features of one line


def _byte_classes() -> bytes:
    kinds = bytearray(b"y" * 256)
    for c in range(256):
        ch = chr(c)
        if c >= 128 or ch.islower():
            kinds[c] = ord("l")
        elif ch.isupper():
            kinds[c] = ord("u")
        elif ch.isdigit():
            kinds[c] = ord("d")
        elif ch.isspace():
            kinds[c] = ord("s")
        elif ch in ".,;:'\"-()":
            kinds[c] = ord("p")
        elif ch in "!?":
            kinds[c] = ord("e")
    return bytes(kinds)


_CLASSES = _byte_classes()
_ODD_ENDS = frozenset("#$%&*!|^~<>=+@_/\\")


def line_features(text: str) -> tuple[list[list[float]], list[int]]:
    """Features and lengths of the non-blank lines."""
    rows, sizes, seen = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        b = line.encode("utf-8", "replace").translate(_CLASSES)
        n, k = len(b), len(words)
        lower, upper, digit = b.count(b"l"), b.count(b"u"), b.count(b"d")
        letters = lower + upper
        odd = sum(w[-1] in _ODD_ENDS for w in words)
        rows.append([
            1.0,
            np.log1p(n) / 5,
            letters / n,
            upper / (letters + 1),
            digit / n,
            b.count(b"y") / n * 4,
            b.count(b"p") / n * 4,
            b.count(b"e") / n * 4,
            len(set(words)) / k,
            sum(map(str.__eq__, words, words[1:])) / k,
            n / k / 10,
            odd / k,
            sum(len(w) == 1 and not w.isalnum() for w in words) / k,
            float(line.rstrip()[-1] in ".!?:\""),
            float(line in seen),
            min(k, 20) / 20,
        ])
        seen.add(line)
        sizes.append(n)
    return rows, sizes


@dataclass
class Lines:
    """Features of many documents' lines, laid end to end. starts has one entry more than documents."""

    x: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, texts: list) -> Lines:
        rows, sizes, starts = [], [], [0]
        for t in texts:
            r, s = line_features(t or "")
            rows += r
            sizes += s
            starts.append(len(rows))
        own = np.array(rows, "f8").reshape(len(rows), _OWN)
        starts = np.array(starts)
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[1:], after[:-1] = own[:-1], own[1:]
        firsts = starts[:-1][starts[:-1] < starts[1:]]
        before[firsts] = 0
        after[starts[1:][starts[:-1] < starts[1:]] - 1] = 0
        return cls(np.hstack([own, before, after]), np.array(sizes, "f8"), starts)


def forward_backward(scores: np.ndarray, starts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 for every line, and the summed expected transitions of each document.

    scores: a line's log potential of label 1 over label 0; trans: log potentials of label pairs.
    Documents step together, longest first, so each step handles those that are still running.
    """
    n = np.diff(starts)
    order = np.argsort(-n, kind="stable")
    n, first = n[order], starts[:-1][order]
    a = np.exp(trans)
    psi = np.stack([np.ones_like(scores), np.exp(np.clip(scores, -30, 30))], 1)
    fwd, scale = np.empty_like(psi), np.empty(len(scores))
    steps = int(n[0]) if len(n) else 0
    live = [int(np.searchsorted(-n, -t, "left")) for t in range(steps)]  # documents with more than t lines
    for t in range(steps):
        at = first[: live[t]] + t
        v = psi[at] if t == 0 else (fwd[at - 1] @ a) * psi[at]
        s = v.sum(1)
        fwd[at], scale[at] = v / s[:, None], s
    back, pairs = np.ones_like(psi), np.zeros((len(n), 2, 2))
    for t in range(steps - 1, 0, -1):
        at = first[: live[t]] + t
        right = psi[at] * back[at] / scale[at][:, None]
        pairs[: live[t]] += fwd[at - 1][:, :, None] * a[None] * right[:, None, :]
        back[at - 1] = right @ a.T
    post = fwd * back
    out = np.empty_like(pairs)
    out[order] = pairs
    return post[:, 1] / post.sum(1), out


@dataclass
class Model:
    w: np.ndarray
    trans: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, lines: Lines) -> np.ndarray:
        """Log odds of the length-weighted mean marginal of each document; nan without lines."""
        marg, _ = forward_backward(((lines.x - self.mean) / self.spread) @ self.w, lines.starts, self.trans)
        total = np.add.reduceat(np.append(lines.sizes, 0), lines.starts[:-1]) if len(lines.starts) > 1 else np.zeros(0)
        good = np.add.reduceat(np.append(lines.sizes * marg, 0), lines.starts[:-1]) if len(lines.starts) > 1 else np.zeros(0)
        none = np.diff(lines.starts) == 0
        q = np.clip(np.where(none, np.nan, good / np.where(total > 0, total, 1)), 1e-6, 1 - 1e-6)
        return np.log(q / (1 - q))

    def score(self, texts: list) -> np.ndarray:
        z = self.slope * self.raw(Lines.of(texts)) + self.shift
        return np.where(np.isnan(z), 0.0, 1 / (1 + np.exp(-np.clip(np.nan_to_num(z), -40, 40))))


def fit(texts: list[str], labels: np.ndarray, rounds: int = 200, rate: float = 0.05, ridge: float = 1e-3) -> Model:
    """Maximum conditional likelihood by Adam, both labels weighing the same in total."""
    lines = Lines.of(texts)
    k = lines.x.shape[1]
    if not len(lines.x) or len(set(labels.tolist())) < 2:
        return Model(np.zeros(k), np.zeros((2, 2)), np.zeros(k), np.ones(k))
    mean, spread = lines.x.mean(0), lines.x.std(0) + 1e-3
    mean[0], spread[0] = 0, 1
    x, n = (lines.x - mean) / spread, np.diff(lines.starts)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    per_line, y = np.repeat(weight / np.maximum(n, 1), n), np.repeat(labels, n)
    seen = np.zeros((len(n), 2, 2))
    seen[np.arange(len(n)), labels, labels] = np.maximum(n - 1, 0)
    theta, m, v = np.zeros(k + 4), np.zeros(k + 4), np.zeros(k + 4)
    for i in range(1, rounds + 1):
        marg, pairs = forward_backward(x @ theta[:k], lines.starts, theta[k:].reshape(2, 2))
        up = x.T @ (per_line * (y - marg))
        across = ((seen - pairs) * (weight / np.maximum(n, 1))[:, None, None]).sum(0)
        g = np.append(up, across.ravel()) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
    model = Model(theta[:k], theta[k:].reshape(2, 2), mean, spread)
    z = model.raw(lines)
    keep = ~np.isnan(z)
    model.slope, model.shift = _curve(z[keep], labels[keep])
    return model


def _curve(z: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of a ridge logistic curve, by Newton steps."""
    a = np.stack([z, np.ones_like(z)], 1)
    beta = np.array([0.5, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (p - y) + 1e-2 * beta
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(h, g), -2, 2)
    return max(float(beta[0]), 1e-3), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = TRAIN_DOCS) -> Model:
    """Fits on at most about `bound` labelled rows outside the held-out fold."""
    chosen = common.bounded_sample(common.clear_labels(labels, id_col, label_col), "_id", bound // 2, "_y")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter(F.col("_t").isNotNull()).join(F.broadcast(chosen), "_id")
    once = common.staged(common.one_text(rows, "_id", "_y"), "quality-train")
    got = common.within_bytes(once, "_id", "_t", TRAIN_BYTES).orderBy("_id").toPandas()
    common.discard(once)
    return fit(got["_t"].tolist(), got["_y"].to_numpy(int))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score; one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double")


def op1_crf_quality(spark, sf_dir, docs: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Quality of every document; see the module's docstring."""
    common.prepare(spark)
    docs = common.documents(spark, sf_dir) if docs is None else docs
    labels = common.documents(spark, sf_dir, "labels") if labels is None else labels
    scored = score_quality(docs, train(docs, labels))
    return scored.select("doc_id", (common.fold("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op1_crf_quality": op1_crf_quality}
ORACLES: dict[str, str] = {}

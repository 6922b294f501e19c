"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier over hashed byte n-grams predicts each bit, and
loss-weighted decoding picks the language whose codeword costs least under the logistic loss. The score
is the share of the chosen codeword in the softmax of the losses; a small lead over the second marks
the document ambiguous.

Trained on about TRAIN_PER_LANG documents of each language and TRAIN_TOTAL of all, but one of every language
(documented bounds), outside the held-out fold; executors make the vectors that the driver fits. Edge cases: a text that is null or has no
letter is `und` with score 0; texts of any length are read whole; rows without a language or an id never
train, and of several texts of an id and language the least one does; with no labelled row everything is
`und`; repeated rows get equal answers; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import common

TRAIN_PER_LANG, TRAIN_TOTAL = 1000, 8000
BUCKETS = 4096
AMBIGUOUS_BELOW = 0.05
_LETTER = re.compile(r"[^\W\d_]")
_NOISE = re.compile(r"[\W\d_]+")


def codebook(classes: int, seed: int = 7) -> np.ndarray:
    """Codewords of +-1: every split of the classes in two where these are few, else the best of random ones."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 6:
        rows = [(1, *rest) for rest in itertools.product((1, -1), repeat=classes - 1)]
        return np.array([r for r in rows if -1 in r], float).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes)))
    best, found = -1, None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (classes, bits))
        apart = (bits - code @ code.T) / 2
        least = apart[~np.eye(classes, dtype=bool)].min()
        if least > best and (np.abs(code.sum(0)) < classes).all():
            best, found = least, code
    return found


def features(texts: list, buckets: int = BUCKETS) -> np.ndarray:
    """Square roots of hashed counts of byte 1- to 4-grams over the letters of each whole text, scaled to length 1."""
    out = np.zeros((len(texts), buckets), "f4")
    for i, t in enumerate(texts):
        a = np.frombuffer(f" {_NOISE.sub(' ', t.lower())} ".encode("utf-8", "replace"), "u1").astype("u4")
        g2 = a[:-1] << 8 | a[1:]
        parts = [a, g2]
        if len(a) > 2:
            g3 = g2[:-1] << 8 | a[2:]
            parts.append(g3)
            if len(a) > 3:
                parts.append(g3[:-1] << 8 | a[3:])
        counts = np.zeros(buckets)
        for n, g in enumerate(parts):
            h = (g + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            counts += np.bincount((h ^ h >> np.uint32(15)) % np.uint32(buckets), minlength=buckets)
        root = np.sqrt(counts)
        out[i] = root / np.linalg.norm(root)
    return out


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    w: np.ndarray
    b: np.ndarray

    def decode(self, texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and lead over the second."""
        lang, score, lead = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if t and self.languages and _LETTER.search(t)]
        for lo in range(0, len(some), 256):
            part = some[lo : lo + 256]
            margin = features([texts[i] for i in part]) @ self.w + self.b
            loss = np.logaddexp(0, -self.code[None] * margin[:, None]).sum(2) * 2 / self.code.shape[1]
            z = np.exp(-(loss - loss.min(1, keepdims=True)) * 2)
            share = z / z.sum(1, keepdims=True)
            top = np.sort(share, 1)
            for i, k, s, first, second in zip(part, loss.argmin(1), share.max(1), top[:, -1], top[:, -2] if share.shape[1] > 1 else np.zeros(len(part))):
                lang[i], score[i], lead[i] = self.languages[k], s, first - second
        return lang, score, lead


def fit(x: np.ndarray, langs: list[str], rounds: int = 250, rate: float = 4.0, ridge: float = 1e-5) -> Model:
    """Logistic regression of each bit by accelerated gradient steps, languages weighing the same."""
    names = sorted(set(langs))
    code = codebook(len(names))
    y = np.array([names.index(v) for v in langs], int)
    bits = code[y].astype("f4") if len(y) else np.zeros((0, code.shape[1]), "f4")
    weight = (1 / np.maximum(1, np.bincount(y, minlength=len(names))))[y][:, None].astype("f4") / max(1, len(names))
    w = np.zeros((x.shape[1], code.shape[1]), "f4")
    b = np.zeros(code.shape[1], "f4")
    pw, pb = w, b
    for i in range(rounds if len(y) else 0):
        vw, vb = w + i / (i + 3) * (w - pw), b + i / (i + 3) * (b - pb)
        pull = weight * bits / (1 + np.exp(np.clip(bits * (x @ vw + vb), -30, 30)))
        pw, pb = w, b
        w, b = vw + rate * (x.T @ pull - ridge * vw), vb + rate * 0.1 * pull.sum(0)
    return Model(names, code, w, b)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = TRAIN_PER_LANG) -> Model:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_l"))
    rows = rows.filter((common.fold("_id") != 2) & F.col("_id").isNotNull() & F.col("_l").isNotNull() & F.col("_t").rlike(r"\p{L}"))
    chosen = common.one_text(common.bounded_sample(rows, "_id", bound, "_l", TRAIN_TOTAL), "_id", "_l")
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # vectors of one size come to the driver, whatever the length of the texts
            x = features(b.column(2).to_pylist()).astype("f2")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.tobytes() for v in x], pa.binary())], ["_id", "_l", "x"])

    got = chosen.select("_id", "_l", "_t").mapInArrow(run, f"_id {kind}, _l string, x binary").toPandas().sort_values(["_id", "_l"])
    x = np.frombuffer(b"".join(got["x"]), "f2").astype("f4").reshape(len(got), BUCKETS)
    return fit(x, got["_l"].tolist())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with lang_pred, lang_score and lang_ambiguous appended."""
    names = [id_col, text_col]
    schema = f"{docs.select(id_col).schema[0].name} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, lead = model.decode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(lead < AMBIGUOUS_BELOW)], [id_col, "lang_pred", "score", "ambiguous"])

    return docs.select(*names).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is identified, that is, not `und`. Ambiguous ones stay, whatever their length."""
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, _, _ = model.decode(batch.column(at).to_pylist())
            yield batch.filter(pa.array([g != "und" for g in lang], pa.bool_()))

    return docs.select(*names).mapInArrow(run, docs.schema)


def op8_ecoc_language(spark, sf_dir, docs: DataFrame | None = None) -> DataFrame:
    """Language of every document; see the module's docstring."""
    common.prepare(spark)
    docs = common.documents(spark, sf_dir) if docs is None else docs
    out = identify(docs, train(docs))
    return out.select("doc_id", (common.fold("doc_id") == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op8_ecoc_language": op8_ecoc_language}
ORACLES: dict[str, str] = {}

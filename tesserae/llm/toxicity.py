"""Toxicity from a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs and full-width forms to Latin letters, undoes digit and sign
substitutions between letters, and separates words by one space. Lexicon terms are word beginnings
with a weight, the smoothed log odds of occurring in toxic documents; exception
phrases (given ones, and words that begin like a term but occur in clean documents) cancel the terms
that they cover. The weights found are normalised by length and turned into a probability by a
logistic curve.

Lexicon and curve are learned from about TRAIN_DOCS labelled documents (a documented bound) outside
the held-out fold, beside a small fixed list. Edge cases: null and empty texts match nothing and get
the curve's lowest score; texts of any length are matched whole, in time linear but for sorting their
matches; rows without a label, without an id, or of an id with both labels never train, and of several
texts of an id the least one does; without labels the fixed list and a fixed curve serve; repeated rows
score alike; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import common

TRAIN_DOCS = 30_000
SHORTEST, LONGEST = 3, 8  # characters of a learned word beginning
MIN_DOCS, MIN_Z, MIN_WEIGHT = 6, 6.0, 0.7  # documents, standard errors and log odds that a learned term needs

# A start of the lexicon with weights, and phrases in which its words are harmless.
SEEDS = {"idiot": 3.0, "moron": 3.0, "scum": 3.0, "stupid": 2.0, "worthless": 2.0, "pathetic": 2.0, "loser": 2.0, "disgusting": 2.0, "imbecile": 3.0, "bastard": 3.0}
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "clown fish", "clownfish", "sore loser rule", "pond scum", "soap scum", "idiot proof", "loser bracket", "losers bracket")
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}

_GLYPHS = str.maketrans(HOMOGLYPHS | {chr(0xFF21 + i): chr(97 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | dict.fromkeys("​‌‍⁠﻿­"))
_SWAPS = str.maketrans(SUBSTITUTES)
_MIXED = re.compile(r"(?<![\w@$!|+])[^\W01345781_]*+[01345781@$!|+][\w@$!|+]*+")
_SIGNS_BEHIND = re.compile(r"(?:[!|+]+|[@$]{3,})\Z")
_WORD = re.compile(r"[^\W_]+")


def _unswap(m: re.Match) -> str:
    """A word with digits or signs in it: substitutions are undone where it has two letters or more."""
    core = _SIGNS_BEHIND.sub("", m[0])
    return core.translate(_SWAPS) if sum(map(str.isalpha, core)) >= 2 else m[0]


def fold(text: str) -> str:
    """The folded text: words between single spaces, with one at either end."""
    t = text.lower()
    if not t.isascii():
        t = t.translate(_GLYPHS)
    return f" {' '.join(_WORD.findall(_MIXED.sub(_unswap, t)))} "


@dataclass
class Lexicon:
    """Terms (word beginnings) with weights, exceptions (whole words or phrases), and the curve's coefficients."""

    terms: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, ...] = (-3.0, 1.0, 0.5, 0.5)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for term, w in self.terms.items():
            a.add_word(f" {term}", (len(term), w))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (len(phrase) + 1, None))
        if len(a):
            a.make_automaton()
        return a

    def matches(self, automaton, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the heaviest term at each place, outside exceptions."""
        if not len(automaton):
            return []
        best: dict[int, tuple[int, float]] = {}
        spared = []
        for end, (n, w) in automaton.iter(folded):
            start = end - n + 1
            if w is None:
                spared.append((start, end))
            elif start not in best or w > best[start][1]:
                best[start] = (end + 1, w)
        spared.sort()
        begins, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
        clear = lambda s: not (k := bisect_right(begins, s)) or reach[k - 1] <= s
        return [(s, e, w) for s, (e, w) in best.items() if clear(s)]

    def features(self, texts: list) -> np.ndarray:
        """Constant, heaviest weight, log of the summed weight, and weight for each word, square root."""
        a, rows = self.automaton(), []
        for t in texts:
            folded = fold(t or "")
            found = self.matches(a, folded)
            total, words = sum(w for _, _, w in found), folded.count(" ")
            rows.append((1.0, max((w for _, _, w in found), default=0.0), np.log1p(total), np.sqrt(total / max(words, 1))))
        return np.array(rows, float).reshape(len(rows), 4)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.curve), -40, 40)))


def _term_counts(rows: DataFrame) -> DataFrame:
    """(term, toxic, clean): documents of either label with a word that begins with the term, or, ending in a space, is it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(fold(t or "").split())
                terms = {w[:k] for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}
                (toxic if y else clean).update(terms | {f"{w} " for w in words})
        terms = list(toxic.keys() | clean.keys())
        for lo in range(0, len(terms), 50_000):
            part = terms[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[w] for w in part], pa.int64()), pa.array([clean[w] for w in part], pa.int64())], ["term", "toxic", "clean"])

    counted = rows.select("_t", "_y").mapInArrow(run, "term string, toxic long, clean long")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = TRAIN_DOCS) -> Lexicon:
    chosen = common.bounded_sample(common.clear_labels(labels, id_col, label_col), "_id", bound)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter(F.col("_t").isNotNull())
    rows = common.staged(common.one_text(rows.join(F.broadcast(chosen), "_id"), "_id", "_y"), "toxicity-train")
    by = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = by.get(1, 0), by.get(0, 0)
    if not toxic or not clean:
        return Lexicon(dict(SEEDS), EXCEPTIONS)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 1) / (clean + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    pooled = (F.col("toxic") + F.col("clean") + 0.5) / (toxic + clean + 1)
    z = (F.col("toxic") / toxic - F.col("clean") / clean) / F.sqrt(pooled * (1 - pooled) * (1 / toxic + 1 / clean))
    counts = common.staged(_term_counts(rows), "toxicity-terms")
    heavy = counts.filter((F.col("toxic") >= MIN_DOCS) & ~F.col("term").endswith(" ") & (z >= MIN_Z) & (odds >= MIN_WEIGHT))
    found = {r["term"]: r["w"] for r in heavy.select("term", odds.alias("w")).collect()}
    terms: dict[str, float] = {}
    for t in sorted(found, key=lambda t: (len(t), t)):  # a longer beginning stays only where it says more than a shorter one
        shorter = [terms[t[:k]] for k in range(SHORTEST, len(t)) if t[:k] in terms]
        if not shorter or found[t] > max(shorter) + 0.3:
            terms[t] = found[t]
    seeds = {t: w for t, w in SEEDS.items() if not any(t.startswith(p) for p in terms)}
    begins = F.lit(False)
    for n in {len(t) for t in terms}:
        begins = begins | F.substring("term", 1, n).isin([t for t in terms if len(t) == n])
    harmless = counts.filter(F.col("term").endswith(" ") & (F.col("clean") >= MIN_DOCS) & begins & (odds + 2 * error < 0.5))
    exceptions = (*EXCEPTIONS, *sorted(r["term"].strip() for r in harmless.select("term").collect()))
    lexicon = Lexicon(terms | seeds, exceptions)
    scored = rows.select("_t", "_y").mapInArrow(_features_of(lexicon), "y int, f1 double, f2 double, f3 double")
    got = scored.groupBy("y", "f1", "f2", "f3").count().orderBy("y", "f1", "f2", "f3").toPandas()
    lexicon.curve = _curve(np.column_stack([np.ones(len(got)), got[["f1", "f2", "f3"]].to_numpy()]), got["y"].to_numpy(float), got["count"].to_numpy(float))
    common.discard(rows)
    common.discard(counts)
    return lexicon


def _features_of(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.round(lexicon.features(batch.column(0).to_pylist()), 6)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(f[:, k]) for k in (1, 2, 3))], ["y", "f1", "f2", "f3"])

    return run


def _curve(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[float, ...]:
    """Ridge logistic regression of weighted rows, by Newton steps."""
    beta = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], 0.05)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (n * (p - y)) + keep * beta
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(keep)
        beta = beta - np.clip(np.linalg.solve(h, g), -2, 2)
    return tuple(float(b) for b in beta)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, matches (terms found with their places in the folded text)."""
    schema = "doc_id long, score double, n_matches int, worst string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for batch in batches:
            rows, counts, worst = [], [], []
            for t in batch.column(1).to_pylist():
                folded = fold(t or "")
                found = lexicon.matches(a, folded)
                total = sum(w for _, _, w in found)
                rows.append((1.0, max((w for _, _, w in found), default=0.0), np.log1p(total), np.sqrt(total / max(folded.count(" "), 1))))
                counts.append(len(found))
                top = max(found, key=lambda m: (m[2], -m[0]), default=None)
                worst.append(folded[top[0] : top[1]] if top else None)
            score = lexicon.score(np.array(rows, float).reshape(len(rows), 4))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(counts, pa.int32()), pa.array(worst, pa.string())], ["doc_id", "score", "n_matches", "worst"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def op9_lexicon_toxicity(spark, sf_dir, docs: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Toxicity of every document; see the module's docstring."""
    common.prepare(spark)
    docs = common.documents(spark, sf_dir) if docs is None else docs
    labels = common.documents(spark, sf_dir, "labels") if labels is None else labels
    scored = score_toxicity(docs, learn(docs, labels))
    return scored.select("doc_id", (common.fold("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_matches", "worst")


QUERIES = {"op9_lexicon_toxicity": op9_lexicon_toxicity}
ORACLES: dict[str, str] = {}

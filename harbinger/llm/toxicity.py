"""Toxicity by multiple-instance learning.

Only documents are labelled, yet a few sentences make a document toxic.  Every sentence
gets a logistic score, a document's probability is the noisy-or of its sentences (it is
harmless only if all of them are), and the sentence weights are fitted so that this
probability agrees with the document labels.  The same weights then point at the
sentences themselves.  A sentence is known by its words and by how these begin, so that
inflected and compound forms of an offending stem count although they were never seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.llm.common import small_batches, with_fields
from harbinger.session import cut_lineage

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
WORD_JVM = r"[^\p{L}\p{M}]+"
STEMS = (3, 5, 7)  # letters of a word's beginnings


@dataclass
class Model:
    bias: float
    weights: dict[str, float]


def known_parts(table: dict[str, object]) -> Callable[[str], tuple[str, ...]]:
    """A function that gives those of a word and its beginnings (marked by a star) that ``table`` holds."""

    @lru_cache(maxsize=50_000)
    def parts(word: str) -> tuple[str, ...]:
        return tuple(p for p in (word, *(word[:k] + "*" for k in STEMS if len(word) >= k)) if p in table)

    return parts


def sentence_bags(text: str | None, vocabulary: dict[str, int], parts: Callable[[str], tuple[str, ...]]) -> list[list[int]]:
    """Per sentence with a word: the parts of the vocabulary in it, each once."""
    out = []
    for s in SENTENCE.findall((text or "").lower()):
        words = set(WORD.findall(s))
        if words:
            out.append(sorted({vocabulary[p] for w in words for p in parts(w)}))
    return out


def informative_words(labelled: DataFrame, text: str, label: str, size: int) -> list[str]:
    """The ``size`` words and beginnings whose document frequency differs most between the labels (chi-square)."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), WORD_JVM))

    def beginnings(k: int) -> Column:
        longer = F.filter(words, lambda w: F.length(w) >= k)
        return F.array_distinct(F.transform(longer, lambda w: F.concat(F.substring(w, 1, k), F.lit("*"))))

    rows = labelled.select(
        (F.col(label) == 1).cast("int").alias("y"),
        F.explode(F.concat(words, *[beginnings(k) for k in STEMS])).alias("w"),
    ).where("w != ''")
    totals = labelled.agg(F.count("*").alias("n"), F.sum((F.col(label) == 1).cast("int")).alias("p")).first()
    n, p = float(totals.n), float(totals.p or 0)
    seen = rows.groupBy("w").agg(F.count("*").alias("d"), F.sum("y").alias("dp")).where("d >= 3")
    gap = F.col("dp") * n - F.col("d") * p
    spread = F.col("d") * (n - F.col("d")) * p * (n - p)
    ranked = seen.select("w", F.when(spread > 0, n * gap * gap / spread).otherwise(0.0).alias("x"))
    best = ranked.where("x > 10.8").orderBy(F.desc("x"), "w").limit(size)
    return [r.w for r in best.collect()]


def fit(bags: list[list[list[int]]], labels: np.ndarray, words: list[str], rounds: int = 600,
        ridge: float = 3e-5, rate: float = 0.15) -> Model:
    """Maximum likelihood of the noisy-or by Adam, both labels weighing the same.  The bias starts
    low, as few sentences offend.  Equal sentences of a document are held once with their number."""
    held = [Counter(map(tuple, sentences)) for sentences in bags]
    doc = np.array([d for d, kinds in enumerate(held) for _ in kinds], dtype=np.int64)
    times = np.array([n for kinds in held for n in kinds.values()], dtype=float)
    nnz = [len(s) for kinds in held for s in kinds]
    row = np.repeat(np.arange(len(nnz)), nnz)
    col = np.array([w for kinds in held for s in kinds for w in s], dtype=np.int64)
    theta = np.zeros(len(words) + 1)
    theta[-1] = -6.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    for t in range(1, rounds + 1):
        z = theta[-1] + np.bincount(row, weights=theta[col], minlength=len(nnz))
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        quiet = np.bincount(doc, weights=times * np.log1p(-np.minimum(s, 1 - 1e-12)), minlength=len(labels))
        p = np.maximum(-np.expm1(quiet), 1e-12)
        pull = (np.where(labels == 1, (1 - p) / p, -1.0) * share)[doc] * times * s
        grad = np.append(np.bincount(col, weights=pull[row], minlength=len(words)), pull.sum())
        grad[:-1] -= ridge * theta[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta += rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-10)
    return Model(float(theta[-1]), {w: float(x) for w, x in zip(words, theta, strict=False)})


def learn(texts: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          words: int = 3000, sample: int = 20_000) -> Model:
    """Sentence weights from labelled texts; ``labels`` has ``key`` and a ``label`` of 0 or 1.

    At most about ``sample`` labelled rows are used, half of each label where there are
    enough, chosen by a hash of their keys.  Only their keys are sent out, so the texts of
    the corpus are not shuffled.  Other labels and null keys teach nothing.  With one
    label only, or none, the model says 0 for everything.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).alias("_y"))
    n = {r._y: r["count"] for r in known.groupBy("_y").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model(-30.0, {})
    share = F.when(F.col("_y") == 1, sample / 2 / n[1]).otherwise(sample / 2 / n[0])
    h = F.pmod(F.xxhash64(key), F.lit(1_000_000)) / 1e6
    picked = known.where(h < share).orderBy(h, key).limit(2 * sample)
    rows = cut_lineage(texts.join(F.broadcast(picked), key).select(F.col(text).alias("text"), "_y"))
    chosen = informative_words(rows, "text", "_y", words)
    vocabulary = {w: i for i, w in enumerate(chosen)}

    @F.pandas_udf("array<array<int>>")
    def bagged(column: pd.Series) -> pd.Series:
        parts = known_parts(vocabulary)
        return pd.Series([sentence_bags(v, vocabulary, parts) for v in column])

    bags, found = [], []
    for r in rows.select("_y", bagged("text").alias("bags")).toLocalIterator():
        bags.append(r.bags)
        found.append(r._y)
    return fit(bags, np.array(found), chosen)


def sentence_scores(text: str | None, model: Model, parts: Callable[[str], tuple[str, ...]]) -> list[tuple[int, int, float]]:
    """``(start, end, score)`` of each sentence with a word."""
    out = []
    for m in SENTENCE.finditer(text or ""):
        words = set(WORD.findall(m[0].lower()))
        if words:
            z = model.bias + sum(model.weights[p] for p in sorted({p for w in words for p in parts(w)}))
            out.append((m.start(), m.end(), 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))))
    return out


def score(texts: DataFrame, model: Model, text: str = "text", offending: float = 0.5) -> DataFrame:
    """Input columns, ``score double`` (noisy-or over all sentences of the whole text) and
    ``offending array<struct<start: int, end: int, score: double>>``, the sentences at or over
    ``offending`` with their places in the text.

    A text without a word (null, empty, signs only) scores 0 and has none.  Repeated rows
    come out alike; an input column of an output's name gives way to it.
    """
    small_batches(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, offending array<struct<start: int, end: int, score: double>>")
    def scored(column: pd.Series) -> pd.DataFrame:
        model, totals, places = shared.value, [], []
        parts = known_parts(model.weights)
        for value in column:
            found = sentence_scores(value, model, parts)
            p = -np.expm1(sum(np.log1p(-min(s, 1 - 1e-12)) for _, _, s in found)) if found else 0.0
            totals.append(float(min(1.0, max(0.0, p))))
            places.append([{"start": a, "end": b, "score": float(s)} for a, b, s in found if s >= offending])
        return pd.DataFrame({"score": totals, "offending": places})

    return with_fields(texts, scored(F.col(text)), ["score", "offending"])

"""Toxicity: bags of subword embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its character n-grams, so an unseen misspelling shares most of the vector
of the word that it bends. The softmax rates each distinct word of a text, and the text is toxic unless all its words are
clean: 1 - score is the product of the words' probabilities of being clean.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 17
DIM = 8
NGRAMS = (3, 4, 5, 6)
LONGEST_WORD = 40
#: Labelled rows that the model is fitted on: at most so many of each class, those with the smallest hashes.
FIT_ROWS = 2000
#: Share of labels taken to be wrong, so that a text whose label nothing explains doesn't teach its rare words.
NOISE = 0.02
#: A bucket that fewer texts of the sample have is not trained.
LEAST_TEXTS = 3
#: Words whose strength a Python worker keeps from task to task; beyond that it starts anew.
CACHE = 400_000
_KNOWN: dict[int, dict[str, float]] = {}
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def words_of(text: str | None) -> set[str]:
    """Distinct words of the whole text, lower-cased, without punctuation at the edges; a longer word counts by its pieces."""
    words = {w.strip(_EDGES) for w in _WORD.findall((text or "").lower())}
    long = {w for w in words if len(w) > LONGEST_WORD}
    return (words - long).union(w[i : i + LONGEST_WORD] for w in long for i in range(0, len(w), LONGEST_WORD // 2)) - {""}


def grams_of(word: str) -> np.ndarray:
    """Buckets of the word and of its character n-grams."""
    w = f"<{word}>"
    grams = sorted({w, *(w[i : i + n] for n in NGRAMS for i in range(len(w) - n + 1))})
    return np.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams], dtype=np.int32)


@dataclass
class Model:
    """weight: the softmax's log-odds of each bucket's embedding; bias: those of a word without any."""

    weight: np.ndarray
    bias: float

    def strength(self, word: str) -> float:
        """-log of the probability that the word is clean."""
        return float(np.logaddexp(0.0, self.weight[grams_of(word)].mean() + self.bias))


def fit(bags_of_words: list[list[str]], toxic: list[int], epochs: int = 100, rate: float = 0.05, decay: float = 0.4, noise: float = NOISE, seed: int = 1) -> Model:
    """Embeddings and softmax by Adam on the cross-entropy of texts, given as their distinct words; without both classes the model knows only the share of toxic texts."""
    if len(set(toxic)) < 2:
        return Model(np.zeros(BUCKETS), -20.0)
    index: dict[str, int] = {}
    bags = [[index.setdefault(w, len(index)) for w in words] for words in bags_of_words]
    grams = [grams_of(w) for w in index]
    gram, n_grams = np.concatenate(grams), np.array([len(g) for g in grams])
    gram_start = np.r_[0, np.cumsum(n_grams)[:-1]]
    word = np.array([w for b in bags for w in b], dtype=np.int64)
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    y = np.array(toxic, dtype=bool)
    texts_with = np.zeros(BUCKETS, dtype=np.int32)
    for bag in filter(None, bags):
        texts_with[np.unique(np.concatenate([grams[w] for w in bag]))] += 1
    common = texts_with >= LEAST_TEXTS
    del grams, bags
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (BUCKETS, DIM)) * common[:, None], rng.normal(0, 0.1, (DIM, 2)), np.array([8.0, 0.0])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for epoch in range(1, epochs + 1):
        embed, out, bias = params
        odds = out[:, 1] - out[:, 0]
        z = np.add.reduceat((embed @ odds)[gram], gram_start) / n_grams + bias[1] - bias[0]
        total = np.maximum(np.bincount(doc, weights=np.logaddexp(0, z)[word], minlength=len(y)), 1e-6)
        clean = np.exp(-total)
        slope = (1 - 2 * noise) / len(y) * clean * np.where(y, -1 / (1 - noise - (1 - 2 * noise) * clean), 1 / (noise + (1 - 2 * noise) * clean))
        dz = np.bincount(word, weights=slope[doc], minlength=len(index)) / (1 + np.exp(-np.clip(z, -50, 50)))
        by_gram = np.bincount(gram, weights=np.repeat(dz / n_grams, n_grams), minlength=BUCKETS) * common
        d_odds = by_gram @ embed
        grads = [np.outer(by_gram, odds), np.stack([-d_odds, d_odds], axis=1), np.array([-dz.sum(), dz.sum()])]
        embed *= 1 - rate * decay
        for p, g, (m, v) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-9)
    embed, out, bias = params
    return Model(embed @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def fit_on(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model of labels.toxic, from rows that are not held out.

    Null labels and labels without a document teach nothing; a doc_id with several labels is toxic if one of them says so, and of several
    texts with one doc_id the first in order is read. The driver gets the distinct words of fit_rows texts a class at most.
    """
    marks = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    order = F.xxhash64("doc_id")
    chosen = marks.filter("y = 1").orderBy(order).limit(fit_rows).union(marks.filter("y = 0").orderBy(order).limit(fit_rows))

    def bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "y": frame["y"], "words": ["\n".join(sorted(words_of(t))) for t in frame["text"]]})

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"))), "doc_id")
    rows = read.mapInPandas(bags, "doc_id long, y int, words string").groupBy("doc_id", "y").agg(F.min("words").alias("words")).collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    return fit([r["words"].split("\n") if r["words"] else [] for r in rows], [r["y"] for r in rows])


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    A null or empty text has score 0. Whole texts of any length are read; repeated rows score alike, an empty table gives no rows, and
    columns other than doc_id and text are not read.
    """

    mark = zlib.crc32(model.weight.tobytes())

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if mark not in _KNOWN:
            _KNOWN.clear()
        known = _KNOWN.setdefault(mark, {})
        for frame in frames:
            scores = []
            for text in frame["text"]:
                total = 0.0
                for w in words_of(text):
                    s = known.get(w)
                    if s is None:
                        s = known[w] = model.strength(w)
                    total += s
                scores.append(-np.expm1(-total))
                if len(known) > CACHE:
                    known.clear()
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "held_out": frame["held_out"], "score": scores}).astype({"score": "float64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return rows.mapInPandas(batches, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

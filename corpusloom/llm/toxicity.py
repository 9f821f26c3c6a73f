"""Toxicity: a counterfactual-regularised linear classifier.

A document is the set of its lower-cased words. Logistic regression with an L1 penalty is fitted on a
bounded sample of labelled documents. For each sampled document with sentences that name a group, a
counterfactual is made in which each identity term is swapped for another of its family, and one in
which it is left out; the squares of the changes in score are penalised, so that neither which group is
named nor that one is named moves a score much.

Null and empty texts have no words and get the score of the intercept; labels that are null or whose
document is missing teach nothing; repeated labels of a document count once, as toxic if any of them is;
equal texts teach once with the mean of their labels. Without a usable label every score is 0. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"(?<=[.!?\n])")

# Families of identity terms; a term is swapped for the next one of its family.
FAMILIES = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "straight"),
    ("transgender", "cisgender"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("africans", "europeans", "asians", "americans"),
    ("immigrants", "refugees", "citizens"),
    ("immigrant", "refugee", "citizen"),
    ("deaf", "blind", "disabled"),
    ("elderly", "young"),
)
SWAP = {term: family[(i + 1) % len(family)] for family in FAMILIES for i, term in enumerate(family)}


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def counterfactual(text: str) -> str:
    """The text with the identity terms of every sentence swapped."""
    return "".join(WORD.sub(lambda m: SWAP.get(m[0].lower(), m[0]), s) if any(w in SWAP for w in WORD.findall(s.lower())) else s for s in SENTENCE.split(text))


def word_ids(words: set[str]) -> list[int]:
    return sorted(xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) - (1 << 63) for w in words)


@dataclass(frozen=True)
class Model:
    """Weights by word; only words with a weight other than 0 are kept."""

    weights: dict[int, float]
    intercept: float
    fitted: bool = True

    def score(self, text: str | None) -> float:
        if not self.fitted:
            return 0.0
        z = self.intercept + math.fsum(self.weights.get(i, 0.0) for i in word_ids(words_of(text)))
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def fit(samples: list[tuple], l1: float = 1e-4, pull: float = 1.0, steps: int = 200, min_docs: int = 3) -> Model:
    """Fit on (word ids, list of the word ids of its counterfactuals, label from 0 to 1) by accelerated proximal gradient.

    ``pull`` weighs the squared change of the linear score between a document and a counterfactual.
    """
    samples = [s for s in samples if s[2] is not None]
    if not samples:
        return Model({}, 0.0, False)
    y = np.array([s[2] for s in samples])
    flat = np.concatenate([np.array(s[0], np.int64) for s in samples])
    names, counts = np.unique(flat, return_counts=True)
    names = names[counts >= min(min_docs, max(1, len(samples) // 10))]
    # words of counterfactuals get weights too
    pairs = [(i, np.asarray(other, np.int64)) for i, s in enumerate(samples) for other in s[1]]
    extra = np.unique(np.concatenate([np.zeros(0, np.int64), *(x for _, x in pairs)]))
    swapped = np.array(word_ids(set(SWAP)), np.int64)
    names = np.union1d(names, np.intersect1d(extra, swapped))
    if not len(names):
        return Model({}, float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))

    def rows(sets: list) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        ids = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in sets)])
        at = np.minimum(np.searchsorted(names, ids), len(names) - 1)
        hit = names[at] == ids
        return row[hit], at[hit]

    n, d = len(y), len(names)
    row, col = rows([s[0] for s in samples])
    here, there = rows([samples[i][0] for i, _ in pairs]), rows([x for _, x in pairs])
    dr, dc = np.concatenate((here[0], there[0])), np.concatenate((here[1], there[1]))
    sign = np.concatenate((np.ones(len(here[0])), -np.ones(len(there[0]))))
    # what a pair has in common cancels
    cell, at = np.unique(dr * d + dc, return_inverse=True)
    sign = np.bincount(at, weights=sign, minlength=len(cell))
    dr, dc, sign = cell[sign != 0] // d, cell[sign != 0] % d, sign[sign != 0]
    weight = np.full(n, 1 / n)
    w, b, v, vb, t = np.zeros(d), 0.0, np.zeros(d), 0.0, 1.0
    # per-word step sizes: the bound of the curvature along a word times the words of its heaviest documents
    per_doc = np.bincount(row, minlength=n) + 1
    curve = np.bincount(col, weights=(0.25 * weight * per_doc)[row], minlength=d)
    if len(dr):
        per_pair = np.bincount(dr, minlength=len(pairs))
        curve += np.bincount(dc, weights=(2 * pull / n * per_pair)[dr], minlength=d)
    step, step_b = 1 / np.maximum(curve, 1e-12), 1 / float((0.25 * weight * per_doc).sum())
    for _ in range(steps):
        z = vb + np.bincount(row, weights=v[col], minlength=n)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        grad = np.bincount(col, weights=g[row], minlength=d)
        if len(dr):
            delta = np.bincount(dr, weights=sign * v[dc], minlength=len(pairs))
            grad += np.bincount(dc, weights=sign * (2 * pull / n * delta)[dr], minlength=d)
        new = v - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_b = vb - step_b * g.sum()
        if ((v - new) * (new - w)).sum() + (vb - new_b) * (new_b - b) > 0:
            t = 1.0  # restart
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    keep = np.flatnonzero(w)
    return Model(dict(zip(names[keep].tolist(), w[keep].tolist(), strict=True)), float(b))


def _features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        out = []
        for text in texts:
            words = words_of(text)
            named = not words.isdisjoint(SWAP)
            swapped, without = (word_ids(words_of(counterfactual(text))), word_ids(words - set(SWAP))) if named else ([], [])
            out.append((word_ids(words), swapped, without, named, xxhash.xxh64_intdigest((text or "").encode("utf-8", "replace")) - (1 << 63)))
        yield pd.DataFrame(out, columns=["words", "swapped", "without", "named", "text_hash"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 10_000, sample_words: int = 40_000_000, id_col: str = "doc_id", text_col: str = "text", **options) -> Model:
    """Fit on at most ``sample`` labelled documents, those whose id hashes lowest, and of an id with several texts those of the lowest hashes.

    The driver holds the sample. It is bounded by ``sample`` rows and by ``sample_words``, the distinct
    words of all its documents and their counterfactuals together: a document that would pass that bound,
    in the order of the texts' hashes, is not drawn. One that is drawn counts with all its words, and
    scoring uses all words of all texts. Of rows equal in id and text, one is drawn if the rows of the
    drawn ids are more than the sample.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    # the sample is drawn from ids alone; texts are read for the drawn ones only
    drawn = known.orderBy(order, "doc_id").limit(sample)
    own = texts.join(F.broadcast(drawn), "doc_id")
    if docs.select(F.col(id_col).alias("doc_id")).join(F.broadcast(drawn), "doc_id").count() > sample:  # ids with several rows
        pairs = own.groupBy("doc_id", F.xxhash64("_text").alias("_hash")).count().orderBy(order, "doc_id", "_hash").limit(sample)
        pairs = F.broadcast(pairs.select(F.col("doc_id").alias("_id"), "_hash"))
        own = own.join(pairs, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("_text") == F.col("_hash"))).dropDuplicates(["_id", "_hash"])
    feature = F.pandas_udf(_features, "words array<long>, swapped array<long>, without array<long>, named boolean, text_hash long")
    rows = own.select("_toxic", feature("_text").alias("f")).select("_toxic", "f.*")
    found = _gathered(rows, sample_words)
    if found is None:
        found = _gathered(rows.orderBy("text_hash"), sample_words, leave_out=True)
    return fit([(words, others, toxic / n) for _, (words, others, toxic, n) in sorted(found.items())], **options)


def _gathered(rows: DataFrame, most: int, leave_out: bool = False) -> dict[int, list] | None:
    """Words, counterfactuals, toxic rows and rows by text; where these hold more than ``most`` words, None, or without those that pass it."""
    own: dict[int, list] = {}
    held = 0
    for r in rows.toLocalIterator():
        if r.text_hash not in own:
            size = len(r.words) + len(r.swapped) + len(r.without)
            if held + size > most:
                if leave_out:
                    continue
                return None
            held += size
            others = [np.array(x, np.int64) for x in (r.swapped, r.without) if r.named]
            own[r.text_hash] = [np.array(r.words, np.int64), others, 0, 0]
        own[r.text_hash][2] += r._toxic > 0
        own[r.text_hash][3] += 1
    return own


def score_column(model: Model, text: Column) -> Column:
    """The score of a text, from 0 to 1."""

    def batches(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, memo = model.weights, {}
        for texts in it:
            out = []
            for text in texts:
                found = []
                for w in words_of(text):
                    x = memo.get(w)
                    if x is None:
                        if len(memo) > 50_000:
                            memo.clear()
                        x = memo[w] = weights.get(xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) - (1 << 63), 0.0)
                    if x:
                        found.append(x)
                z = model.intercept + math.fsum(found)  # exact, so that the order of a set doesn't matter
                out.append(1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z)))) if model.fitted else 0.0)
            yield pd.Series(out, dtype="float64")

    return F.pandas_udf(batches, "double")(text)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` added."""
    return docs.withColumn("score", score_column(model, F.col(text_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, fold: int = 5, **options) -> DataFrame:
    """Scores of all documents from a model that saw no row of the held-out fold (crc32 of the id modulo ``fold`` is 0)."""
    model = train(docs, labels.where(crc_mod("doc_id", fold) != 0), **options)
    return score(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", fold) == 0).alias("held_out"), "score", "predicted")

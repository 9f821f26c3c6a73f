"""Language identification with string kernels.

A text is the set of its character n-grams of one to three letters of words (blended spectrum,
presence; n-grams are hashed to DIMS places). The kernel of two texts is the number of n-grams they share, over the root of the product of
their own numbers. Landmarks drawn from the training sample give a Nyström map, and one-versus-rest
kernel ridge regression gives a weight to each landmark and language. Texts are scored in batches by
matrix products: the product of landmarks and weights is formed once, as it doesn't depend on a text.

A text that is null or has no letter is ``und`` with score 0; without training rows all are. A language
is learned if any usable training row has it, whatever their number; the model grows by one column of
DIMS weights a language. Repeated rows are scored each; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

DIMS = 1 << 15
UND = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def presence(text: str | None, dims: int = DIMS) -> np.ndarray:
    """Sorted places of the n-grams that a text has, out of ``dims`` hashed ones; none if it has no letter."""
    letters = NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    if not any(map(str.isalpha, letters)):  # superscript digits and the like are no letters
        return np.zeros(0, np.int32)
    found = np.zeros(dims, bool)
    for at in range(0, len(letters), 1 << 20):  # bounded memory; pieces overlap by two
        c = np.frombuffer(f" {letters} "[at : at + (1 << 20) + 2].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        h = c * np.uint64(0x9E3779B97F4A7C15)
        two = (h[:-1] ^ (h[1:] >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F)
        three = (two[:-1] ^ (h[2:] >> np.uint64(9))) * np.uint64(0x165667B19E3779F9)
        for grams in (h, two, three):
            found[(grams >> np.uint64(40)) % np.uint64(dims)] = True
    return np.flatnonzero(found).astype(np.int32)


def matrix(sets: list[np.ndarray], dims: int = DIMS) -> np.ndarray:
    """Rows of unit length, one for each set."""
    out = np.zeros((len(sets), dims), np.float32)
    for i, s in enumerate(sets):
        if len(s):
            out[i, s] = 1 / np.sqrt(len(s))
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # dims x languages: landmarks times their weights

    def predict(self, sets: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UND] * len(sets), np.zeros(len(sets))
        f = matrix(sets, len(self.weights)) @ self.weights
        best = f.argmax(axis=1)
        score = np.clip((f[np.arange(len(f)), best].astype(float) + 1) / 2, 0, 1)
        none = np.array([not len(s) for s in sets], bool)
        return [UND if n else self.languages[i] for i, n in zip(best, none, strict=True)], np.where(none, 0.0, score)


def fit(sets: list[np.ndarray], langs: list[str], landmarks: int = 256, ridge: float = 1e-2) -> Model:
    """Nyström features of the kernel at every k-th sample of each language, then one-versus-rest ridge regression."""
    use = [i for i, s in enumerate(sets) if len(s)]
    if not use:
        return Model([], np.zeros((DIMS, 0), np.float32))
    sets, langs = [sets[i] for i in use], [langs[i] for i in use]
    names = sorted(set(langs))
    y = np.array([[1.0 if n == g else -1.0 for n in names] for g in langs])
    own = [[i for i, g in enumerate(langs) if g == n] for n in names]
    share = max(1, landmarks // len(names))
    picked = sorted(i for rows in own for i in rows[:: max(1, len(rows) // share)][:share])
    z = matrix([sets[i] for i in picked])
    k = (z @ z.T).astype(float)
    values, vectors = np.linalg.eigh(k + 1e-6 * np.eye(len(k)))
    root = vectors / np.sqrt(np.maximum(values, 1e-8))  # K^(-1/2) up to a rotation
    phi = np.concatenate([(matrix(sets[at : at + 256]) @ z.T).astype(float) @ root for at in range(0, len(sets), 256)])
    balance = np.array([1 / len(own[names.index(g)]) for g in langs]) * len(langs) / len(names)
    left = (phi * balance[:, None]).T @ phi + ridge * len(phi) * np.eye(phi.shape[1]) / len(names)
    w = np.linalg.solve(left, (phi * balance[:, None]).T @ y)
    return Model(names, (z.T.astype(float) @ (root @ w)).astype(np.float32))


def _presences(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([presence(t) for t in texts])


def train(docs: DataFrame, per_lang: int = 256, sample: int = 8192, **options) -> Model:
    """Fit on up to ``per_lang`` rows of each language, fewer where that makes more than ``sample`` in all, but at least one.

    Every language is learned. A language's rows fall into as many hash buckets as it may have rows in
    the sample, and of each the one that hashes lowest is drawn. So the driver's sample (sets of at most
    DIMS places) and the broadcast of its keys have at most ``sample`` rows, or one a language if there
    are more languages than that.
    """
    key = F.struct(F.xxhash64(F.col("doc_id"), F.lit(11)).alias("h"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"))
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", key.alias("key"))
    n_langs = usable.agg(F.count_distinct("lang")).first()[0]
    share = max(1, min(per_lang, sample // max(1, n_langs)))
    drawn = usable.groupBy("lang", F.pmod("key.h", F.lit(share)).alias("_b")).agg(F.min("key").alias("key"))
    drawn = drawn.select(F.col("lang").alias("_lang"), F.col("key.id").alias("_id"), F.col("key.t").alias("_text"))
    # a row is drawn by its id, language and text, so a repeated id doesn't bring in rows of other languages
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.xxhash64("text") == F.col("_text"))
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(drawn), same).select("doc_id", "lang", "_text", F.pandas_udf(_presences, "array<int>")("text").alias("places"))
    rows = rows.groupBy("lang", "doc_id", "_text").agg(F.first("places").alias("places"))  # of repeated rows one
    sets, langs = [], []
    for r in rows.orderBy("lang", "doc_id", "_text").toLocalIterator():
        sets.append(np.array(r.places, np.int32))
        langs.append(r.lang)
    return fit(sets, langs, **options)


def identify(docs: DataFrame, model: Model, text_col: str = "text", rows: int = 128) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added."""

    def batches(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in it:
            names, scores = [], []
            for at in range(0, len(texts), rows):
                n, s = model.predict([presence(t if isinstance(t, str) else None) for t in texts.iloc[at : at + rows]])
                names += n
                scores += s.tolist()
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    found = F.pandas_udf(batches, "lang_pred string, score double")
    return docs.withColumn("_l", found(F.col(text_col))).select(*docs.columns, "_l.lang_pred", "_l.score")


def classify(docs: DataFrame, fold: int = 4, held: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, from a model that saw no row whose crc32 of the id modulo ``fold`` is ``held``."""
    model = train(docs.where(crc_mod("doc_id", fold) != held).select("doc_id", "text", "lang"), **options)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", fold) == held).alias("held_out"), "lang_pred", "score")

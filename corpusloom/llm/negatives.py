"""Hard negatives through a pivot table.

Components are scaled and rounded down, so scores are exact integer inner products. One more coordinate,
sqrt(M² - |x|²) with M the largest norm and 0 for anchors, turns the inner product into a Euclidean
distance: d² = |q|² + M² - 2 q·x. A table keeps each row's distances to a few pivots. By the triangle
inequality |d(q,p) - d(x,p)| <= d(q,x) <= d(q,p) + d(x,p), which brackets a score without a product. Rows
are kept by nearest pivot and distance, so blocks of them have narrow ranges of distances and are
bracketed first, then their rows; what may still be among the best is multiplied out. Brackets are widened
by more than the rounding of distances, so nothing is lost by them; on vectors that no pivot tells
apart they leave out little, and the result is the same.

Two passes over the table for a slice of anchors: the best rows of an anchor's label, then for each of
these the best rows of other labels in the range it allows. A task keeps so many rows for each of them
as are asked for, and they are merged by one ranking. A slice holds some ``at_once`` anchors; only these and
their positives' scores go through the driver at a time. Pivots are chosen on it from ``sample`` rows.

Rows with a null label, a null vector or null or non-finite components take no part. Vectors meet those of
their own length only. A null id is no anchor and comes last in ties. Repeated rows count each, but an
anchor that is repeated asks once; rows of the anchor's id aren't its positives. An empty table gives an
empty result, extra columns are ignored. Inner products that may pass 56 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stash

OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Stands for a null id in tasks.
NO_ID = np.iinfo(np.int64).max
ROWS = 512
#: Widening of distances, as a share of M; their rounding is some 2e-8 of it.
SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n if n else 0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = (float(np.abs(a).max(initial=0.0)) + 1) * (float(np.abs(b).max(initial=0.0)) + 1) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**56:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise ValueError("inner products may pass 56 bits")


@dataclass(frozen=True)
class Pivots:
    """``points`` with their additional coordinate ``extra``; ``top`` is M²."""

    points: np.ndarray
    extra: np.ndarray
    top: float

    @classmethod
    def of(cls, sample: np.ndarray, top: float, n: int) -> Pivots:
        """Farthest first: each pivot is the sampled row whose nearest pivot is farthest away."""
        whole = cls(sample, np.sqrt(np.maximum(0.0, top - (sample * sample).sum(1))), top)
        chosen = [0] if len(sample) else []
        near = whole.rows(sample[:1])[0] if len(sample) else np.empty(0)
        while len(chosen) < min(n, len(sample)) and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, whole.rows(sample[chosen[-1:]])[0])
        return cls(whole.points[chosen], whole.extra[chosen], top)

    def rows(self, v: np.ndarray) -> np.ndarray:
        """Distances of rows to the pivots."""
        norm = (v * v).sum(1)
        own = np.sqrt(np.maximum(0.0, self.top - norm))
        square = norm[:, None] + (self.points * self.points).sum(1) - 2 * v @ self.points.T + (own[:, None] - self.extra) ** 2
        return np.sqrt(np.maximum(0.0, square))

    def anchors(self, v: np.ndarray) -> np.ndarray:
        square = (v * v).sum(1)[:, None] + (self.points * self.points).sum(1) + self.extra**2 - 2 * v @ self.points.T
        return np.sqrt(np.maximum(0.0, square))


class Best:
    """For each goal (an anchor, or an anchor and a range) its best rows so far: largest score, then smallest id."""

    def __init__(self, goals: int, k: int):
        self.k = k
        self.scores: list[np.ndarray] = [np.empty(0, np.int64)] * goals
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * goals
        self.least = np.full(goals, np.iinfo(np.int64).min)  # the score that a row must reach
        self.last = np.full(goals, NO_ID)  # at that score it needs an id this small

    def add(self, goal: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[goal], scores]), np.concatenate([self.ids[goal], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[goal], self.ids[goal] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[goal], self.last[goal] = scores[order[-1]], ids[order[-1]]

    def batch(self) -> pa.RecordBatch:
        sizes = [len(x) for x in self.scores]
        ids = np.concatenate([*self.ids, np.empty(0, np.int64)])
        columns = [pa.array(np.repeat(np.arange(len(sizes)), sizes)), pa.array(np.concatenate([*self.scores, np.empty(0, np.int64)])), pa.array(ids, mask=ids == NO_ID)]
        return pa.RecordBatch.from_arrays(columns, names=["goal", "score", "id"])


def search(
    batches: Iterator[pa.RecordBatch],
    pivots: Pivots,
    anchors: tuple[np.ndarray, np.ndarray, np.ndarray],
    goals: tuple[np.ndarray, np.ndarray, np.ndarray],
    same_label: bool,
    k: int,
) -> Best:
    """The ``k`` best rows of a task for each goal: an anchor's number, and the least and greatest score allowed.

    ``anchors`` are vectors, labels and ids; rows must have the anchor's label and another id, or another label.
    """
    vectors, labels, ids = anchors
    at, low, high = goals
    best = Best(len(at), k)
    far = pivots.anchors(vectors)
    slack = 2 * SLACK * np.sqrt(pivots.top) + 1e-9
    base = (vectors * vectors).sum(1) + pivots.top

    def bracket(q: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score brackets of anchors ``q`` and columns whose distances to the pivots lie from least to most."""
        inner, outer = np.zeros((len(q), len(least))), np.full((len(q), len(least)), np.inf)
        for p in range(least.shape[1]):
            d = far[q, p][:, None]
            np.maximum(inner, np.maximum(d - most[:, p], least[:, p] - d), out=inner)
            np.minimum(outer, d + most[:, p], out=outer)
        margin = slack * np.sqrt(pivots.top)
        upper = (base[q][:, None] - np.maximum(0.0, inner - slack) ** 2) / 2 + margin
        return (base[q][:, None] - (outer + slack) ** 2) / 2 - margin, upper

    def open_goals(lower: np.ndarray, upper: np.ndarray, g: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Of goals and columns, whether a score of the bracket would do."""
        return (upper[row] >= np.maximum(low[g], best.least[g])[:, None]) & (lower[row] <= high[g][:, None])

    everyone = np.arange(len(vectors))
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            block = batch.slice(i, ROWS)
            far_rows = _matrix(block.column("far"))
            lower, upper = bracket(everyone, far_rows.min(0)[None], far_rows.max(0)[None])
            g = np.flatnonzero(open_goals(lower, upper, np.arange(len(at)), at)[:, 0])
            if not len(g):
                continue
            q, row = np.unique(at[g], return_inverse=True)
            lower, upper = bracket(q, far_rows, far_rows)
            own_label = block.column("label").to_numpy()
            own_id = pc.fill_null(block.column("id"), NO_ID).to_numpy(zero_copy_only=False)
            same = labels[q][:, None] == own_label
            suits = same & (ids[q][:, None] != own_id) if same_label else ~same
            may = open_goals(lower, upper, g, row) & suits[row]
            keep = np.flatnonzero(may.any(0))
            if not len(keep):
                continue
            score = products(vectors[q], _matrix(block.column("v").take(pa.array(keep))))[row]
            right = may[:, keep] & (score >= np.ceil(low[g])[:, None]) & (score <= np.floor(high[g])[:, None])
            right &= (score > best.least[g][:, None]) | ((score == best.least[g][:, None]) & (own_id[keep] < best.last[g][:, None])) | (best.last[g] == NO_ID)[:, None]
            for j in np.flatnonzero(right.any(1)).tolist():
                columns = np.flatnonzero(right[j])
                best.add(int(g[j]), score[j, columns], own_id[keep[columns]])
    return best


def pivot_table(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """(id, label, v, far): rows with their distances to the pivots; near ones stand together in each task."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = pivots.rows(_matrix(batch.column("v"))) if batch.num_rows else np.empty((0, len(pivots.points)))
            columns = [*batch.columns, pa.array(list(far), pa.list_(pa.float64())), pa.array(far.argmin(1) if far.size else np.zeros(0, np.int64)), pa.array(far.min(1) if far.size else np.zeros(0))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "v", "far", "cell", "near"])

    measured = rows.mapInArrow(measure, "id long, label long, v array<double>, far array<double>, cell long, near double")
    return measured.sortWithinPartitions("cell", "near").select("id", "label", "v", "far")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = F.row_number().over(W.partitionBy("goal").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", order).where(F.col("rank") <= k)


def _usable(table: DataFrame, scale: float, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    def fine(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.coalesce(~F.isnan(y) & (F.abs(y) < float("inf")), F.lit(False))

    rows = table.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, fine))
    # doubles of 2**52 and more are whole
    down = lambda x: F.when(F.abs(x.cast("double") * scale) < 2.0**52, F.floor(x.cast("double") * scale).cast("double")).otherwise(x.cast("double") * scale)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(vector_col, down).alias("v"))


def mine(
    table: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
    pivots: int = 16,
    sample: int = 2048,
    at_once: int = 4096,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by ``every``. A negative's score is from ``low`` to ``high``
    percent of the positive's.
    """
    rows = _usable(table, scale, id_col, label_col, vector_col)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    asked = rows.where(F.col("id") % every == 0).distinct().withColumn("dims", F.size("v"))
    facts = rows.groupBy(F.size("v").alias("dims")).agg(F.max(norm).alias("top"))
    counts = asked.groupBy("dims").agg(F.count("*").alias("n")).join(facts, "dims").orderBy("dims").collect()  # a row for each length of vectors
    found = None
    for fact in counts:
        own = rows.where(F.size("v") == fact.dims)
        drawn = own.select("v").orderBy(F.xxhash64("v", "id")).limit(sample).collect()
        chosen = Pivots.of(np.array([r.v for r in drawn], float).reshape(len(drawn), fact.dims), fact.top, pivots)
        stored = stash(pivot_table(own, chosen), "pivots")
        slices = -(-2 * fact.n // at_once)
        dealt = asked.where(F.col("dims") == fact.dims).drop("dims").withColumn("slice", F.pmod(F.xxhash64("id", "v"), F.lit(slices)).cast("int"))
        dealt = stash(dealt, "anchors", by=("slice",))
        for i in range(slices):
            part = _slice(stored, dealt.where(F.col("slice") == i).select("id", "label", "v"), chosen, positives, negatives, low, high)
            found = part if found is None or part is None else found.unionByName(part)
    return found if found is not None else table.sparkSession.createDataFrame([], OUT)


def _slice(stored: DataFrame, asked: DataFrame, pivots: Pivots, positives: int, negatives: int, low: int, high: int) -> DataFrame | None:
    spark = stored.sparkSession
    own = asked.orderBy("id", "label").collect()  # about at_once / 2 rows
    vectors = np.array([r.v for r in own], float).reshape(len(own), pivots.points.shape[1])
    anchors = (vectors, np.array([r.label for r in own], np.int64), np.array([r.id for r in own], np.int64))

    def scan(goals: tuple[np.ndarray, np.ndarray, np.ndarray], same_label: bool, k: int) -> DataFrame:
        shared = spark.sparkContext.broadcast((pivots, anchors, goals))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield search(batches, *shared.value, same_label, k).batch()

        return _ranked(stored.mapInArrow(task, "goal long, score long, id long"), k)

    n = len(own)
    free = (np.arange(n), np.full(n, -np.inf), np.full(n, np.inf))
    best = scan(free, True, positives).orderBy("goal", "rank").collect()  # at most ``positives`` rows an anchor
    if not best:
        return spark.createDataFrame([], OUT)
    at, score = np.array([r.goal for r in best], np.int64), np.array([r.score for r in best], np.int64)
    goals = (at, -(-score * low // 100), score * high // 100)
    known = [(j, own[r.goal].id, r.id, r.score) for j, r in enumerate(best)]
    known = spark.createDataFrame(known, "goal long, anchor_id long, positive_id long, positive_score long")
    ranked = scan(goals, False, negatives).select("goal", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return ranked.join(F.broadcast(known), "goal").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

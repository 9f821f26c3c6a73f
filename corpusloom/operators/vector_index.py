"""A stored inverted file over vectors: rows lie in folders by the nearest of some centroids.

A question is compared with the centroids, and only the folders of the cells it looks into are read, by
partition pruning. ``probe`` cells are looked into for an approximate answer. For an exact one the rest
of the cells follows from the first: no row of a cell scores above q·c + |q| r, with c its centroid and r
its radius, so the cells whose bound reaches the k-th score found so far are read in a second round.

Centroids are fitted on at most ``sample`` rows; all rows are stored. Rows without a vector aren't.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stash
from . import rank, topk

SLACK = 1e-9


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Lloyd's iteration on a sample; a centroid that no row is nearest to moves to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        own, far = nearest_centroid(sample, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0][:, None]
        empty = np.flatnonzero(counts == 0)
        centres[empty] = sample[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres


def nearest_centroid(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the distance to it."""
    own = (((centres * centres).sum(1)) - 2 * v @ centres.T).argmin(1)
    return own, np.sqrt(((v - centres[own]) ** 2).sum(1))


@dataclass(frozen=True)
class VectorIndex:
    """``path``: rows by cell; ``centroids``, ``radii`` and ``sizes`` by cell; ``keys`` tell rows apart."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    keys: tuple[str, ...]
    id_col: str
    vector_col: str

    @classmethod
    def build(cls, rows: DataFrame, path: str, cells: int | None = None, sample: int = 100_000, id_col: str = "vector_id", vector_col: str = "embedding") -> VectorIndex:
        """Write ``rows`` to ``path`` by cell, and the cells beside it. A cell with very many rows is written by several tasks.

        All vectors must have one length. About the square root of the number of rows is the number of cells.
        """
        rows = rows.where(F.col(vector_col).isNotNull())
        n = rows.count()
        drawn = rows.select(vector_col).orderBy(F.xxhash64(id_col, vector_col)).limit(sample).collect()
        vectors = np.array([r[0] for r in drawn], np.float64)
        wanted = min(cells or round(n**0.5) or 1, max(1, len(vectors)))
        shared = rows.sparkSession.sparkContext.broadcast(fit_centroids(vectors, wanted) if n else np.zeros((1, 0)))

        @F.pandas_udf("cell int, far double")
        def assign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                v = np.stack([np.asarray(x, np.float64) for x in batch]) if len(batch) else np.zeros((0, shared.value.shape[1]))
                own, far = nearest_centroid(v, shared.value)
                yield pd.DataFrame({"cell": own.astype(np.int32), "far": far})

        placed = rows.withColumn("_c", assign(vector_col)).select(*rows.columns, F.col("_c.cell").alias("cell"), F.col("_c.far").alias("_far"))
        # adaptive execution splits a cell that is too large for a task and joins those that are small
        placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)
        stored = rows.sparkSession.read.schema(placed.schema).parquet(path)
        facts = {r.cell: r for r in stored.groupBy("cell").agg(F.max("_far").alias("radius"), F.count("*").alias("n")).collect()}  # a row a cell
        table = [(i, [float(x) for x in c], float(facts[i].radius), facts[i].n, id_col, vector_col, rows.schema.simpleString()) for i, c in enumerate(shared.value) if i in facts]
        kind = "cell int, centroid array<double>, radius double, n bigint, id_col string, vector_col string, kind string"
        rows.sparkSession.createDataFrame(table, kind).coalesce(1).write.mode("overwrite").parquet(path.rstrip("/") + "_cells")
        return cls.open(rows.sparkSession, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        cells = spark.read.parquet(path.rstrip("/") + "_cells").orderBy("cell").collect()
        if not cells:
            return cls(spark, path, np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.int64), ("vector_id",), "vector_id", "embedding")
        most = max(r.cell for r in cells) + 1
        centroids = np.full((most, len(cells[0].centroid)), np.nan)
        radii, sizes = np.full(most, -np.inf), np.zeros(most, np.int64)
        for r in cells:
            centroids[r.cell], radii[r.cell], sizes[r.cell] = r.centroid, r.radius, r.n
        names = spark.read.parquet(path).columns
        return cls(spark, path, centroids, radii, sizes, tuple(c for c in ("tenant", cells[0].id_col) if c in names), cells[0].id_col, cells[0].vector_col)

    def rows(self, cells: np.ndarray | list[int] | None = None) -> DataFrame:
        """The stored rows; of these cells only, whose folders alone are then listed and read."""
        stored = self.spark.read.parquet(self.path)
        return stored if cells is None else stored.where(F.col("cell").isin([int(c) for c in cells]))

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """For each question and cell, the score that no row of the cell exceeds; -inf for empty cells."""
        with np.errstate(invalid="ignore"):
            found = vectors @ np.nan_to_num(self.centroids).T
            found += np.sqrt((vectors * vectors).sum(1))[:, None] * np.where(self.sizes > 0, self.radii, 0)
        return np.where(self.sizes > 0, found, -np.inf)

    def _scan(self, vectors: np.ndarray, k: int, looks: np.ndarray) -> DataFrame:
        """``looks``: which question looks into which cell."""
        cells = np.flatnonzero(looks.any(0))
        asked = np.packbits(looks.T, axis=1)  # a bit for each cell and question
        return topk.best(self.rows(cells), vectors, k, [*self.keys, "cell"], self.id_col, self.vector_col, asked)

    def _first(self, vectors: np.ndarray, probe: int) -> np.ndarray:
        """The ``probe`` cells with the largest product of question and centroid, as a table of questions and cells."""
        score = np.where(self.sizes > 0, vectors @ np.nan_to_num(self.centroids).T, -np.inf)
        order = np.argsort(-score, axis=1, kind="stable")[:, :probe]
        looks = np.zeros(score.shape, bool)
        np.put_along_axis(looks, order, True, 1)
        return looks & (self.sizes > 0)

    def search(self, queries: DataFrame, k: int, probe: int | None = None) -> DataFrame:
        """(query_id, keys, cell, dense, dense_rank from 0): the best rows in ``probe`` cells a question, or the best of all."""
        found = None
        for names, vectors in rank.query_matrices(queries):
            if vectors.shape[1] != self.centroids.shape[1]:
                continue
            if probe is not None:
                hits = self._scan(vectors, k, self._first(vectors, probe))
            else:
                hits = self._exact(vectors, k)
            hits = hits.join(F.broadcast(names), "q")  # at most MOST_QUERIES names
            hits = hits.select("query_id", *self.keys, "cell", F.col("score").alias("dense"), F.col("rank").alias("dense_rank"))
            found = hits if found is None else found.unionByName(hits)
        if found is None:
            kinds = dict(self.rows().dtypes) if len(self.sizes) else {self.id_col: "bigint"}
            found = self.spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, " + ", ".join(f"`{c}` {kinds[c]}" for c in self.keys) + ", cell int, dense double, dense_rank int")
        return found

    def _exact(self, vectors: np.ndarray, k: int) -> DataFrame:
        """Two rounds: a sixteenth of the cells, then those that may still hold a better row."""
        looked = self._first(vectors, max(1, len(self.sizes) // 16))
        first = stash(self._scan(vectors, k, looked), "probed").drop("rank")
        reached = first.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).collect()  # a row a question
        least = np.full(len(vectors), -np.inf)
        for r in reached:
            least[r.q] = r.least
        bounds = self.bounds(vectors)
        with np.errstate(invalid="ignore"):
            rest = ~looked & (self.sizes > 0) & (bounds >= least[:, None] - SLACK * (1 + np.abs(bounds)))
        both = first.unionByName(self._scan(vectors, k, rest).drop("rank")) if rest.any() else first
        order = F.row_number().over(topk.W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last(self.id_col)))
        return both.withColumn("rank", order - 1).where(F.col("rank") < k)

    def fetch(self, found: DataFrame, queries: int, k: int) -> DataFrame:
        """The stored rows of an answer, read from their cells only where these are few."""
        found = stash(found, "found")
        cells = [r.cell for r in found.select("cell").distinct().collect()]  # at most the number of cells
        stored = self.rows(cells).drop("_far")
        return rank.fetch(stored, found, queries, k, [*self.keys, "cell"]).drop("cell")

    def fitted_probe(self, k: int, recall: float = 0.92, sample: int = 256) -> int:
        """The least number of cells by which ``sample`` stored vectors find the share ``recall`` of their ``k`` exact neighbours."""
        drawn = self.rows().select(self.vector_col).orderBy(F.xxhash64(F.lit(1), self.id_col, self.vector_col)).limit(sample).collect()
        vectors = np.array([r[0] for r in drawn], np.float64).reshape(len(drawn), self.centroids.shape[1])
        exact = topk.best(self.rows(), vectors, k, ["cell", *self.keys], self.id_col, self.vector_col).select("q", "cell").collect()  # at most sample * k rows
        score = np.where(self.sizes > 0, vectors @ np.nan_to_num(self.centroids).T, -np.inf)
        place = np.argsort(np.argsort(-score, axis=1, kind="stable"), axis=1)
        need = np.sort([place[r.q, r.cell] + 1 for r in exact])
        return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) if len(need) else 1

    def share_read(self, queries: DataFrame, probe: int) -> tuple[int, int]:
        """Files that ``probe`` cells a question make the scan read, and all files."""
        looks = np.zeros(len(self.sizes), bool)
        for _, vectors in rank.query_matrices(queries):
            looks |= self._first(vectors, probe).any(0)
        files = lambda rows: rows.select("_metadata.file_path").distinct().count()
        return files(self.rows(np.flatnonzero(looks))), files(self.rows())

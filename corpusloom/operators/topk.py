"""Largest inner products of many questions with many rows, in blocks.

A task multiplies blocks of rows by the matrix of all questions and keeps, for each of them, its ``k``
best rows so far. A product within the rounding of what would still count is worked out again term by
term, in the order in which an expression over arrays would add it, so equal vectors have equal scores
wherever they stand and ties go to the smaller id. Only keys and vectors reach Python. What leaves a
task is at most questions x k rows, however many it has read. Of the products of a block only those that
can be among its own ``k`` best a question, or among the best so far, are paired with rows, PAIRS at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Products held at once.
PRODUCTS = 1 << 21

#: Pairs of question and row that are worked out again at once.
PAIRS = 1 << 18


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, len(flat) // n if n else 0)


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up from the first component to the last."""
    every = np.arange(len(a))
    return in_order_at(a, b, every, every)


def in_order_at(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The same of the rows ``i`` of ``a`` and ``j`` of ``b``, a component at a time, so that no row is repeated."""
    total = np.zeros(len(i))
    for c in range(a.shape[1]):
        total += a[i, c] * b[j, c]
    return total


def hopeful(products: np.ndarray, least: np.ndarray, margin: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(question, row) of the products that may reach ``least``; of many only those that may be among the block's own ``k`` best. ``margin``: rounding of a product."""
    reach = least[:, None] - margin
    fine = products >= reach
    if products.shape[1] > k and np.count_nonzero(fine) > 2 * k * len(products):
        kth = np.partition(products, products.shape[1] - k, axis=1)[:, products.shape[1] - k]
        fine &= products >= (kth - margin.max(axis=1))[:, None] - margin
    return np.nonzero(fine)


class Heaps:
    """The best rows of each question so far, as one table (q, score, keys)."""

    def __init__(self, questions: int, k: int, id_col: str):
        self.k, self.id_col = k, id_col
        self.held: list[pa.Table] = []
        self.pending = 0
        self.least = np.full(questions, -np.inf)
        self.most = questions * k + 50_000

    def add(self, rows: pa.Table) -> None:
        self.held.append(rows)
        self.pending += rows.num_rows
        if self.pending > self.most:
            self.cut()

    def cut(self) -> pa.Table | None:
        """Drop what isn't among the ``k`` best of its question, and learn what a row must reach from now on."""
        if not self.held:
            return None
        rows = pa.concat_tables(self.held).sort_by([("q", "ascending"), ("score", "descending"), (self.id_col, "ascending")])
        q = rows["q"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        last = rank == self.k - 1
        self.least[q[last]] = rows["score"].to_numpy()[last]
        rows = rows.filter(pa.array(rank < self.k))
        self.held, self.pending = [rows], 0
        return rows


def scan(batches: Iterator[pa.RecordBatch], questions: np.ndarray, k: int, keys: list[str], id_col: str, asked: dict[int, np.ndarray] | np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(q, score, keys) of a task's best rows. ``asked`` gives for each ``cell`` the questions that look into it, or has a row of bits for each cell."""
    heaps = Heaps(len(questions), k, id_col)
    norms = np.sqrt((questions * questions).sum(1))
    everyone = np.arange(len(questions))
    size = max(16, PRODUCTS // max(1, len(questions)))
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            block = batch.slice(i, size)
            cells = block.column("cell").to_numpy() if asked is not None else np.zeros(block.num_rows, np.int64)
            vectors = matrix(block.column("_v"))
            own = pa.Table.from_batches([block.select(keys)])
            for cell in np.unique(cells).tolist():
                at = np.flatnonzero(cells == cell)
                if asked is None:
                    who = everyone
                elif isinstance(asked, dict):
                    who = asked.get(cell, everyone[:0])
                else:
                    who = np.flatnonzero(np.unpackbits(asked[cell], count=len(questions)))
                if not len(who):
                    continue
                v = vectors[at]
                margin = 1e-12 * np.outer(norms[who], np.sqrt((v * v).sum(1))) + 1e-300
                all_q, all_rows = hopeful(questions[who] @ v.T, heaps.least[who], margin, k)
                for first in range(0, len(all_q), PAIRS):
                    q, row = who[all_q[first : first + PAIRS]], all_rows[first : first + PAIRS]
                    score = in_order_at(questions, v, q, row)
                    good = score >= heaps.least[q]
                    if good.any():
                        heaps.add(_with_keys(q[good], score[good], own.take(pa.array(at[row[good]]))))
                if len(all_q):
                    if np.isinf(heaps.least[who]).any():
                        heaps.cut()
    found = heaps.cut()
    if found is not None:
        yield from found.combine_chunks().to_batches()


def _with_keys(q: np.ndarray, score: np.ndarray, rows: pa.Table) -> pa.Table:
    return pa.table([pa.array(q), pa.array(score), *rows.columns], names=["q", "score", *rows.column_names])


def best(rows: DataFrame, questions: np.ndarray, k: int, keys: list[str], id_col: str, vector_col: str = "embedding", asked: dict[int, np.ndarray] | np.ndarray | None = None) -> DataFrame:
    """(q, score, keys, rank from 0) of the ``k`` best rows of each question, ties to the smaller id.

    Rows whose vector is null, or of another length than the questions', have no score.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((questions, asked))
    fine = F.col(vector_col).isNotNull() & (F.size(vector_col) == questions.shape[1]) & ~F.exists(vector_col, lambda x: x.isNull())
    own = rows.where(fine).select(*keys, *(["cell"] if asked is not None and "cell" not in keys else []), F.col(vector_col).alias("_v"))
    kinds = dict(own.dtypes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scan(batches, shared.value[0], k, keys, id_col, shared.value[1])

    found = own.mapInArrow(task, "q bigint, score double, " + ", ".join(f"`{c}` {kinds[c]}" for c in keys))
    order = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last(id_col)))
    return found.withColumn("rank", order - 1).where(F.col("rank") < k)

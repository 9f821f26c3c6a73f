"""Approximate nearest neighbours with a hash-prefix forest.

Each tree gives every vector a string of sign bits of random projections and keeps the strings in sorted
arrays. A query descends to the longest prefixes it shares with others, then all trees ascend together,
one bit at a time, until the ranges under its prefixes hold ``wanted`` entries in all. Every entry of
these ranges is scored. ``wanted`` is fitted: for a bounded sample of queries the exact neighbours are
found by brute force over all vectors, and the least number is taken at which the ranges hold the share
``recall`` of them.

A sorted array is cut into leaves, prefixes of variable length with at most ``leaf_rows`` entries, and a
vector is dealt to its leaf in each tree; a query goes to the leaves under its prefixes and to no other.
How many entries a prefix has is counted once, up to ``ROUTE`` bits, so that the ascent is a look-up in
tables whose size is fixed by parameters. A prefix of that length that still holds more is dealt to
several leaves, and in these the descent goes on bit by bit, tree by tree. Leaves hold vectors as bytes,
so a score there is known within a margin; whatever may be among the best within its margin is scored
again with the original vectors in double precision.

Largest inner product becomes nearest angle by one more coordinate, sqrt(M² - |x|²) with M the largest
norm, which is 0 for queries. All is scaled by a power of two first, so magnitudes don't matter.

Equal vectors are one entry with its smallest ids, so a vector that is very common costs one row.
Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors meet
those of their own length only, one search for each length. Ties go to the smaller id. Rows with the
query's id count as the query's own; a query id that is repeated asks once, with its smallest vector. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stash

ROUTE = 14
#: Standard deviations of the rounding to bytes that a margin spans.
SIGMAS = 5.0
OUT = "query_id long, rank int, vec_id long, score double"


@dataclass(frozen=True)
class Hashes:
    """The strings of rows and of queries; ``exponent`` scales rows to components of at most 1, ``top`` is then the largest norm."""

    dims: int
    trees: int
    bits: int
    exponent: int
    top: float
    seed: int = 42

    def planes(self) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((self.dims + 1, self.trees * self.bits)).astype(np.float32)

    def _pack(self, signs: np.ndarray) -> np.ndarray:
        return signs.reshape(len(signs), self.trees, self.bits) @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))

    def rows(self, vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
        x = np.ldexp(vectors, -self.exponent) / self.top
        lift = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", x, x), 0.0))
        return self._pack(np.column_stack((x, lift)).astype(np.float32) @ planes > 0)

    def queries(self, vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
        return self._pack(unit(vectors).astype(np.float32) @ planes[:-1] > 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their magnitude."""
    x = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def as_bytes(vectors: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as signed bytes, and what one step of each stands for."""
    x = np.ldexp(vectors, -exponent)
    step = np.abs(x).max(axis=1) / 127
    return np.rint(x / np.where(step > 0, step, 1.0)[:, None]).astype(np.int8), step


@dataclass(frozen=True)
class Routes:
    """``before[t][p]``: how many entries of tree t have a prefix of ``depth`` bits below p; ``leaf[t][p]``: the leaf of prefix p; ``parts``: of a leaf with too many entries, into how many it is dealt."""

    bits: int
    depth: int
    before: np.ndarray
    leaf: np.ndarray
    parts: dict[tuple[int, int], int]

    @classmethod
    def of(cls, counts: np.ndarray, bits: int, leaf_rows: int) -> Routes:
        trees, width = counts.shape
        depth = width.bit_length() - 1
        before = np.zeros((trees, width + 1), np.int64)
        np.cumsum(counts, axis=1, out=before[:, 1:])
        first = np.zeros((trees, width), bool)  # where a leaf starts
        for t in range(trees):
            open_ = np.zeros(1, np.int64)
            for level in range(depth + 1):
                size = 1 << (depth - level)
                held = before[t, open_ + size] - before[t, open_]
                whole = (held <= leaf_rows) if level < depth else np.ones(len(open_), bool)
                first[t, open_[whole]] = True
                open_ = open_[~whole]
                open_ = np.concatenate((open_, open_ + size // 2))
        leaf = np.cumsum(first, axis=1).astype(np.int32) - 1
        heavy = np.argwhere(counts > leaf_rows)
        return cls(bits, depth, before, leaf, {(int(t), int(leaf[t, p])): -(-int(counts[t, p]) // leaf_rows) for t, p in heavy})

    def entries(self, strings: np.ndarray) -> np.ndarray:
        """(query, level): entries under the query's prefixes of each level, over all trees."""
        out = np.zeros((len(strings), self.depth + 1), np.int64)
        for t in range(strings.shape[1]):
            for level in range(self.depth + 1):
                low, high = self.range(strings[:, t], np.full(len(strings), level))
                out[:, level] += self.before[t, high] - self.before[t, low]
        return out

    def range(self, strings: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = strings >> (self.bits - levels) << (self.depth - levels)
        return low, low + (1 << (self.depth - levels))

    def levels(self, entries: np.ndarray, wanted: int) -> np.ndarray:
        """The longest prefixes with enough entries in all; the empty one where there are too few."""
        enough = entries >= wanted
        return np.where(enough.any(axis=1), self.depth - enough[:, ::-1].argmax(axis=1), 0)


def fit_wanted(routes: Routes, strings: np.ndarray, owner: np.ndarray, neighbours: np.ndarray, recall: float) -> int:
    """The least number of entries at which the share ``recall`` of the sample's exact neighbours lies under its prefixes.

    ``strings`` are those of the sample's queries; neighbour i, with strings ``neighbours[i]``, is one of query ``owner[i]``.
    """
    if not len(owner):
        return 1
    entries = routes.entries(strings)
    apart = strings[owner] ^ neighbours
    shared = routes.bits - np.ceil(np.log2(apart + 1.0)).astype(int).min(axis=1)  # the longest prefix in common in any tree

    def share(wanted: int) -> float:
        level = routes.levels(entries, wanted)
        # below the counted depth a level more halves what is left
        deeper = np.ceil(np.log2(np.maximum(entries[:, -1], 1) / wanted)).clip(0, routes.bits - routes.depth)
        level = np.where(level == routes.depth, level + deeper, level)
        return float((shared >= level[owner]).mean())

    low, high = 1, int(entries.max()) + 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if share(mid) >= recall else (mid + 1, high)
    return low


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1)


def _binaries(codes: np.ndarray) -> pa.Array:
    n, width = codes.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(codes))])


def _entries(table: DataFrame, k: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, v) that take part, and of each distinct vector its ids as far as they can be wanted."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = table.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).where((F.size(vector_col) > 0) & finite & F.exists(v, lambda x: x != 0))
    rows = stash(rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")), "vectors")
    # of an id at most k rows and of a vector at most k + 1 ids; the tasks drop the rest before the shuffle
    one = rows.withColumn("_n", F.row_number().over(W.partitionBy("v", "id").orderBy("id"))).where(F.col("_n") <= k)
    one = one.withColumn("_d", F.dense_rank().over(W.partitionBy("v").orderBy("id"))).where(F.col("_d") <= k + 1)
    return rows, one.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def nearest(
    table: DataFrame,
    every: int = 20,
    k: int = 20,
    trees: int = 40,
    bits: int = 30,
    recall: float = 0.93,
    sample: int = 256,
    leaf_rows: int = 16_384,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose id is divisible by ``every``."""
    rows, entries = _entries(table, k, id_col, vector_col)
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    entries = stash(entries.select(F.monotonically_increasing_id().alias("gid"), "v", "ids", F.size("v").alias("dims")), "entries")
    asked = stash(asked.join(entries.select("gid", "v", "dims"), "v").select(F.col("id").alias("query_id"), "gid", "dims"), "asked")
    facts = entries.groupBy("dims").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))).alias("most"))
    found = None
    for fact in facts.join(asked.select("dims").distinct(), "dims", "left_semi").orderBy("dims").collect():
        own = F.col("dims") == fact.dims
        part = _search(entries.where(own).drop("dims"), asked.where(own).select("query_id", "gid"), fact, k, trees, bits, recall, sample, leaf_rows)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else table.sparkSession.createDataFrame([], OUT)


def _search(entries: DataFrame, asked: DataFrame, fact, k: int, trees: int, bits: int, recall: float, sample: int, leaf_rows: int) -> DataFrame:
    exponent = math.frexp(fact.most)[1]
    half = exponent // 2  # two factors, since one might be out of range
    scaled = lambda x: x * F.lit(math.ldexp(1.0, -half)) * F.lit(math.ldexp(1.0, half - exponent))
    top = entries.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + scaled(x) * scaled(x))))).first()[0]
    hashes = Hashes(fact.dims, trees, bits, exponent, top or 1.0)
    depth = min(ROUTE, bits, math.ceil(math.log2(fact.n + 1)) + 2)
    routes = Routes.of(_counts(entries, hashes, depth), bits, leaf_rows)
    vectors = asked.select("gid").distinct().join(entries.select("gid", "v"), "gid")
    wanted = _fitted(entries, vectors, hashes, routes, k, recall, sample)
    fetch = k + 1  # the query itself may be one

    def query_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each leaf that a query goes to."""
        planes = hashes.planes()
        for batch in batches:
            gid, v = batch.column(0).to_numpy(), _matrix(batch.column(1))
            strings = hashes.queries(v, planes)
            held = routes.entries(strings)
            levels = routes.levels(held, wanted)
            # the descent goes on within leaves where the counted depth leaves more than is wanted
            deep = (levels == routes.depth) & (held[:, -1] > wanted)
            codes, step = as_bytes(unit(v), 0)
            at, keys, own = [], [], []
            for t in range(trees):
                ask = np.flatnonzero(levels > 0) if t else np.arange(len(gid))  # the empty prefix is all of one tree
                low, high = routes.range(strings[ask, t], levels[ask])
                first, last = routes.leaf[t, low], routes.leaf[t, high - 1]
                times = last - first + 1
                leaves = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                at.append(np.repeat(ask, times))
                keys.append(_key(t, leaves))
                own.append(strings[np.repeat(ask, times), t])
            at, keys, own = np.concatenate(at), np.concatenate(keys), np.concatenate(own)
            if routes.parts:
                parts = np.array([routes.parts.get((int(key >> 48), int(key >> 24 & 0xFFFFFF)), 1) for key in keys.tolist()], np.int64)
                salt = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                at, keys, own = np.repeat(at, parts), np.repeat(keys, parts) + salt, np.repeat(own, parts)
            level = np.where(deep, bits, levels)[at]
            for i in range(0, len(at), 20_000):
                cut = slice(i, i + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[cut]), pa.array(gid[at[cut]]), pa.array(own[cut]), pa.array(level[cut].astype(np.int32)), pa.array(step[at[cut]]), _binaries(codes[at[cut]])], names=["key", "query", "string", "level", "step", "code"])

    def row_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each tree that holds an entry."""
        planes = hashes.planes()
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                piece = batch.slice(i, 1000)
                gid, v = piece.column(0).to_numpy(), _matrix(piece.column(1))
                strings = hashes.rows(v, planes)
                codes, step = as_bytes(v, exponent)
                for t in range(trees):
                    leaf = routes.leaf[t, strings[:, t] >> (bits - routes.depth)]
                    salt = np.array([g % routes.parts.get((t, n), 1) for g, n in zip(gid.tolist(), leaf.tolist(), strict=True)], np.int64) if routes.parts else 0
                    yield pa.RecordBatch.from_arrays([pa.array(_key(t, leaf) + salt), pa.array(gid), pa.array(strings[:, t]), pa.array(step), _binaries(codes)], names=["key", "gid", "string", "step", "code"])

    queries = vectors.select("gid", "v").mapInArrow(query_batches, "key long, query long, string long, level int, step double, code binary")
    # a leaf that very many queries go to is read by them in parts; the table has a row for each leaf_rows queries at most
    crowded = queries.groupBy("key").agg(F.floor((F.count("*") - 1) / leaf_rows).cast("int").alias("more")).where("more > 0")
    crowded = stash(crowded, "crowded")
    dealt = entries.select("gid", "v").mapInArrow(row_batches, "key long, gid long, string long, step double, code binary")
    if not crowded.isEmpty():
        more = F.coalesce("more", F.lit(0))
        queries = queries.join(crowded, "key", "left").withColumn("part", F.pmod("query", more + 1).cast("int")).drop("more")
        dealt = dealt.join(crowded, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), more))).drop("more")
    else:
        queries, dealt = queries.withColumn("part", F.lit(0)), dealt.withColumn("part", F.lit(0))
    per_tree = -(-wanted // trees)

    def score(asked_: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if asked_.num_rows and held.num_rows:
            order = np.argsort(held["string"].to_numpy(), kind="stable")
            strings, gids, steps = (held[c].to_numpy()[order] for c in ("string", "gid", "step"))
            codes = _codes(held["code"].combine_chunks())[order].astype(np.float32)
            norms = steps * np.sqrt(np.einsum("ij,ij->i", codes, codes))
            ask, own, level, asked_steps = (asked_[c].to_numpy() for c in ("query", "string", "level", "step"))
            level = descend(strings, own, level.copy(), per_tree, bits, routes.depth)
            asking = _codes(asked_["code"].combine_chunks()).astype(np.float32)
            prefix = own >> (bits - level)
            for same in _same(level, prefix):
                shift = bits - int(level[same[0]])
                low, high = np.searchsorted(strings, [int(prefix[same[0]]) << shift, int(prefix[same[0]]) + 1 << shift])
                if low == high:
                    continue
                for i in range(0, len(same), 256):
                    few = same[i : i + 256]
                    here, of = steps[None, low:high], asked_steps[few][:, None]
                    about = (codes[low:high] @ asking[few].T).T * (here * of)
                    margin = SIGMAS / math.sqrt(12) * np.hypot(here, of * norms[None, low:high])
                    if high - low > fetch:
                        sure = np.partition(about - margin, high - low - fetch, axis=1)[:, high - low - fetch]
                        row, place = np.nonzero(about + margin >= sure[:, None])
                    else:
                        row, place = (x.ravel() for x in np.indices(about.shape))
                    out.append((ask[few[row]], gids[low + place], about[row, place], margin[row, place]))
        columns = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.int64, np.float64, np.float64))]
        return pa.table(dict(zip(("query", "gid", "about", "margin"), columns, strict=True)))

    found = queries.groupBy("key", "part").cogroup(dealt.groupBy("key", "part")).applyInArrow(score, "query long, gid long, about double, margin double")
    found = found.groupBy("query", "gid").agg(F.max("about").alias("about"), F.max("margin").alias("margin"))  # trees may find the same
    low, own = F.col("about") - F.col("margin"), W.partitionBy("query")
    found = found.withColumn("_n", F.row_number().over(own.orderBy(F.desc(low), "gid")))
    found = found.withColumn("_sure", F.max(F.when(F.col("_n") == fetch, low)).over(own))  # null where there are fewer
    found = found.where(F.col("_sure").isNull() | (F.col("about") + F.col("margin") >= F.col("_sure"))).select("query", "gid")
    found = found.unionByName(vectors.select(F.col("gid").alias("query"), "gid")).distinct()  # vectors equal to the query's
    return _answers(stash(found, "found"), entries, asked, k)


def _answers(found: DataFrame, entries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The ranked rows of each asked id, scored with the original vectors."""
    asking = entries.select(F.col("gid").alias("query"), F.col("v").alias("q"))
    pairs = found.join(asking, "query").join(entries, "gid")
    score = F.aggregate(F.zip_with("v", "q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    listed = pairs.select("query", score.alias("score"), F.explode("ids").alias("vec_id"))
    # of a query vector's list as much as is left when any one id, that of the asking row, is taken out
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("_r", F.row_number().over(best)).withColumn("_of", F.count("*").over(W.partitionBy("query", "vec_id")))
    listed = listed.withColumn("_most", F.max("_of").over(W.partitionBy("query"))).where(F.col("_r") <= k + F.col("_most")).drop("_r", "_of", "_most")
    rows = asked.withColumnRenamed("gid", "query").join(stash(listed, "listed"), "query").where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _key(tree: int, leaf: np.ndarray) -> np.ndarray:
    return (np.int64(tree) << 48) + (leaf.astype(np.int64) << 24)


def _same(level: np.ndarray, prefix: np.ndarray) -> list[np.ndarray]:
    """Places of queries that share their prefix."""
    order = np.lexsort((prefix, level))
    cut = np.flatnonzero((np.diff(level[order]) != 0) | (np.diff(prefix[order]) != 0)) + 1
    return np.split(order, cut)


def descend(strings: np.ndarray, own: np.ndarray, level: np.ndarray, per_tree: int, bits: int, depth: int) -> np.ndarray:
    """Levels with those of ``bits`` replaced: from the whole string up to the first prefix with ``per_tree`` entries here, not above ``depth``."""
    left = np.flatnonzero(level == bits) if depth < bits else np.zeros(0, int)
    for now in range(bits, depth, -1):
        if not len(left):
            break
        shift = bits - now
        low = own[left] >> shift << shift
        few = np.searchsorted(strings, low + (1 << shift)) - np.searchsorted(strings, low) < per_tree
        level[left[~few]] = now
        left = left[few]
    level[left] = depth
    return level


def _counts(entries: DataFrame, hashes: Hashes, depth: int) -> np.ndarray:
    """(tree, prefix of ``depth`` bits): entries; at most trees * 2^ROUTE numbers."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, n = hashes.planes(), np.zeros((hashes.trees, 1 << depth), np.int64)
        for batch in it:
            for i in range(0, batch.num_rows, 1000):
                strings = hashes.rows(_matrix(batch.column(0).slice(i, 1000)), planes) >> (hashes.bits - depth)
                np.add.at(n, (np.arange(hashes.trees)[None, :], strings), 1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n.ravel()[some])], names=["at", "n"])

    told = entries.select("v").mapInArrow(batches, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(hashes.trees << depth, np.int64)
    out[told["at"].to_numpy()] = told["n"].to_numpy()
    return out.reshape(hashes.trees, -1)


def _fitted(entries: DataFrame, vectors: DataFrame, hashes: Hashes, routes: Routes, k: int, recall: float, sample: int) -> int:
    """``wanted``, from the exact neighbours of at most ``sample`` queries among all entries."""
    drawn = vectors.orderBy(F.xxhash64("gid"), "gid").limit(sample).toArrow()
    own, asking = drawn["gid"].to_numpy(), _matrix(drawn["v"])
    q = unit(asking)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = hashes.planes()
        best: tuple | None = None  # of what this task saw: scores and strings, a row a query
        for batch in it:
            for i in range(0, batch.num_rows, 2000):
                piece = batch.slice(i, 2000)
                gid, v = piece.column(0).to_numpy(), _matrix(piece.column(1))
                s = q @ np.ldexp(v, -hashes.exponent).T
                s[own[:, None] == gid[None, :]] = -np.inf
                strings = np.broadcast_to(hashes.rows(v, planes), (len(q), len(gid), hashes.trees))
                if best is not None:
                    s, strings = np.concatenate((best[0], s), axis=1), np.concatenate((best[1], strings), axis=1)
                n = min(k, s.shape[1])
                to = np.argpartition(s, s.shape[1] - n, axis=1)[:, -n:]
                best = np.take_along_axis(s, to, 1), np.take_along_axis(strings, to[:, :, None], 1)
        if best is not None:
            for i, (s, strings) in enumerate(zip(*best, strict=True)):
                kept = np.flatnonzero(s > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), i)), pa.array(s[kept]), pa.array(list(strings[kept]), pa.list_(pa.int64()))], names=["i", "score", "strings"])

    seen = entries.select("gid", "v").mapInArrow(batches, "i long, score double, strings array<long>")
    rank = F.row_number().over(W.partitionBy("i").orderBy(F.desc("score")))
    exact = seen.withColumn("_n", rank).where(F.col("_n") <= k).select("i", "strings").toArrow()  # at most sample * k rows
    if not exact.num_rows:
        return 1
    strings = hashes.queries(asking, hashes.planes())
    return fit_wanted(routes, strings, exact["i"].to_numpy(), _matrix(exact["strings"]).astype(np.int64), recall)

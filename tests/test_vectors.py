"""Blocks of questions and rows, slices of questions, and the stored vector index, against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import rank, topk
from corpusloom.operators.vector_index import VectorIndex

SCHEMA = "tenant string, vector_id bigint, text string, embedding array<float>"


def made(n=700, dims=16, seed=1, clusters=0):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dims))
    if clusters:
        v = rng.standard_normal((clusters, dims))[rng.integers(0, clusters, n)] + 0.15 * v
    v[n // 2 : n // 2 + 60] = v[0]  # many equal rows
    v = (v / np.sqrt((v * v).sum(1))[:, None]).astype(np.float32)
    return [(f"t{i % 3}", i, f"text {i}", [float(x) for x in v[i]]) for i in range(n)]


def brute(rows, asked, k):
    v = np.array([r[3] for r in rows], np.float64)
    out = {}
    for q, vec in asked:
        s = topk.in_order(np.repeat(np.array([vec], np.float64), len(v), 0), v)
        order = np.lexsort((np.array([r[1] for r in rows]), -s))[:k]
        out[q] = [(rows[i][1], s[i]) for i in order]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.dense_rank)):
        out.setdefault(r.query_id, []).append((r.vector_id, r.dense))
    return out


def questions(spark, rows, every=20):
    asked = [(r[1], r[3]) for r in rows if r[1] % every == 0]
    return asked, spark.createDataFrame(asked, "query_id bigint, query_vec array<double>")


def test_blocks_equal_plain_products_in_every_bit(spark, monkeypatch):
    rows = made()
    asked, q = questions(spark, rows)
    chunks = spark.createDataFrame(rows, SCHEMA).repartition(5)
    monkeypatch.setattr(topk, "PRODUCTS", 2000)
    assert by_query(rank.nearest_ids(chunks, q, 9)) == brute(rows, asked, 9)
    whole = rank.dense_topk(chunks, q, 9)
    assert by_query(whole) == brute(rows, asked, 9)
    assert all(r.text == f"text {r.vector_id}" for r in whole.collect())


def test_scan_stage_gives_no_row_a_pair():
    import pyarrow as pa

    rows = made(600)
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows]), pa.array([r[3] for r in rows], pa.list_(pa.float32()))], names=["vector_id", "_v"])
    asked = np.array([r[3] for r in rows[:40]], np.float64)
    out = list(topk.scan(iter([batch] * 3), asked, 7, ["vector_id"], "vector_id"))
    assert sum(b.num_rows for b in out) == 40 * 7


def test_slices_end_on_equal_questions(spark, monkeypatch):
    monkeypatch.setattr(rank, "MOST_QUERIES", 4)
    rows = made(100)
    chunks = spark.createDataFrame(rows, SCHEMA)
    q = spark.createDataFrame([(5, rows[5][3])] * 11 + [(None, rows[6][3])], "query_id bigint, query_vec array<double>").repartition(3)
    parts = rank._slices(q)
    assert sorted(p.count() for p in parts) == [4, 4, 4]
    found = rank.nearest_ids(chunks, q, 2).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in found} == {5: 22, None: 2}


def test_odd_vectors_have_no_score(spark):
    rows = [("a", 1, "x", [1.0, 0.0]), ("a", 2, "x", None), ("a", 3, "x", [1.0]), ("a", 4, "x", [None, 1.0]), ("a", None, "x", [1.0, 0.0]), ("a", 0, "x", [0.5, 0.0])]
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [2.0])], "query_id bigint, query_vec array<double>")
    got = by_query(rank.nearest_ids(spark.createDataFrame(rows, SCHEMA), q, 5))
    assert got == {1: [(1, 1.0), (None, 1.0), (0, 0.5)], 3: [(3, 2.0)]}
    empty = spark.createDataFrame([], SCHEMA)
    assert rank.dense_topk(empty, q, 3).count() == 0
    assert rank.nearest_ids(spark.createDataFrame(rows, SCHEMA), q.where("false"), 3).count() == 0


@pytest.mark.parametrize("clusters", [0, 12])
def test_index_is_exact_by_bounds_and_near_by_probes(spark, tmp_path, clusters):
    rows = made(900, seed=3, clusters=clusters)
    asked, q = questions(spark, rows, 50)
    index = VectorIndex.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "index"), cells=24)
    want = brute(rows, asked, 10)
    assert by_query(index.search(q, 10)) == want
    assert sorted(r[0] for r in index.rows().select("vector_id").collect()) == list(range(900))
    probe = index.fitted_probe(10, 0.92)
    got = by_query(index.search(q, 10, probe))
    # equal rows are as good as each other: a neighbour counts if its score is reached
    hits = sum(sum(s >= want[i][-1][1] for _, s in got[i]) for i, _ in asked)
    assert hits / sum(len(x) for x in want.values()) >= 0.9
    if clusters:
        assert probe <= 6
        read, every = index.share_read(q.where("query_id = 50"), 1)
        assert read < every / 4
    again = VectorIndex.open(spark, str(tmp_path / "index"))
    assert by_query(again.fetch(again.search(q, 10), len(asked), 10)) == want


def test_bounds_hold(spark, tmp_path):
    rows = made(300, seed=4)
    index = VectorIndex.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "index"), cells=10)
    v = np.array([r[3] for r in rows], np.float64)
    cell = {r.vector_id: r.cell for r in index.rows().select("vector_id", "cell").collect()}
    bounds = index.bounds(v[:20])
    for i in range(300):
        assert (v[:20] @ v[i] <= bounds[:, cell[i]] + 1e-9).all()


def test_cells_are_pruned_before_the_scan(spark, tmp_path):
    rows = made(400, seed=5)
    index = VectorIndex.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "index"), cells=16)
    plan = index.rows([1, 3]).where(F.col("vector_id") > 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_empty_store(spark, tmp_path):
    index = VectorIndex.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "index"))
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, query_vec array<double>")
    assert index.search(q, 3).count() == 0 and index.search(q, 3, 2).count() == 0


def test_ann_query_recall_on_the_tables(spark):
    from corpusloom import catalog

    sf = "/root/testdata/sf0.01"
    got = by_query(catalog.QUERIES["ann_topk"](spark, sf))
    rows = [(r.tenant, r.vector_id, r.text, r.embedding) for r in catalog.fx.vectors(spark, sf).collect()]
    asked = [(r.query_id, r.query_vec) for r in catalog.asking(spark, sf).collect()]
    want = brute(rows, asked, 10)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q, _ in asked)
    assert hits >= 0.9 * sum(len(x) for x in want.values())


def test_a_block_without_best_rows_yet_is_bounded_in_memory():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    v, asked = rng.standard_normal((2000, 32)), rng.standard_normal((2000, 32))
    v[500:900] = v[500]  # equal scores
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2000)[::-1].copy()), pa.array(list(v), pa.list_(pa.float64()))], names=["vector_id", "_v"])
    tracemalloc.start()
    got = pa.Table.from_batches(topk.scan(iter([batch]), asked, 9, ["vector_id"], "vector_id"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300_000_000
    for q in (0, 7, 1999):
        score = topk.in_order(np.repeat(asked[q : q + 1], 2000, 0), v)
        best = np.lexsort((np.arange(2000)[::-1], -score))[:9]
        own = got.filter(pa.array(got["q"].to_numpy() == q))
        assert own["vector_id"].to_pylist() == [1999 - int(i) for i in best] and own["score"].to_pylist() == score[best].tolist()


def test_cells_asked_as_bits_equal_cells_asked_by_lists():
    import pyarrow as pa

    rows = made(600)
    cell = np.arange(600, dtype=np.int32) % 5
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows]), pa.array(cell), pa.array([r[3] for r in rows], pa.list_(pa.float32()))], names=["vector_id", "cell", "_v"])
    asked = np.array([r[3] for r in rows[:43]], np.float64)
    looks = np.random.default_rng(2).random((43, 5)) < 0.4
    told = [{c: np.flatnonzero(looks[:, c]) for c in range(5)}, np.packbits(looks.T, axis=1)]
    a, b = (pa.Table.from_batches(topk.scan(iter([batch]), asked, 7, ["vector_id"], "vector_id", t)) for t in told)
    assert a.equals(b) and a.num_rows > 200

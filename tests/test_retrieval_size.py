"""What retrieval writes and carries on the way, and that leaving out what packing can't reach changes no context."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import expand, rank, topk
from corpusloom.operators.vector_index import VectorIndex
from corpusloom.plans.config import RetrievalConfig
from corpusloom.plans.questions import question_rows
from corpusloom.plans.retrieval import retrieve
from corpusloom.sources import shared

CHUNKS = "tenant string, doc_name string, chunk_index bigint, vector_id bigint, text string, section_path_str string, page_number bigint, embedding array<float>"


def made(n, length, seed=1, sections=2):
    rng, vec = random.Random(seed), np.random.default_rng(seed)
    text = lambda: "".join(rng.choices("abcdefghij ", k=length))
    return [("t", f"doc_{i % 2}", i, i, text(), f"section {i % sections}", 1 + i // 9, [float(x) for x in vec.standard_normal(8)]) for i in range(n)]


def size_of(paths):
    return sum(os.path.getsize(f"{d}/{f}") for p in paths for d, _, names in os.walk(p.split("://")[-1]) for f in names)


def test_texts_of_the_pool_are_not_written(spark):
    rows = made(400, 4000)
    chunks = shared.stash(spark.createDataFrame(rows, CHUNKS), "own")
    asked = [(i, f"what is the section {i % 2} of the machine", [float(x) for x in rows[i][-1]]) for i in range(40)]
    own, since = size_of(shared._WRITTEN[-1:]), shared.mark()
    found = retrieve(chunks, asked, RetrievalConfig(min_hybrid_rerank_score=0.0))
    assert {r.query_id for r in found.context.collect()} == set(range(40))
    # 40 questions have 8640 rows in their pools, and 100 chunks in each of their sections
    assert size_of(shared._WRITTEN[since:]) < own


def ranked_of(spark, rows, seeds):
    seeds = [(q, at + 1, 0.5, *rows[i][:7]) for q, ids in seeds.items() for at, i in enumerate(ids)]
    ranked = spark.createDataFrame(seeds, "query_id bigint, rank int, score double, " + CHUNKS.rsplit(",", 1)[0])
    return expand.chunk_neighbours(ranked, ranked, 0, 0)


@pytest.mark.parametrize("budget, most, length", [(100, 0, 30), (700, 0, 500), (700, 3, 120), (5, 0, 9), (2000, 2, 300), (0, 0, 30)])
def test_contexts_of_what_is_in_reach_equal_those_of_all(spark, budget, most, length):
    rng, rows = random.Random(budget + most), []
    for i in range(240):
        n = rng.choice([0, 1, 3, length, rng.randrange(1, 2 * length)])
        text = rng.choice(["", " " * (budget + 9)]) + "".join(rng.choices("ab c", k=n))
        rows.append((rng.choice(["t", "u"]), f"doc_{i % 2}", rng.choice([None, rng.randrange(60)]), i, text, rng.choice(["one", "two", "three", ""]), rng.choice([None, 1, 2, 3]), [0.0]))
    rows += rng.sample(rows, 20)  # repeated rows
    seeds = {}
    for q in range(12):
        doc = rng.choice([(t, d) for t in "tu" for d in ("doc_0", "doc_1")])
        own = sorted({r[3] for r in rows if (r[0], r[1]) == doc})
        seeds[q] = rng.sample(own, 2)
    ranked, chunks = ranked_of(spark, rows, seeds), spark.createDataFrame(rows, CHUNKS).drop("embedding")
    told = lambda packed: sorted(tuple(r) for r in packed.collect())
    for pack, mixed in ((expand.pack_top_document, False), (expand.pack_mixed, True)):
        every = expand.section_mates(ranked, chunks)
        near = expand.section_mates(ranked, chunks, expand.within_budget(budget, most, mixed), few=True)
        whole = lambda rows: told(expand.never_empty(pack(rows, budget, most), rows, budget))
        assert whole(near) == whole(every)


def test_rows_in_reach_do_not_grow_with_the_section(spark):
    def count(n):
        rows = made(n, 40, sections=1)
        ranked = ranked_of(spark, rows, {q: [q] for q in range(10)})
        return expand.section_mates(ranked, spark.createDataFrame(rows, CHUNKS).drop("embedding"), expand.within_budget(100)).count()

    assert count(400) == count(1200) < 10 * 5


def test_neighbours_and_an_index_without_tenants(spark, tmp_path):
    rows = [r[1:] for r in made(300, 200, seed=4)]
    chunks = spark.createDataFrame(rows, CHUNKS.split(", ", 1)[1])
    asked = [(i, f"explain section {i % 2} abc", [float(x) for x in rows[i * 7][-1]]) for i in range(6)]
    config = RetrievalConfig(min_hybrid_rerank_score=0.0, top_doc_chunk_neighbors_before=1, top_doc_chunk_neighbors_after=2)
    told = lambda found: sorted((r.query_id, r.position, r.vector_id, r.text) for r in found.context.collect())
    found = retrieve(chunks, asked, config)
    want = told(found)
    assert {w[0] for w in want} == set(range(6))
    packed = expand.never_empty(expand.pack_top_document(found.rows, 3700), found.rows, 3700)
    assert sorted((r.query_id, r.position, r.vector_id, r.text) for r in packed.collect()) == want
    index = VectorIndex.build(chunks, str(tmp_path / "index"))
    assert told(retrieve(chunks, asked, config, index=index)) == want
    assert found.reranked.where(F.col("text").isNull()).count() == 0 and "_section" not in found.reranked.columns


def test_pairs_too_many_to_broadcast_and_chunks_with_many_questions(spark, monkeypatch):
    rows = made(90, 300, seed=6)
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = [(i, f"what is the section {i % 3} of abc ab", [float(x) for x in rows[i][-1]]) for i in range(12)]
    config = RetrievalConfig(min_hybrid_rerank_score=0.0, retrieval_pool_k=40, mmr_k=10)
    told = lambda found: sorted((r.query_id, r.rank, r.vector_id, r.text, r.bm25, r.fused, r.score) for r in found.reranked.collect())
    want = told(retrieve(chunks, asked, config))
    assert {w[0] for w in want} == set(range(12))
    monkeypatch.setattr(rank, "MOST_FETCHED", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert told(retrieve(chunks, asked, config)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # each chunk stands in many pools: what is measured once for all of them is what each has for itself
    q = question_rows(spark, asked)
    pairs = chunks.drop("embedding").crossJoin(q.select("query_id"))
    listed = chunks.drop("embedding").crossJoin(q.agg(F.collect_list(F.struct("query_id")).alias("_asks")))
    seen = lambda df: sorted((r.query_id, r.vector_id, r._c.dl, tuple(r._c.tf), r._section, r._factor) for r in df.collect())
    assert seen(rank.measured(pairs, q)) == seen(rank.measured(listed, q)) != []


def test_the_dense_stage_has_no_more_tasks_than_cores(spark, monkeypatch):
    rows = made(120, 5, seed=8)
    chunks, tasks, best = spark.createDataFrame(rows, CHUNKS), [], topk.best
    asked = spark.createDataFrame([(i, [float(x) for x in rows[i][-1]]) for i in range(4)], "query_id bigint, query_vec array<double>")
    monkeypatch.setattr(topk, "best", lambda own, *a, **b: tasks.append(own.rdd.getNumPartitions()) or best(own, *a, **b))
    got = sorted((r.query_id, r.dense_rank, r.vector_id) for r in rank.nearest_ids(chunks.repartition(40), asked, 3).collect())
    vectors = np.array([r[-1] for r in rows], np.float32).astype(float)
    asks = np.array([r.query_vec for r in asked.orderBy("query_id").collect()])
    assert got == [(q, at, int(i)) for q in range(4) for at, i in enumerate(np.argsort(-(vectors @ asks[q]), kind="stable")[:3])]
    assert tasks == [spark.sparkContext.defaultParallelism]

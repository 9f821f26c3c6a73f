"""Names that clash, ids with very many rows, long texts, and files that must stay."""

import re
import time

import corpus_pipeline
import pytest
from corpusloom.llm import mixing, secrets, sharding, toxicity
from pyspark.sql import functions as F

CLASHING = ("_id", "_text", "_n", "_hash", "_spans", "_doc", "id", "hash", "doc", "n", "spans", "others", "has_id", "clean", "text_hash", "c0", "_copy", "n_copies")


def test_stages_keep_columns_of_any_name(spark, sf, edge_docs):
    docs = edge_docs
    for name in CLASHING:
        docs = docs.withColumn(name, F.concat(F.lit(f"own {name} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, docs, sf)
        assert now.columns == docs.columns
        for r in now.collect():
            for c in CLASHING:
                assert r[c] == f"own {c} {'-' if r.doc_id is None else r.doc_id}", (name, c)


def test_unaffected_shards_keep_their_files(spark, docs, tmp_path):
    path = str(tmp_path / "out")
    placed = sharding.reshard(docs, 8, 10, 32)
    rows = placed.join(docs.withColumn("text_hash", F.xxhash64("text")), ["doc_id", "text_hash"]).select(*docs.columns, F.col("old_shard").alias("shard"))
    rows.write.partitionBy("shard").parquet(path)
    docs.limit(3).withColumn("shard", F.lit(77)).write.mode("append").partitionBy("shard").parquet(path)
    before = {p.name for p in (tmp_path / "out" / "shard=77").iterdir()}
    stored = spark.read.parquet(path).where("shard <> 77")
    sharding.rewrite_affected(stored, placed, path)
    assert {p.name for p in (tmp_path / "out" / "shard=77").iterdir()} == before
    back = {r.doc_id: r.shard for r in spark.read.parquet(path).where("shard <> 77").collect()}
    assert back == {r.doc_id: r.shard for r in placed.collect()}


def test_a_shard_that_loses_all_rows_is_deleted(spark, docs, tmp_path):
    path = str(tmp_path / "out")
    placed = sharding.reshard(docs, 10, 4, 32)
    rows = placed.join(docs.withColumn("text_hash", F.xxhash64("text")), ["doc_id", "text_hash"]).select(*docs.columns, F.col("old_shard").alias("shard"))
    rows.write.partitionBy("shard").parquet(path)
    sharding.rewrite_affected(spark.read.parquet(path), placed, path)
    left = spark.read.parquet(path)
    assert {r.shard for r in left.select("shard").distinct().collect()} == {0, 1, 2, 3}
    assert left.count() == docs.count()


@pytest.mark.parametrize("texts", [1, 3000])
def test_the_sample_bounds_rows(spark, monkeypatch, texts):
    rows = [(1, f"a text of words {i % texts}") for i in range(3000)] + [(i, f"other {i}") for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, toxic int")
    seen = []
    real = toxicity._gathered
    monkeypatch.setattr(toxicity, "_gathered", lambda rows, *a, **k: seen.append(rows.count()) or real(rows, *a, **k))
    toxicity.train(docs, labels, sample=10)
    assert seen == [10] or seen[0] <= 10


def test_what_passes_the_bound_of_words_does_not_depend_on_the_order(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(1 + i % 7))) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    models = [toxicity.train(spark.createDataFrame(r, "doc_id long, text string").repartition(k), labels, sample_words=90) for r, k in ((rows, 1), (rows[::-1], 5))]
    assert models[0].weights == models[1].weights and models[0].intercept == models[1].intercept


def plain_opaque(text):
    base = [(m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return [(m.start(), m.end()) for m in secrets.OPAQUE.finditer(text) if secrets.opaque(m[0]) and not any(a < m.end() and m.start() < b for a, b in base)]


def test_opaque_tokens_beside_base_spans(spark):
    text = " ".join(f"Ab1{'xYz9Qw8Rt7' * 2}{i} {'0123456789abcdef' * 2} q{'0f' * 13}Z{i}QwErTy9" for i in range(60))
    assert [(a, b) for k, a, b, _ in secrets.scan(text) if k == "opaque"] == plain_opaque(text)


def test_long_texts_take_time_in_proportion(spark):
    piece = "Ab1xYz9Qw8Rt7xYz9Qw8 " + "0123456789abcdef" * 2 + " token = abcdef123 "
    took = []
    for n in (4_000, 16_000):
        began = time.perf_counter()
        assert len(secrets.scan(piece * n)) == 3 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]
    (row,) = secrets.redact(spark.createDataFrame([(1, piece * 20_000, "a")], "doc_id long, text string, source string")).collect()
    assert row.text.count("<SECRET>") == 60_000 and "abcdef" not in row.text


def test_null_ids_with_many_texts_lie_in_many_shards(spark):
    rows = [(None, f"text number {i} of many words", "s") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, shard_words=500)
    assert mixed.count() == 2000
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert "_shard" in plan
    shards = docs.select(F.pmod(F.pmod(F.xxhash64("doc_id", "text", F.lit(42)), F.lit(mixing.PARTS)), F.lit(32)).alias("k")).groupBy("k").count()
    assert shards.count() == 32 and shards.agg(F.max("count")).first()[0] < 150

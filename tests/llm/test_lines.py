import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import lines
from corpusloom.llm.queries import queries

STRIP = " \t\n\x0b\x0c\r"


def key(line):
    return line.strip(STRIP).translate({c: c + 32 for c in range(65, 91)})


def brute(rows, least_docs=5, least_chars=40):
    """(id, text) rows to (id, n_lines, n_dropped, kept); None is smaller than any id."""
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, text in rows:
        ls = (text or "").split("\n")
        kept = [x for x in ls if len(key(x)) < least_chars or len(holders[key(x)]) < least_docs or max(holders[key(x)], key=lambda j: (j is not None, j or 0)) == i]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def run(df, **how):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in lines.drop_repeated(df, **how).collect()), key=repr)


def test_query_equals_brute_force(spark, sf, docs):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in queries()["op11_line_dedup"](spark, sf).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got == {i: (n, d, hashlib.sha256(kept.encode()).hexdigest()) for i, n, d, kept in want}


@pytest.mark.parametrize("joins", ["-1", "10485760"])
def test_batches_and_compaction_equal_brute_force(spark, joins):
    rng = random.Random(3)
    pool = [f"passage number {i} of the shared pool, " + "long " * 10 for i in range(60)]
    rows = []
    for i in range(240):
        some = [rng.choice(pool[: 1 + i % 60]) for _ in range(rng.randrange(6))]
        some = [x.upper() + "\t" if rng.random() < 0.2 else x for x in some] + ["short"] * rng.randrange(3)
        rows.append((rng.choice([None, i, i, i, i // 2]), "\n".join(some)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert run(df, batches=7, fanout=2) == run(df, batches=1) == brute(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_runs_are_not_shuffled_and_settled_keys_are_not_added_again(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = lines.LineRuns(spark, 3, fanout=3)
        batch = lambda ids: spark.createDataFrame([(k, k, i) for k in range(50) for i in ids], "k1 long, k2 long, id long")
        store.add(batch([9, 8, 7]))
        store.add(batch([6, 5]))
        sizes = [spark.table(name).count() for level in store.levels for name, _ in level]
        assert sorted(sizes) == [0, 50]
        assert {(r.k1, r.keeper) for r in store.settled().collect()} == {(k, 9) for k in range(50)}
        name = store.levels[0][0][0]
        plan = batch([1]).groupBy("k1", "k2").count().join(spark.table(name), ["k1", "k2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
        store.add(batch([4]))
        assert [len(level) for level in store.levels] == [0, 1]
        store.drop()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def test_edges(spark, edge_docs, no_docs):
    for name in ("id", "h", "t", "doc", "gone", "k1", "batch", "n_lines"):
        edge_docs = edge_docs.withColumn(name, F.lit("own"))
    got = lines.drop_repeated(edge_docs)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()), key=repr) == brute([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert {r.h for r in got.collect()} == {"own"}
    assert lines.drop_repeated(no_docs).count() == 0


def test_long_text_of_repeated_lines(spark):
    text = "\n".join(f"line {i % 700} that many documents of this test share" for i in range(20_000))
    rows = [(i, text) for i in range(6)]
    got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [(i, n, d) for i, n, d, _ in got] == [(i, 20_000, 20_000 if i < 5 else 0) for i in range(6)]

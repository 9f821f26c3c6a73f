"""BM25 from stored postings against plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from corpusloom.operators.postings import PostingsIndex

WORDS = ["pump", "valve", "the", "of", "x1", "seal", "motor", "rare", "heat"]


def made(n=300, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, [5, 4, 30, 25, 2, 3, 3, 0.2, 2], k=rng.randrange(0, 40)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 700, "RARE pump, pump!"), (-5, "rare"), (n + 701, "the " * 5000)]


def brute(rows, queries, k=None, k1=1.2, b=0.75):
    tokens = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in rows}
    dl = {i: max(1, len(t)) for i, t in tokens.items()}
    n, avg = len(rows), sum(dl.values()) / len(rows) + 1e-6
    df = Counter(t for ts in tokens.values() for t in set(ts))
    out = {}
    for q, terms in queries:
        scored = []
        for i, ts in tokens.items():
            tf = Counter(ts)
            s = sum(c * (k1 + 1) * math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] / (tf[t] + k1 * (1 - b + b * dl[i] / avg) + 1e-8) for t, c in Counter(terms).items() if tf[t])
            if s > 0:
                scored.append((-round(s, 9), i))
        out[q] = [(i, -s) for s, i in sorted(scored)][:k]
    return {q: v for q, v in out.items() if v}


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.id, round(r.bm25, 9)))
    return out


QUERIES = [(1, ["pump", "seal"]), (2, ["rare"]), (3, ["the", "the", "motor"]), (4, ["absent"]), (5, []), (6, ["heat", "x1", "rare", "of"])]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.createDataFrame(made(), "vector_id bigint, text string").repartition(4)
    return PostingsIndex.build(rows, str(tmp_path_factory.mktemp("postings") / "p"), buckets=8, segment=16)


def test_all_scores(spark, index):
    q = spark.createDataFrame(QUERIES, "query_id bigint, bm25_terms array<string>")
    assert got(index.search(q, None)) == brute(made(), QUERIES)


@pytest.mark.parametrize("first", [1, 3, None])
def test_best_are_exact_whatever_is_skipped(spark, index, first):
    q = spark.createDataFrame(QUERIES, "query_id bigint, bm25_terms array<string>")
    assert got(index.search(q, 5, first=first)) == brute(made(), QUERIES, 5)


def test_other_settings_than_built_for(spark, index):
    q = spark.createDataFrame(QUERIES, "query_id bigint, bm25_terms array<string>")
    assert got(index.search(q, 4, k1=0.9, b=0.2, first=2)) == brute(made(), QUERIES, 4, 0.9, 0.2)


def test_segments_below_the_kth_score_are_skipped(spark, index):
    q = spark.createDataFrame([(1, ["rare", "the"])], "query_id bigint, bm25_terms array<string>")
    read, every = index.segments_read(q, 1, first=1)
    assert read < every / 4


def test_only_folders_of_the_terms_are_read(spark, index):
    plan = index.rows(["pump"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,pump)" in plan
    assert index.rows(["pump"]).select("bucket").distinct().count() == 1


def test_reopened_and_empty(spark, index, tmp_path):
    q = spark.createDataFrame(QUERIES, "query_id bigint, bm25_terms array<string>")
    assert got(PostingsIndex.open(spark, index.path).search(q, 5)) == brute(made(), QUERIES, 5)
    empty = PostingsIndex.build(spark.createDataFrame([], "vector_id bigint, text string"), str(tmp_path / "p"))
    assert empty.search(q, 5).count() == 0 and empty.search(q, None).count() == 0

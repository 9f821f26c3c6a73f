"""Hybrid search over the whole corpus against a full ranking in plain Python, many questions in small slices."""

import math
import random
import re
from collections import Counter

from corpusloom.operators import rank


def test_hybrid_equals_full_ranking(spark, monkeypatch):
    rng = random.Random(4)
    words = ["pump", "seal", "the", "of", "valve", "rare"]
    rows = [(i, " ".join(rng.choices(words, [3, 2, 9, 9, 2, 0.3], k=rng.randrange(12))), [rng.choice([0.5, -0.5, 1.0]) for _ in range(4)]) for i in range(260)]
    asked = [(q, [rng.choice([1.0, -1.0, 0.25]) for _ in range(4)], rng.choice([["pump", "seal"], ["rare"], ["the", "the", "absent"], []])) for q in range(7)]
    chunks = spark.createDataFrame(rows, "vector_id bigint, text string, embedding array<double>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id bigint, query_vec array<double>, bm25_terms array<string>")
    monkeypatch.setattr(rank, "MOST_FETCHED", 3 * 2 * 68)
    assert len(rank._slices(queries, 3)) == 3
    got = {}
    for r in rank.hybrid_search(chunks, queries, 5).collect():
        got.setdefault(r.query_id, []).append((-r.rrf, r.vector_id, r.dense_rank, r.bm25_rank, round(r.bm25, 9)))
    tokens = {i: re.findall("[a-z0-9]+", t) for i, t, _ in rows}
    n, avg = len(rows), sum(max(1, len(t)) for t in tokens.values()) / len(rows) + 1e-6
    df = Counter(t for ts in tokens.values() for t in set(ts))
    for q, vec, terms in asked:
        dense = {i: sum(a * b for a, b in zip(v, vec)) for i, _, v in rows}
        bm25 = {}
        for i, ts in tokens.items():
            tf = Counter(ts)
            bm25[i] = sum(c * 2.2 * math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] / (tf[t] + 1.2 * (0.25 + 0.75 * max(1, len(ts)) / avg) + 1e-8) for t, c in sorted(Counter(terms).items()))
        place = lambda s: {i: r for r, i in enumerate(sorted(s, key=lambda i: (-s[i], i)))}
        d, b = place(dense), place({i: round(s, 12) for i, s in bm25.items()})
        best = sorted((-(1 / (58 + d[i]) + 1 / (58 + b[i])), i, d[i], b[i], round(bm25[i], 9)) for i in dense)[:5]
        assert sorted(got[q]) == best

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.llm import phrases


def pieces(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def brute_counts(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    return f, n


def brute(rows, least, top):
    f, n = brute_counts(rows)
    cand = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = []
    for (lang, p), a in cand.items():
        inside = any(la == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and b >= a for (la, q), b in cand.items())
        if not inside:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), left, right, n[lang]))
    ranked, at = [], Counter()
    for lang, s, a, p, left, right, total in sorted(out):
        at[lang] += 1
        if at[lang] <= top:
            ranked.append((lang, at[lang], p.decode(), -a, left, right, total, -s))
    return ranked


def made(n=400, seed=1):
    rng = random.Random(seed)
    words = ["the", "Of", "é", "naïve", "x\x00y", "a", "b", "b", "ß z", " "]
    phrase = ["new York city", "b b b b", "at the\tend of  the"]
    rows = []
    for i in range(n):
        parts = [rng.choice(phrase) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(30))]
        rows.append((rng.choice(["en", "en", None, "de"]), rng.choice([" ", "  ", ". ", "\n", " \t"]).join(parts) if i % 50 else None))
    return rows


def got(df, **how):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.mine(df, **how).collect())


def test_equals_brute_force(spark):
    rows = made()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    want = brute(rows, 20, 30)
    assert len(want) > 40
    assert got(df, least=20, top=30) == want
    # few counters, small shards and small automata let more through and change nothing
    assert got(df, least=20, top=30, most_bits=10, size=300, most_patterns=40) == want


def test_counts_are_exact(spark):
    rows = made(300, 2)
    found = {(r.lang, r.phrase): r.a for r in phrases.phrase_counts(spark.createDataFrame(rows, "lang string, text string"), 15).collect()}
    f, n = brute_counts(rows)
    assert found == {(lang, " ".join(p)): a for (lang, p), a in f.items() if a >= 15} | {(lang, ""): a for lang, a in n.items()}


def test_scores_pass_64_bits(spark):
    rows = [("en", "a", 1, 4 * 10**12), ("en", "b", 1, 5 * 10**12), ("en", "a b", 2, 3 * 10**12), ("en", "", 0, 9 * 10**13)]
    (row,) = phrases.collocations(spark.createDataFrame(rows, "lang string, phrase string, n_words int, a long")).collect()
    assert row.score == 1000 * (3 * 10**12) * (9 * 10**13) // (4 * 10**12 * 5 * 10**12)


def test_edges(spark, edge_docs, no_docs):
    df = edge_docs
    for name in ("phrase", "n", "a", "block", "n_words"):
        df = df.withColumn(name, F.lit("own"))
    rows = [(r.lang, r.text) for r in df.collect()]
    assert got(df, least=2, top=50) == brute(rows, 2, 50)
    assert phrases.mine(no_docs).count() == 0


def test_one_piece_longer_than_a_shard(spark):
    rows = [("en", "one two three " * 5000), ("en", "one two three. " * 5000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert got(df, size=1000, most_patterns=3) == brute(rows, 100, 2000)

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import langid, ppm, toxicity
from corpusloom.llm.queries import queries

SF = "/root/testdata/sf0.01"


def remainder(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


# -- toxicity


def test_toxicity_on_held_out_rows(spark):
    scored = {r.doc_id: r for r in queries()["op1_toxicity"](spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(scored) == set(docs)
    assert all(r.held_out == (remainder(i, 5) == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in scored.items())
    held = [i for i in labels if scored[i].held_out]
    assert sum(scored[i].predicted == labels[i] for i in held) / len(held) > 0.9
    assert not any(scored[i].predicted for i in held if not labels[i])


def test_counterfactual_swaps_terms_in_place():
    text = "Black cats. The women, and the Jews! nothing here"
    assert toxicity.counterfactual(text) == "white cats. The men, and the hindus! nothing here"


def sentences(n=400, seed=1):
    """Toxic sentences name one group more often than others do."""
    rng = np.random.default_rng(seed)
    filler = [f"word{i}" for i in range(60)]
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        words = list(rng.choice(filler, 12))
        if toxic and rng.random() < 0.9:
            words.append(str(rng.choice(["idiot", "scum"])))
        if rng.random() < (0.7 if toxic else 0.05):
            words.append("muslims")
        out.append((" ".join(words) + ".", float(toxic)))
    return out


def test_regularisation_frees_neutral_mentions():
    rows = []
    for text, y in sentences():
        words = toxicity.words_of(text)
        others = [toxicity.words_of(toxicity.counterfactual(text)), words - set(toxicity.SWAP)] if words & set(toxicity.SWAP) else []
        rows.append((np.array(toxicity.word_ids(words)), [np.array(toxicity.word_ids(x)) for x in others], y))
    free, held = toxicity.fit(rows, pull=0.0), toxicity.fit(rows, pull=20.0)
    here, there = "the muslims eat word1 word2", "the christians eat word1 word2"
    logit = lambda m, t: math.log(m.score(t) / (1 - m.score(t)))
    assert abs(logit(held, here) - logit(held, there)) < 0.3 * abs(logit(free, here) - logit(free, there))
    assert held.score("you idiot word1") > 0.5 > held.score(here)


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (None, 1), (99, 1), (8, 0)], "doc_id long, toxic int")
    rows = toxicity.classify(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.classify(no_docs, labels).count() == 0
    assert {r.score for r in toxicity.classify(edge_docs, labels.limit(0)).collect()} == {0.0}


def test_long_training_texts_count_whole(spark):
    """A word that tells, in texts of 5,000 distinct words; and rows past the bound on words are left out whole."""
    rows = [(i, " ".join(f"w{i}x{k}".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(5000)) + (" vile" if i % 2 else " kind"), i % 2) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.score("vile") > 0.5 > model.score("kind")
    assert len(toxicity.train(docs, labels, sample_words=4_000).weights) == 0
    assert toxicity.train(docs, labels, sample_words=4_000).fitted is False


def test_scores_equal_the_formula(spark, sf, docs):
    """The whole query against the fitted weights, applied in plain Python."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    learned = [r for r in labels.collect() if r.doc_id is not None and remainder(r.doc_id, 5) != 0]
    model = toxicity.train(docs, spark.createDataFrame(learned, labels.schema))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries()["op1_toxicity"](spark, sf).collect():
        words = set(re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower()))
        z = model.intercept + math.fsum(model.weights.get(i, 0.0) for i in toxicity.word_ids(words))
        assert r.score == 1 / (1 + math.exp(-z)) and r.predicted == (r.score >= 0.5)


# -- language


def test_predictions_equal_the_kernel(spark, sf, docs):
    """The whole query against one-versus-rest scores worked out row by row from the fitted weights."""
    model = langid.train(docs.where(langid.crc_mod("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries()["op8_language_id"](spark, sf).collect():
        places = langid.presence(texts[r.doc_id])
        f = model.weights[places].astype(float).sum(axis=0) / math.sqrt(max(1, len(places)))
        if not len(places):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            best = f.max()
            assert f[model.languages.index(r.lang_pred)] > best - 1e-4 and abs(r.score - min(1, max(0, (best + 1) / 2))) < 1e-4


def test_every_language_is_learned(spark):
    """More languages than the sample has rows, each with a word of its own."""
    name = lambda i: "q" + "".join(chr(97 + int(d)) * 2 for d in str(i))
    rows = [(i, f"{name(i % 450)} {name(i % 450)}", f"l{i % 450}") for i in range(900)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=100, landmarks=450)
    assert len(model.languages) == 450


def test_a_repeated_id_teaches_each_text_its_own_language(spark):
    rows = [(1, "the house and the dog", "en"), (1, "le chien dans la maison", "fr"), (1, "le chien dans la maison", "fr"), (2, "a dog of the house", "en"), (3, "la maison et le chien", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.text: r.lang_pred for r in langid.identify(df, langid.train(df)).collect()}
    assert got == {t: lang for _, t, lang in rows}


def test_language_on_held_out_rows(spark):
    rows = queries()["op8_language_id"](spark, SF).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(langs) and all(r.held_out == (remainder(r.doc_id, 4) == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.97


def test_kernel_regression_equals_the_dual_form():
    """With every sample a landmark, the Nyström fit is kernel ridge regression."""
    texts = ["the cat and the dog", "a dog of the house", "the house on a hill", "le chat et le chien", "un chien dans la maison", "la maison et le jardin"]
    langs = ["en"] * 3 + ["fr"] * 3
    sets = [langid.presence(t) for t in texts]
    x = langid.matrix(sets).astype(float)
    y = np.array([[1.0, -1.0]] * 3 + [[-1.0, 1.0]] * 3)
    ridge = 1e-2
    dual = np.linalg.solve(x @ x.T + ridge * 6 / 2 * np.eye(6), y)
    model = langid.fit(sets, langs, landmarks=6, ridge=ridge)
    probe = langid.matrix([langid.presence(t) for t in ("the dog and a hill", "le jardin et la maison")])
    assert np.allclose(probe @ model.weights, probe @ (x.T @ dual), atol=1e-3)


def test_presence_is_that_of_ngrams_in_pieces():
    text = "Abc déf " * 200_000
    assert np.array_equal(langid.presence(text), langid.presence("Abc déf Abc déf"))
    assert not len(langid.presence("123 !? _ ²")) and not len(langid.presence(None))


def test_language_edges(edge_docs, no_docs):
    rows = langid.classify(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4)} == {"und"}
    assert {r.lang_pred for r in rows} <= {"en", "la", "fr", "und"} and all(0 <= r.score <= 1 for r in rows)
    assert langid.classify(no_docs).count() == 0


# -- PPM


def brute_ppm(train, texts, depth=6):
    """Symbol by symbol over whole texts, white space as any other, with dictionaries."""
    tables = [defaultdict(Counter) for _ in range(depth + 1)]

    def coded(t):
        s = ["pad"] * (depth - 1) + ["start", *t, "end"]
        return [(s[j - depth : j], s[j]) for j in range(depth, len(s))]

    for t in train:
        for before, x in coded(t):
            for order in range(depth + 1):
                tables[order][tuple(before[depth - order :])][x] += 1

    def length(before, x):
        total, excluded = 0.0, set()
        for order in range(depth, -1, -1):
            seen = {k: v for k, v in tables[order].get(tuple(before[depth - order :]), {}).items() if k not in excluded}
            if not seen:
                continue
            whole = sum(seen.values()) + (len(seen) if len(seen) + len(excluded) < 257 else 0)
            if x in seen:
                return total + math.log10(seen[x] / whole)
            total += math.log10(len(seen) / whole)
            excluded |= set(seen)
        return total - math.log10(257 - len(excluded))

    return [sum(length(*g) for g in coded(t)) for t in texts]


def check_scores(rows, docs):
    low = [(i, (t or "").encode().lower()) for i, t in docs]
    train = [t for i, t in low if remainder(i, 7) != 2]
    counts = Counter(w for t in train for w in [*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for (i, t), score in zip(low, brute_ppm(train, [t for _, t in low]), strict=True):
        tokens = [*t.split(), None]
        want.append((str(i), remainder(i, 7) == 2, len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), score))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-6)


def test_ppm_query_equals_brute_force(spark, sf, docs):
    some = [(r.doc_id, r.text) for r in docs.collect()]
    check_scores(queries()["op9_ppm_scoring"](spark, sf).collect(), some)


def test_ppm_edges(spark, edge_docs, no_docs):
    short = edge_docs.where("doc_id is null or doc_id <> 5")
    check_scores(ppm.score(short).collect(), [(r.doc_id, r.text) for r in short.collect()])
    assert ppm.score(edge_docs).count() == edge_docs.count()
    assert ppm.score(no_docs).count() == 0
    empty = ppm.score(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string"))
    check_scores(empty.collect(), [(1, ""), (2, None)])
    # a table without training rows: "ab c" and its end
    held = next(i for i in range(100) if remainder(i, 7) == 2)
    rows = ppm.score(spark.createDataFrame([(held, "ab c")], "doc_id long, text string")).collect()
    assert rows[0].score == pytest.approx(-5 * math.log10(257)) and rows[0].n_known == 0 and rows[0].train_tokens == 0


def test_probabilities_of_a_context_sum_to_one():
    """All symbols in a context, seen or not."""
    rng = np.random.default_rng(0)
    words = [bytes(rng.choice(list(b"abc"), rng.integers(0, 7)).tolist()) for _ in range(300)]
    data = np.frombuffer(b"".join(words), np.uint8)
    codes, counts = np.unique(ppm.grams_of(data, np.array(list(map(len, words))), np.zeros(len(words), np.int64)), return_counts=True)
    grams3, to = np.unique(codes & ((1 << 27) - 1), return_inverse=True)
    low = ppm.LowOrders(grams3, np.bincount(to, weights=counts))
    groups = (codes >> 9) & ((1 << 27) - 1)
    for g in np.unique(groups):
        mine, n = codes[groups == g], counts[groups == g]
        for context in (mine[0] >> 9, int(g)):  # one that was seen, and its last three symbols behind others
            every = (int(context) << 9) | np.array([*range(256), ppm.END])
            grams = np.union1d(mine, every)
            full = np.zeros(len(grams))
            full[np.searchsorted(grams, mine)] = n
            lengths = ppm.code_lengths(grams, full, low)
            assert np.isclose((10 ** lengths[np.searchsorted(grams, every)]).sum(), 1)


def test_contexts_cross_white_space(spark):
    """What follows a word depends on the word before it: texts of equal words in another order cost more."""
    rows = [(i, "red fox. blue hen. ") for i in range(40)] + [(100 + i, t) for i in range(40) for t in ("red fox. blue hen. ", "red hen. blue fox. ")]
    held = [r for r in rows if r[0] >= 100 and remainder(r[0], 7) == 2]
    train = [r for r in rows if r[0] < 100]
    got: dict = {}
    for r in ppm.score(spark.createDataFrame(train + [(*r,) for r in held], "doc_id long, text string")).collect():
        if r.doc_id >= 100:
            got.setdefault((r.doc_id, round(r.base_score, 6)), []).append(r.score)
    assert got and all(len(s) == 2 and max(s) - min(s) > 1 for s in got.values())


def test_blocks_are_cut_anywhere(monkeypatch):
    texts = [b"", b"a b", b"c" * 3 + b" de f" * 40, b"", b"x y", b"z" * 17]
    whole = ppm.grams_of(np.frombuffer(b"".join(texts), np.uint8), np.array(list(map(len, texts))), np.zeros(len(texts), np.int64))
    of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    for block in (1, 2, 7, 16, 17, 203, 1000):
        monkeypatch.setattr(ppm, "BLOCK", block)
        found = list(ppm.blocks(texts))
        assert np.array_equal(np.concatenate([c for c, _ in found]), whole) and np.array_equal(np.concatenate([i for _, i in found]), of)


def test_a_chunk_works_out_its_grams_once_for_its_sums(monkeypatch):
    texts = [b"", b"abcabc", b"\xff\x00 ab" * 30]
    names = np.unique(np.concatenate([codes for codes, _ in ppm.blocks(texts)]))
    lengths, done, whole = np.log10(1 / (2 + np.arange(len(names)))), [], ppm.grams_of
    monkeypatch.setattr(ppm, "grams_of", lambda data, n, kinds: done.append(len(data) + len(n)) or whole(data, n, kinds))
    got = ppm._gram_sums(texts, names, lengths)
    assert sum(done) == sum(len(t) + 1 for t in texts)
    monkeypatch.undo()
    for text, total in zip(texts, got.tolist(), strict=True):
        own = np.concatenate([codes for codes, _ in ppm.blocks([text])])
        assert abs(total - lengths[np.searchsorted(names, own)].sum()) < 1e-9


def test_counts_of_many_parts_are_moved_a_few_times_only(monkeypatch):
    moved, both = [], ppm.Tally._both
    monkeypatch.setattr(ppm.Tally, "_both", staticmethod(lambda *parts: moved.append(sum(len(x[0]) for x in parts)) or both(*parts)))
    tally, rng, counts = ppm.Tally(), np.random.default_rng(1), {}
    for _ in range(64):
        codes = np.unique(rng.integers(0, 1 << 40, 1000))
        tally.add(codes, np.ones(len(codes), np.int64))
        tally.add(codes[:3], np.array([5, 0, 2]))
        for code, n in [*zip(codes.tolist(), [1] * len(codes)), *zip(codes[:3].tolist(), [5, 0, 2])]:
            counts[code] = counts.get(code, 0) + n
    names, n = tally.whole()
    assert dict(zip(names.tolist(), n.tolist(), strict=True)) == counts and (np.diff(names) > 0).all()
    assert sum(moved) < 10 * 64 * 1000
    assert len(ppm.Tally().whole()[0]) == 0

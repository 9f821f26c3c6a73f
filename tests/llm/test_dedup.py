import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import fingerprints, simhash
from corpusloom.llm.queries import queries


def brute_fingerprint(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints, within=2):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= within:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_query_equals_brute_force(spark, sf, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op3_simhash_near_dedup"](spark, sf).collect()}
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    roots = brute_components(prints)
    assert got == {i: (f"{prints[i]:016x}", roots[i]) for i in prints}


@pytest.mark.parametrize("seed", [1, 2])
def test_links_connect_all_pairs_within_threshold(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    values = set(base.tolist())
    for x in base[:30].tolist():
        for _ in range(12):
            y = x
            for bit in rng.integers(0, 64, rng.integers(1, 4)).tolist():
                y ^= 1 << bit
            values.add(y)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    want = brute_components({v: v for v in values})
    groups = {}
    for v in values:
        groups.setdefault(roots.get(v, v), set()).add(v)
    expected = {}
    for v, r in want.items():
        expected.setdefault(r, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_every_fingerprint_is_covered(spark):
    rng = np.random.default_rng(5)
    values = [0, -1, 1, -(1 << 63), *(int(x) for x in rng.integers(-(2**63), 2**63, 50))]
    rows = simhash.anchors(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    by_fp = {}
    for r in rows:
        by_fp.setdefault(r.fp, set()).add(r.anchor)
        assert bin((r.fp ^ r.anchor) & simhash.LOW).count("1") <= 2
    for fp, anchors in by_fp.items():
        assert len(anchors) in (1, 32)
    assert set(by_fp) == set(values)


def test_chain_and_star_components(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)}


def test_edges(edge_docs, no_docs):
    rows = simhash.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(by_id[1]) == 2 and by_id[8][0].component_id == 1
    assert {by_id[i][0].fingerprint for i in (2, 3, 4)} == {"0" * 16} and by_id[4][0].component_id == 2
    assert simhash.near_duplicates(no_docs).count() == 0


def test_near_copies_are_linked_by_shingle_similarity(spark):
    """Groups of near copies, one too large for all pairs of a bucket at once, against brute force over all pairs."""
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(900)]
    passage = [f"p{i}" for i in range(30)]  # shared by all, but too short to make them near
    texts = []
    for size, copies, edits in ((120, 60, 2), (200, 12, 3), (90, 8, 1), (60, 5, 2)):
        base = list(rng.choice(vocabulary, size)) + passage
        for _ in range(copies):
            words = list(base)
            for at in rng.integers(0, size, rng.integers(0, edits + 1)).tolist():
                words[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(words))
    texts += ["one two three", "One  two\tthree", "one two four", "", None]
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert len({find(i) for i in range(85)}) < 20


def test_copies_near_their_original_only(spark):
    """Two halves of a bucket that only the last step joins: each copy is at 0.8 of the original and below that of the others."""
    base = [f"b{i}" for i in range(204)]
    texts = [" ".join(base)]
    for k in range(40):
        words = list(base)
        for e in range(4):
            words[5 * k + e * 6 if k < 36 else 150 + k + 6 * e - 20] = f"x{k}_{e}"
        texts.append(" ".join(words))
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(200)} for t in texts]
    assert all(len(s & sets[0]) >= 0.8 * len(s | sets[0]) for s in sets)
    assert sum(len(x & y) < 0.8 * len(x | y) for x in sets[1:] for y in sets[1:]) > 600
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


# -- op4


def test_edit_columns(spark, sf, docs):
    import hashlib

    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in queries()["op4_document_fingerprints"](spark, sf).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for i, r in enumerate(rows):
        following = rows[(i + 1) % len(rows)]
        q = len(r.text) // 4
        edited = r.text[: len(r.text) - q] + following.text[:q]
        mine = got[r.doc_id]
        assert mine.n_chars == len(r.text)
        assert mine.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (int(x, 16) for x in (mine.fingerprint, mine.edited_fingerprint, got[following.doc_id].fingerprint))
        assert mine.near_edited == 1 - bin(a ^ b).count("1") / 64 and mine.near_next == 1 - bin(a ^ c).count("1") / 64
        assert by_text.setdefault(r.text, mine.fingerprint) == mine.fingerprint
        near = sum(bin(a ^ int(x.fingerprint, 16)).count("1") <= 3 for x in got.values())
        assert mine.n_near == (near if r.doc_id % 50 == 0 else None)
    assert np.mean([r.near_edited for r in got.values()]) > 0.7 > 0.6 > np.mean([r.near_next for r in got.values()])


def test_the_smallest_text_of_a_repeated_next_id_counts(spark):
    first = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, first), (2, "zulu yankee xray whiskey victor uniform"), (2, "bravo charlie echo foxtrot golf hotel"), (3, "end of all")]
    got = fingerprints.compare_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    alone = fingerprints.compare_edits(spark.createDataFrame([r for r in rows if "zulu" not in r[1]], "doc_id long, text string")).collect()
    pick = lambda found: [(r.edited_sha256, r.near_next) for r in found if r.doc_id == 1]
    assert pick(got) == pick(alone) and len(got) == 4


def test_weighted_votes_by_hand(spark):
    """Votes recomputed one by one from the term rows."""
    df = spark.createDataFrame([(1, "Alpha beta of Gamma alpha"), (2, ""), (3, "one")], "doc_id long, t string")
    terms = fingerprints.term_rows(df, ["doc_id"], "t")
    got = {r.doc_id: r.fp for r in fingerprints.fingerprint_of(terms, ["doc_id"]).collect()}
    assert got[2] == 0
    rows = [r for r in terms.collect() if r.doc_id == 1 and not r.last]
    assert sorted(r.w for r in rows) == [2, 2, 2, 3, 3]
    want = 0
    for k in range(64):
        if 2 * sum(r.w for r in rows if r.h >> k & 1) > sum(r.w for r in rows):
            want |= 1 << k
    assert got[1] % (1 << 64) == want


def test_block_tables_find_all_within_radius(spark):
    rng = np.random.default_rng(3)
    values = set()
    for x in rng.integers(0, 2**64, 40, dtype=np.uint64).tolist():
        values.add(x)
        for _ in range(8):
            y = x
            for bit in rng.integers(0, 64, rng.integers(1, 6)).tolist():
                y ^= 1 << bit
            values.add(y)
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    queries_ = df.where(F.pmod("fp", F.lit(3)) == 0)
    asked = {r.fp % (1 << 64) for r in queries_.collect()}
    got = {(r.query % (1 << 64), r.fp % (1 << 64)) for r in fingerprints.within_radius(queries_, df).collect()}
    assert got == {(a, b) for a in asked for b in values if bin(a ^ b).count("1") <= 3}


def test_edit_edges(edge_docs, no_docs):
    rows = fingerprints.compare_edits(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert [r.n_chars for r in rows if r.doc_id == 2] == [0]
    assert len([r for r in rows if r.doc_id == 1]) == 2
    assert fingerprints.compare_edits(no_docs).count() == 0


def test_pairs_are_verified_on_packed_texts(spark):
    """Whole sets decide; what travels for a pair is less than its hashes, which can't be compressed."""
    rng = np.random.default_rng(3)
    words = [f"wort{i}" for i in range(300)]
    base = list(rng.choice(words, 900))
    texts = {1: " ".join(base), 2: " ".join([*base[:860], *rng.choice(words, 40)]), 3: " ".join([*base[:600], *rng.choice(words, 300)]), 4: "ÄÖ ü kurz"}
    packed = simhash.packed_texts(spark.createDataFrame(list(texts.items()), "fp long, text string"))
    sets = {k: set(simhash.shingle_hashes(t, 5).tolist()) for k, t in texts.items()}
    assert all(len(r.packed) < 0.5 * 8 * len(sets[r.fp]) for r in packed.collect() if r.fp < 4)
    x, y = (packed.select(packed.fp.alias(k), packed.packed.alias(v)) for k, v in (("a", "x"), ("b", "y")))
    found = {(r.a, r.b) for r in simhash.alike(x.crossJoin(y).where("a < b"), 0.8, 5).collect()}
    assert found == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} == {(1, 2)}

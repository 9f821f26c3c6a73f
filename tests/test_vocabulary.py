"""A vocabulary kept by signed deltas against a full count, and rules that fire."""

import random

from corpusloom.operators import vocab

CHUNKS = "doc_name string, text string, section_path_str string"


def table(rows):
    return sorted(tuple(r) for r in rows.collect())


def test_any_sequence_of_changes_equals_a_full_count(spark, tmp_path):
    rng = random.Random(1)
    words = ["pump", "seal", "valve", "überdruck", "the", "a1", "x" * 130]
    docs = {}

    def document(i):
        chunks = [(f"Pump-{i % 3} manual_{rng.choice(words)}.pdf" if i else None, " ".join(rng.choices(words, k=rng.randrange(1, 30))), rng.choice(["", "Seal data", None])) for _ in range(rng.randrange(1, 4))]
        name = f"d{i}"
        return name, [(f"{name} {c[0] or ''}", *c[1:]) for c in chunks]

    log = vocab.VocabularyLog(spark, str(tmp_path / "log"))
    for step in range(4):
        gone = {k: docs.pop(k) for k in rng.sample(sorted(docs), len(docs) // 3)}
        come = dict(document(step * 10 + j) for j in range(6))
        docs.update(come)
        added = spark.createDataFrame([c for v in come.values() for c in v], CHUNKS)
        removed = spark.createDataFrame([c for v in gone.values() for c in v], CHUNKS)
        log.change(f"s{step}", added, removed)
        if step == 1:  # offered again: it takes effect once
            log.change(f"s{step}", added, removed)
        now = spark.createDataFrame([c for v in docs.values() for c in v], CHUNKS)
        if step in (1, 3):
            assert table(log.counters()) == table(vocab.token_counters(now))
            assert table(log.sizes()) == table(vocab.corpus_sizes(now))
        if step == 2:
            log = log.compact(str(tmp_path / "compacted"))
    assert table(log.rules()) == table(vocab.generic_rules(now))


def test_a_delta_without_its_sizes_does_not_count(spark, tmp_path):
    log = vocab.VocabularyLog(spark, str(tmp_path / "log"))
    chunks = spark.createDataFrame([("Pump.pdf", "pump text", "")], CHUNKS)
    log.change("whole", chunks)
    vocab.token_hits(chunks).write.parquet(f"{tmp_path}/log/hits/delta=cut_off")
    assert table(log.counters()) == table(vocab.token_counters(chunks))


def test_each_rule_fires(spark):
    long_text = "flow " * 30
    rows = [(f"Vacuum {i}.pdf", long_text, "") for i in range(8)]  # in all titles, never in bodies
    rows += [(f"Other {i}.pdf", "short", "Settings") for i in range(3)]  # in short headers only
    got = {r.token: (r.r1, r.r2, r.r3) for r in vocab.generic_rules(spark.createDataFrame(rows, CHUNKS)).collect()}
    assert got["vacuum"] == (True, False, True) and got["settings"] == (False, True, True) and got["flow"] == (False, False, False)


def test_hits_in_bodies_are_a_row_a_token_whatever_the_number_of_documents(spark):
    rows = [(f"Pump {i}.pdf", f"Flow flow rate ab {i % 3}77 Überdruck", "") for i in range(30)] + [(None, None, None), ("x", "", "")]
    chunks = spark.createDataFrame(rows, CHUNKS).coalesce(1)
    hits = vocab.token_hits(chunks)
    body = {r.token: r.body_hits for r in hits.where("body_hits > 0").collect()}
    assert hits.where("body_hits > 0").count() == len(body)
    assert body == {"flow": 30, "rate": 30, "077": 10, "177": 10, "277": 10, "berdruck": 30}
    assert {(r.token, r.title_docs) for r in vocab.token_counters(chunks).where("title_docs > 0").collect()} == {("pump", 30)}


def test_counts_given_back_in_parts_add_up():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([f"w{i % 7}00 w{i % 5}00" for i in range(100)]), pa.array([i % 2 == 0 for i in range(100)])], names=["text", "long"])
    whole = pa.Table.from_batches(vocab._body_counts(iter([batch])))
    most, vocab.MOST_TOKENS = vocab.MOST_TOKENS, 2
    try:
        parts = pa.Table.from_batches(vocab._body_counts(iter([batch])))
    finally:
        vocab.MOST_TOKENS = most
    added = lambda t: sorted(map(tuple, (r.values() for r in t.group_by("token", use_threads=False).aggregate([("body_hits", "sum"), ("long_body_hits", "sum")]).to_pylist())))
    assert added(parts) == added(whole) and parts.num_rows > whole.num_rows


def test_letters_in_bodies_are_those_of_the_lower_cased_text(spark):
    from pyspark.sql import functions as F

    chars = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    text = lambda a, b: f"{a}x{b}y{a}"
    texts = [" ".join(text("ab", c) for c in chars[i : i + 5000]) for i in range(0, len(chars), 5000)]
    lower = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    for i, tokens in lower.collect():
        assert [t.decode() for t in vocab._tokens(texts[i].encode())] == tokens


def test_bodies_are_searched_for_what_rules_may_name_only(spark, monkeypatch):
    rng = random.Random(2)
    words = ["pump", "seal", "valve", "überdruck", "the", "a1", "what", *(f"w{i}" for i in range(200))]
    rows = [(f"Pump {rng.choice(words)} {i % 9}.pdf" if i % 10 else None, " ".join(rng.choices(words, k=rng.randrange(1, 60))) if i % 13 else None, rng.choice(["", "Seal data", "the valve", None])) for i in range(200)]
    rows += [("Pump x.pdf", "K2 mount", "K2 mount")] * 3
    chunks = spark.createDataFrame(rows, CHUNKS)
    expected = table(vocab.generic_rules(chunks).where("r1 or r2 or r3"))
    assert len(expected) > 3
    given, whole = [], vocab.body_hits
    monkeypatch.setattr(vocab, "body_hits", lambda c, wanted=None: given.append(wanted) or whole(c, wanted))
    assert table(vocab.named_by_rules(chunks)) == expected
    assert {r[0].encode() for r in expected} <= given[0] and len(given[0]) < 20
    assert {r.token.encode() for r in whole(chunks, given[0]).collect()} <= given[0]
    monkeypatch.setattr(vocab, "MOST_WANTED", 1)  # more than that: all tokens are counted
    assert table(vocab.named_by_rules(chunks)) == expected and given[-1] is None
    assert table(vocab.named_by_rules(chunks.limit(0))) == []

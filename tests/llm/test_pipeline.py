import corpus_pipeline
from corpusloom.llm import mixing, pieces, secrets, simhash, toxicity
from corpusloom.llm.common import crc_mod
from pyspark.sql import functions as F


def test_stages_step_by_step(spark, sf, docs):
    """The pipeline's rows against its stages redone on the driver from the operators' own outputs."""
    columns = docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.where(crc_mod("doc_id", 5) != 0))
    left = {r.doc_id: r for r in docs.collect() if model.score(r.text) < 0.5}
    assert 0 < len(left) <= docs.count()
    frame = spark.createDataFrame(list(left.values()), docs.schema)
    roots = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()}
    left = {i: r for i, r in left.items() if roots[i] == i}
    frame = spark.createDataFrame(list(left.values()), docs.schema)
    clean = {}
    for r in secrets.find_secrets(frame).collect():
        text, out, at = left[r.doc_id].text, "", 0
        for s in r.spans:
            if s.start >= at:
                out += text[at : s.start] + ("<SECRET>" if s.live else "<EXAMPLE>")
                at = s.end
            at = max(at, s.end)
        clean[r.doc_id] = out + text[at:]
    frame = spark.createDataFrame([(i, t, left[i].lang, left[i].source, len(t)) for i, t in clean.items()], docs.schema)
    times = {r.doc_id: r.n_copies for r in mixing.copies(mixing.mix(frame)).collect()}
    codec = pieces.Codec(pieces.model_bytes(corpus_pipeline.PIECE_MODEL))
    want = sorted((i, clean[i], list(codec.encode(clean[i]))) for i in clean for _ in range(times[i]))
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == [*columns, "ids"]
    assert sorted((r.doc_id, r.text, r.ids) for r in got.collect()) == want


def test_stages_keep_the_columns_and_take_edges(spark, sf, edge_docs, no_docs):
    for frame in (edge_docs, no_docs):
        now = frame
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf)
            if name != "sentencepiece":
                assert now.columns == frame.columns, name
            now = spark.createDataFrame(now.collect(), now.schema)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "secret_scans", "source_mix", "sentencepiece"]


def test_repeated_rows_leave_one(spark, sf, edge_docs):
    kept = corpus_pipeline.drop_near_duplicates(spark, edge_docs, sf)
    assert [r.doc_id for r in kept.where(F.col("doc_id") == 1).collect()] == [1]
    assert kept.where("doc_id in (3, 4, 8)").count() == 0


def test_no_document_is_lost_for_its_id(spark, sf):
    """Null ids, and ids with several texts: each text that no other is like stays, once."""
    words = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(None, words("a")), (None, words("b")), (None, words("b")), (5, words("c")), (5, words("d")), (5, words("d")), (6, words("d")), (7, words("e")), (None, words("e")), (8, words("f") + " tail"), (9, words("f"))]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()]
    key = lambda r: (r[0] or -1, r[1])
    assert sorted(got, key=key) == sorted([(None, words("a")), (None, words("b")), (5, words("c")), (5, words("d")), (7, words("e")), (8, words("f") + " tail")], key=key)


def test_what_op3_links_is_one_group_in_the_pipeline(spark, sf):
    """Texts with one fingerprint whose sets of shingles are not alike leave one document, and so does what else op3 links."""
    long = lambda k: "pump seal valve " * 200 + " ".join(f"{k}{i}" for i in range(30))
    docs = [(1, long("a")), (2, long("b")), (3, " ".join(f"c{i}" for i in range(30))), (4, long("d")), (5, " ".join(f"e{i}" for i in range(30)))]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in docs[:2]]
    assert len(sets[0] & sets[1]) < 0.2 * len(sets[0] | sets[1])
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    op3 = {r.doc_id: r.component_id for r in simhash.near_fingerprints(frame).collect()}
    assert op3 == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, sf).collect()} == {1, 3, 5}

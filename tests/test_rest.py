"""Expressions, readers, writers, images, chat, dashboards and streams on crafted rows."""

import json
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions import answers, speech
from corpusloom.functions import text as X
from corpusloom.operators import chat, chunking, dashboard, expand, images, ingest, rank
from corpusloom.plans.config import RetrievalConfig
from corpusloom.plans.questions import question_rows
from corpusloom.plans.retrieval import DOCUMENT_HINTS, retrieve
from corpusloom.sources import documents, sinks
from corpusloom.streaming import events


def values(spark, texts, *exprs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *[e(F.col("t")).alias(f"e{k}") for k, e in enumerate(exprs)]).orderBy("i").collect()]


def test_length_multipliers(spark):
    got = values(spark, ["x" * n for n in (59, 60, 79, 80, 99, 100, 119, 120, 179, 180)] + [None], X.thin_chunk, lambda t: X.title_only(F.lit("Model 5"), t), lambda t: X.title_only(F.lit("Scope"), t))
    assert [g[0] for g in got] == [0.35, 0.55, 0.55, 0.55, 0.55, 0.55, 0.55, 0.85, 0.85, 1.0, 0.35]
    assert [g[1] for g in got] == [0.45] * 5 + [1.0] * 5 + [0.45]
    assert [g[2] for g in got] == [0.55] * 3 + [1.0] * 7 + [0.55]


def test_coverage_and_boilerplate(spark):
    few, many = X.words(("pump",)), X.words(("pump", "valve", "pump"))
    assert values(spark, ["a PUMP", "", "pumpvalve"], lambda t: X.term_coverage(t, few), lambda t: X.term_coverage(t, many)) == [(1.0, pytest.approx(1.03)), (1.0, 1.0), (1.0, pytest.approx(1.28))]
    assert values(spark, ["ISO 9001", "ISO9001 and 24 V", "", "plain"], X.boilerplate) == [(0.32,), (1.0,), (1.0,), (1.0,)]


def test_pages_names_and_headings(spark):
    assert values(spark, ["0", "-1", "p. 12", "", None, "12-14", "7"], X.parse_page, X.parse_chunk_index) == [(None, 0), (None, None), (12, None), (None, None), (None, None), (12, None), (7, 7)]
    assert values(spark, [" a b/ü.pdf ", "...", None], lambda t: X.safe_name(t, "doc"), lambda t: X.slug(t, "doc")) == [("a_b_ü.pdf", "a_b__.pdf"), ("doc", "doc"), ("doc", "doc")]
    assert values(spark, ["x\n ## Head ##\n# Z", "none", "###"], X.first_heading) == [("Head ##",), ("",), ("###",)]
    assert values(spark, ["C:\\d\\f.PDF", "/a/b.c", "plain"], X.base_name) == [("f.PDF",), ("b.c",), ("plain",)]
    assert values(spark, ["My-File (v2)_draft.pdf"], lambda t: X.title_tokens(t, F.lit("Pump 123 page"))) == [(["pump"],)]
    assert values(spark, ["## IV. Safety: Rules!"], X.normalize_section) == [("safety rules",)]


def test_embedding_text_and_tables(spark):
    assert values(spark, ["# Head\nbody", "body"], lambda t: X.embedding_text(F.lit("Head"), t), X.is_table) == [("# Head\nbody", False), ("Head\n\nbody", False)]
    table = F.array(F.array(F.lit(" a "), F.lit("b")), F.array(F.lit(""), F.lit(None)), F.array(F.lit("1"), F.lit("2")))
    assert values(spark, ["x"], lambda t: X.flatten_table(table)) == [("| a | b |\n| --- | --- |\n| 1 | 2 |",)]
    assert values(spark, ["q", " "], lambda t: X.embedding_prompt(t, "query", "embeddinggemma"), lambda t: X.embedding_prompt(t, "document", "plain")) == [("task: search result | query: q", "q"), (" ", " ")]


def test_answers(spark):
    text = "Intro\n---\n- one\n- two\nNot found in the provided context"
    assert values(spark, [text], X.answer_for_display) == [("Intro\n\n• one  \n• two",)]
    assert values(spark, ["same line\n\nSame  line.\nother"], answers.clean_answer) == [("same line\nother",)]
    assert values(spark, ["Rated 1.2 kW\nRated 12 kW", "Answer: x\nAnswer: y", "User query: a\n[1] source: b\nAs an assistant, I say c\nWould you like to know:"], answers.clean_answer) == [("Rated 1.2 kW\nRated 12 kW",), ("y",), ("I say c",)]
    assert values(spark, ["I am a PUMP assistant. please ask about pumps\nmore", "a pump assistant"], lambda t: answers.clean_answer(t, "No.", ("pump assistant", "please ask"))) == [("No.",), ("a pump assistant",)]
    finished = ["Bullet points:\n• a\nBullet points:\n• b", "• a\nBullet point:\n- b", "x\nKey points:\n• a\nKey points:\n• b", "done [Source: chunk 4] so [Passage 2, page 3]\nOk\nthanks", "body\nWould you like to know more?", "hi"]
    assert values(spark, finished, answers.finished_answer) == [("• a",), ("• a",), ("x\n\nKey points:\n• a",), ("done so",), ("body",), ("hi",)]
    long_ = "w " * 160 + "steps: 1) open 2) close; 3) end"
    shown = values(spark, ["It is 5 V. Do you need more?", long_, "fine\nAsk about pumps", "Ask about pumps"], lambda t: X.answer_for_display(t, ("ask about pumps",)))
    assert shown == [("It is 5 V.\n\nDo you need more?",), (("w " * 160 + "steps:  \n1) open 2) close;  \n3) end"),), ("fine",), ("Ask about pumps",)]
    assert values(spark, ["one"], lambda t: answers.rolling_drafts(F.array(t, F.lit(" "), F.lit("two"), F.lit("three")))) == [(["", "one", "one", "one\n\ntwo"],)]
    assert values(spark, ["prose only", "1. new thing here\n2. old"], lambda t: answers.novel_items(t, F.lit("7. old"))) == [(None,), ("8. new thing here",)]
    assert values(spark, ["One. Two! " + "w" * 30 + ". End"], lambda t: answers.packed_sentences(t, 12)) == [(["One. Two!", "w" * 24, "w" * 6 + ". End"],)]
    assert values(spark, ["abcdef", "xyz", "abx", "abc \n d", "abc", None], lambda t: answers.suppress_repeat(F.lit("abc"), t)) == [("def",), ("xyz",), ("x",), ("d",), ("",), ("",)]
    assert values(spark, [" as is"], lambda t: answers.suppress_repeat(F.lit(""), t)) == [(" as is",)]
    assert values(spark, ["x", None], X.gate_reply) == [(True,), (True,)] and values(spark, ["irrelevant!"], X.gate_reply) == [(False,)]
    assert values(spark, ["hello there (typed by user)", " ", "y" * 900], X.chat_title) == [("hello there",), ("(empty)",), ("y" * 799 + "…",)]
    assert values(spark, ["p1 p2  real"], lambda t: X.strip_markers(t, ("p1", "p2"))) == [("real",)]
    assert values(spark, ["2024-01-05T14:03:09Z", "not a time at all, really"], X.request_time) == [("Jan 05, 2024 2:03 PM",), ("not a time at all, ",)]
    assert values(spark, ["Hi, I'm a  pump assistant", "no"], lambda t: X.out_of_domain(t, ("i'm a pump assistant",))) == [(True,), (False,)]
    assert values(spark, ["1:02", "1:02:03", "61:00", "1:60", "x", ""], X.parse_clock) == [(62,), (3723,), (3660,), (None,), (None,), (None,)]
    assert values(spark, ["3", "x", None, "2.9"], lambda t: X.config_value(t, "int", 7), lambda t: X.config_value(t, "boolean", True)) == [(3, False), (7, False), (7, True), (2, False)]


def test_citations(spark):
    cite = lambda text, **k: [tuple(c) for c in values(spark, [text], lambda t: X.citations(t, **{n: F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)) for n, v in k.items()}))[0][0]]
    assert cite("see Manual A.pdf, page 3; [**Manual B.pdf**; **page 4**] [B.pdf, page 4]") == [("Manual A.pdf", 3, None, None, None), ("Manual B.pdf", 4, None, None, None), ("B.pdf", 4, None, None, None)]
    assert cite("[Passage 2, page 5] and [Passage 3], **page 6**") == [(None, 5, 2, None, None), (None, 6, 3, None, None)]
    assert cite("Clip.mp4, timestamp 01:00 – 02:00 or [b.mkv, 1:00:05-1:00:09]") == [("Clip.mp4", None, None, 60, "01:00-02:00"), ("b.mkv", None, None, 3605, "1:00:05-1:00:09")]
    assert cite("it is told in the Manual A.pdf, page 3 but not x.pdf, page 1", known=["manual a.pdf", "A.pdf"]) == [("manual a.pdf", 3, None, None, None)]
    assert cite("turn it. page 16\n8. check [Page 12] [Passage 1, page 2] at 00:10-00:20", sole="M.pdf") == [("M.pdf", 2, 1, None, None), ("M.pdf", 16, None, None, None), ("M.pdf", 12, None, None, None), ("M.pdf", None, None, 10, "00:10-00:20")]
    assert cite("nothing here") == []


def test_speech(spark):
    assert values(spark, ["", "aaaaaaa bbb", "go go go go go"], speech.quality_penalty) == [(1000.0,), (4.0,), (pytest.approx(2.0),)]
    assert values(spark, ["press start", "سلام", "", "zz zz"], lambda t: speech.good_enough(t, F.lit("fr"))) == [(True,), (False,), (False,), (True,)]
    best = values(spark, ["a normal sentence about pumps"], lambda t: speech.best_candidate(F.struct(t.alias("text"), F.lit("en").alias("detected")), F.struct(F.lit("नमस्ते दुनिया").alias("text"), F.lit("hi").alias("detected")), F.struct(F.lit("short").alias("text"), F.lit("en").alias("detected")))["lang"])
    assert best == [("hi",)]


def test_images(spark):
    md = "![Image](data:image/png;base64,AAEC)\nintro text\n**Figure 2: valve**\n![Named](data:image/jpeg;base64,AAEC)\n![bad](data:image/png;base64,@@)\n![web](http://x/y.png)"
    rows = images.extract_images(spark.createDataFrame([("f.pdf", md), ("g.md", "![](data:image/gif;base64,AAEC)")], "doc_name string, md string")).orderBy("doc_name", "image_index").collect()
    assert [(r.doc_name, r.image_index, r.caption, r.image_mime) for r in rows] == [("f.pdf", 0, "Figure 2: valve", "image/png"), ("f.pdf", 1, "Named", "image/jpeg"), ("g.md", 0, "g figure 1", "image/gif")]
    assert bytes(rows[0].image) == b"\x00\x01\x02"
    pairs = [("vacuum pump", "the suction pump"), ("figure", "x"), ("valve", "show image"), ("other", "suction"), ("", "q")]
    df = spark.createDataFrame(pairs, "c string, q string").select(images.caption_match(F.col("c"), F.col("q")).alias("m"))
    assert [r.m for r in df.collect()] == [1.0, 0.0, 1.0, 0.0, 0.0]
    assert values(spark, ["Image", "see www.x.com", "Pump", "", "<!-- page  break -->"], X.is_bad_caption) == [(True,), (True,), (False,), (True,), (True,)]
    assert values(spark, ["![a](data:image/png;base64,AA==) cap"], X.clean_image_caption) == [("cap",)]


def image_row(uuid, caption, score, doc="d", text="", size=(200, 200), image=b"x" * 3000):
    return (0, score, uuid, caption, text, doc, bytearray(image), *size)


def test_image_ranking(spark):
    schema = "query_id long, vec_score double, image_uuid string, caption string, text string, doc_name string, image binary, width int, height int"
    rows = [image_row("a", "suction pump", 0.5), image_row("b", "", 0.9), image_row("c", "www.site.com pump", 0.8), image_row("d", "pump", 0.7, doc="other"), image_row("e", "unrelated thing", 0.6), image_row("f", "pump", 0.4, size=(20, 900)), image_row("g", "vacuum pump", 0.3), image_row("", "pump", 0.9)]
    asked = spark.createDataFrame([(0, "vacuum pump", "vacuum pump\npump text", "pump text", "d")], "query_id long, question string, caption_query string, chunk_ctx string, top_doc string")
    got = [(r.image_uuid, r.kind) for r in images.retrieve_images(spark.createDataFrame(rows, schema), asked).orderBy("image_rank").collect()]
    assert got == [("a", "lexical"), ("g", "lexical"), ("b", "semantic")]
    explicit = asked.withColumn("question", F.lit("show image pump gasket flange"))
    got = [(r.image_uuid, r.kind) for r in images.retrieve_images(spark.createDataFrame([image_row("h", "pump gasket", 0.5), image_row("i", "pump gasket flange", 0.1)], schema), explicit).orderBy("image_rank").collect()]
    assert got == [("i", "lexical")]
    got = [(r.image_uuid, r.kind) for r in images.retrieve_images(spark.createDataFrame([image_row("h", "pump gasket", 0.5)], schema), explicit).collect()]
    assert got == [("h", "fallback")]


def test_incremental_ingest(spark):
    old = spark.createDataFrame([("same", "f1", "t"), ("same", "f1", "u"), ("legacy", None, "t"), ("changed", "f0", "t"), ("payload", "f4", "DATA:image/png;base64"), ("gone", "f9", "t"), ("mixed", "f5", "t"), ("mixed", "f6", "t")], "doc_name string, doc_fingerprint string, text string")
    listing = spark.createDataFrame([("same", "f1"), ("legacy", "f2"), ("changed", "f3"), ("payload", "f4"), ("mixed", "f5"), ("new", "f7")], "doc_name string, doc_fingerprint string")
    plan = ingest.incremental_plan(old, listing)
    assert {r.doc_name: r.action for r in plan.collect()} == {"same": "keep", "legacy": "keep", "changed": "process", "payload": "process", "mixed": "process", "new": "process"}
    kept = ingest.kept_rows(old, plan)
    assert sorted(r.doc_name for r in kept.collect()) == ["legacy", "same", "same"]
    merged = ingest.merge(kept, spark.createDataFrame([("new", "f7", "t", 5)], "doc_name string, doc_fingerprint string, text string, extra int"))
    assert merged.count() == 4 and "extra" in merged.columns
    stats = ingest.usage_statistics(plan, merged.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))).first()
    assert (stats.docs_total, stats.docs_processed, stats.docs_reused, stats.num_chunks, stats.dim) == (6, 4, 2, 4, 2)
    again = ingest.incremental_plan(merged.withColumn("doc_fingerprint", F.coalesce("doc_fingerprint", F.lit(None).cast("string"))), listing.where("doc_name in ('same','legacy','new')"))
    assert {r.action for r in again.collect()} == {"keep"}
    assert ingest.incremental_plan(old.limit(0), listing).where("action = 'process'").count() == 6


def test_status_uploads_and_exports(spark):
    raw = spark.createDataFrame([('{"updated_at":"u","documents":{"a":{"status":"completed","chunks":3,"mode":"m"}}}',), ("broken",)], "json string")
    assert [tuple(r) for r in ingest.parse_status(raw).collect()] == [("u", "a", "completed", 3, "m", None)]
    files = spark.createDataFrame([("/x/exp_1.zip",), ("/x/exp_2.zip",), ("/x/other.zip",)], "path string")
    states = spark.createDataFrame([("s", "ready", "/x/exp_1.zip")], "slug string, state string, zip_path string")
    assert [r.path for r in ingest.stale_bundles(files, states, "exp_").collect()] == ["/x/exp_2.zip"]
    queue = spark.createDataFrame([("a", "queued", 2), ("b", "queued", 1), ("c", "failed", 0)], "slug string, state string, position int")
    assert {r.slug: r.next_state for r in ingest.export_transition(queue).collect()} == {"a": "queued", "b": "building", "c": "failed"}
    assert {r.slug: r.ordinal for r in ingest.queue_positions(queue).collect()} == {"c": 1, "b": 2, "a": 3}
    users = spark.createDataFrame([("abc123!x",), ("short1!",), ("nodigits!!",), ("nospecial1",)], "password string")
    assert [r.accepted for r in ingest.password_policy(users).collect()] == [True, False, False, False]


def test_chat_edges(spark):
    sessions = spark.createDataFrame([("empty", "2024-01-03"), ("one", "2024-01-01"), ("two", "2024-01-02")], "session_id string, created_at string")
    messages = spark.createDataFrame([(1, "one", "2024-01-05", "only"), (2, "two", "2024-01-05", "first"), (3, "two", "2024-01-04", "second")], "id long, session_id string, created_at string, content string")
    got = [(r.session_id, r.message_count, r.title) for r in chat.session_list(sessions, messages).collect()]
    assert got == [("one", 1, "only"), ("two", 2, "second"), ("empty", 0, None)]
    m = messages.withColumn("role", F.lit("assistant")).withColumn("sources_json", F.lit(json.dumps([{"doc_name": "/x/A.pdf", "doc_path": "p"}])))
    cited = spark.createDataFrame([("two", "a.PDF"), ("two", "b.pdf")], "session_id string, doc string")
    assert {r.doc: r.doc_path for r in chat.resolve_cited(m, cited).collect()} == {"a.PDF": "p", "b.pdf": None}
    fresh = chat.new_sessions(spark.range(2)).collect()
    assert len({r.session_id for r in fresh}) == 2


def test_dashboards(spark):
    assert dashboard.pager_tokens(1, 3) == ["1", "2", "3"]
    assert dashboard.pager_tokens(5, 9) == ["1", "…", "4", "5", "6", "…", "9"]
    assert dashboard.pager_tokens(1, 9) == ["1", "2", "…", "9"]
    index = spark.createDataFrame([("a.pdf", "t", "/t/a.pdf")], "key string, tenant string, path string")
    wanted = spark.createDataFrame([("A.pdf", None), ("dir/a.pdf", None), ("b.pdf", "/old/b"), ("c.pdf", "")], "doc_name string, doc_path string")
    chunks = spark.createDataFrame([("c.pdf", "/chunk/c")], "doc_name string, doc_path string")
    assert {r.doc_name: r.path for r in dashboard.resolve_paths(wanted, index, chunks).collect()} == {"A.pdf": "/t/a.pdf", "dir/a.pdf": "/t/a.pdf", "b.pdf": "/old/b", "c.pdf": "/chunk/c"}
    assert dashboard.kpis(spark.createDataFrame([], "tenant string, name string, status string")).first().completed_pct == 0


def ranked_rows(spark):
    base = [(0, 1, 0.9, "t", "Handling-of-Expired-and-Obsolete-Materials.pdf", 3, 10), (0, 2, 0.8, "t", "b.pdf", 1, 11), (0, 3, 0.5, "u", "Handling-of-Expired-and-Obsolete-Materials.pdf", 1, 12)]
    return spark.createDataFrame(base, "query_id long, rank int, score double, tenant string, doc_name string, chunk_index long, vector_id long").withColumn("text", F.lit("words")).withColumn("section_path_str", F.lit("s")).withColumn("page_number", F.lit(1))


def test_scope_thresholds_and_context(spark):
    q = spark.createDataFrame([(0, "expired stock disposal")], "query_id long, question string")
    rows = ranked_rows(spark)
    assert [r.vector_id for r in expand.scope_to_hint(rows, q, DOCUMENT_HINTS, 9).orderBy("rank").collect()] == [10]
    assert expand.scope_to_hint(rows, q.withColumn("question", F.lit("expired")), DOCUMENT_HINTS, 9).count() == 3
    assert [r.vector_id for r in expand.restrict_to_top_document(rows).collect()] == [10]
    assert expand.above(rows, 0.95).count() == 0 and expand.above(rows, 0.0).count() == 3 and expand.above(rows, 0.8).count() == 2
    context = rows.withColumn("position", F.col("rank")).withColumn("timestamp", F.lit(None).cast("string")).withColumn("ingest_mode", F.lit("video_transcript")).withColumn("text", F.repeat(F.lit("x"), 90))
    assert expand.domain_override(context).first().override
    assert not expand.domain_override(context.withColumn("text", F.lit("short"))).first().override
    assert expand.fallback_answer(context).first().answer.startswith("From Handling-of-Expired-and-Obsolete-Materials.pdf (page 1, section s): xxx")
    batched = chunking.head_then_rest(rows, 2, 5)
    assert [(r.batch, r.pages, r.section) for r in expand.batch_progress(batched).orderBy("batch").collect()] == [(0, [1], "s"), (1, [1], "s")]


def test_retrieval_branches(spark, sf):
    from corpusloom import fixtures

    chunks = fixtures.vectors(spark, sf)
    vec = chunks.where("vector_id = 3").first().embedding
    asked = [(7, "zzz qqq", vec)]
    strict = retrieve(chunks, asked, RetrievalConfig(min_hybrid_rerank_score=1.0))
    assert strict.context.count() == 0 and strict.rows.count() == 0
    loose = RetrievalConfig(min_hybrid_rerank_score=0.0, restrict_top_document=False, hybrid_rerank_enabled=False, top_k=5, top_doc_section_expand=False, max_context_chars=5000)
    found = retrieve(chunks, asked, loose)
    context = found.context.collect()
    assert found.reranked.count() == 5 and sum(len(r.text) for r in context) <= 5000 and {r.query_id for r in context} == {7}
    assert sorted(r.position for r in context) == list(range(1, len(context) + 1))
    assert rank.pool_sizes(1000, 2, 72, 2) == (72, 216) and rank.pool_sizes(30, 2, 72, 2) == (30, 30) and rank.pool_sizes(0, 2, 72, 2) == (0, 0)
    q = question_rows(spark, [(1, "What is the torque of the pump?", [0.0])]).first()
    assert q.active == "torque" and q.has_focus and q.terms == ["torque"] and q.phrases == []


def test_config():
    c = RetrievalConfig.of({"top_k": "4", "bm25_weight": "x", "restrict_top_document": "No", "mmr_lambda": None, "unknown": 1})
    assert c.top_k == 4 and c.bm25_weight == 0.65 and c.restrict_top_document is False and c.mmr_lambda == 0.68


def test_readers_and_writers(spark, tmp_path):
    folder = tmp_path / "docs"
    (folder / "sub").mkdir(parents=True)
    (folder / "b.TXT").write_bytes("gr\xfcn".encode("latin-1") + " ok".encode())
    (folder / "sub" / "a.md").write_text("# Hi")
    (folder / "skip.exe").write_text("no")
    found = documents.discover(spark, str(folder)).collect()
    assert [r.doc_name for r in found] == ["b.TXT", "a.md"]
    full = {r.doc_name: r for r in documents.with_content(spark, str(folder)).collect()}
    assert full["a.md"].doc_size == 4 and len(full["a.md"].doc_fingerprint) == 64
    texts = {r.doc_name: r.text for r in documents.read_texts(spark, str(folder)).collect()}
    assert texts == {"b.TXT": "grn ok", "a.md": "# Hi"}
    rows = spark.createDataFrame([("t1", "i", 0, "d", "x"), ("t2", "i", 1, "e", "y")], "tenant string, index_name string, vector_id long, doc_name string, text string")
    store = str(tmp_path / "store")
    assert sinks.save_store(rows, store, {"dim": 3})
    back = documents.read_store(spark, store)
    assert back.columns == [n for n, _ in schemas.columns_of(schemas.CHUNK)] and back.count() == 2
    assert documents.read_store(spark, store, ["t2"]).first().doc_name == "e"
    assert [r.tenant for r in documents.tenants_of(back).collect()] == ["t1", "t2"]
    opened, config = documents.open_store(spark, store)
    assert opened.count() == 2 and config.top_k == RetrievalConfig().top_k
    assert sinks.save_store(rows.where("tenant = 't2'").withColumn("index_name", F.lit("j")), store, {"top_k": 5, "bm25_weight": 0.5, "retrieval_generic_terms": ("a", "b")})
    assert documents.open_store(spark, store, ["t2"])[1] == RetrievalConfig(top_k=5, bm25_weight=0.5, retrieval_generic_terms=("a", "b")) and documents.open_store(spark, store)[0].count() == 3
    rows.where("tenant = 't2'").withColumn("vector_id", F.lit(9).cast("long")).drop("tenant", "index_name").write.mode("append").parquet(f"{store}/tenant=t2/index_name=j")
    with pytest.raises(ValueError, match="tenant t2 has 3 chunks, its config says 2"):
        documents.open_store(spark, store)
    assert sinks.save_store(rows.where("tenant = 't2'"), store, {}) and sinks.delete_tenant(rows, store, "t2") > 0
    assert sinks.save_store(rows.where("tenant = 't2'"), store, {})
    assert sinks.delete_tenant(rows, store, "t1") > 0 and documents.read_store(spark, store).count() == 1
    assert not sinks.save_store(rows.limit(0), store, {})
    assert sinks.zip_folder(str(folder), str(tmp_path / "z.zip")) == 3 and len(zipfile.ZipFile(tmp_path / "z.zip").namelist()) == 3
    assert sinks.delete_files([str(folder / "skip.exe"), str(folder / "none")]) == 1
    segments = tmp_path / "talk.json"
    segments.write_text(json.dumps({"transcription": [{"text": "a", "offsets": {"from": 0, "to": 5}}]}))
    assert [(r.doc_name, r.seg_no, r.text, r.offsets["to"]) for r in documents.read_segments(spark, str(segments)).collect()] == [("talk.json", 0, "a", 5)]
    readers = documents.dispatch(spark.createDataFrame([("a.pdf",), ("b.csv",)], "path string")).collect()
    assert [r.reader for r in readers] == ["pdf", "text"]
    with pytest.raises(Exception, match="unsupported extension"):
        documents.dispatch(spark.createDataFrame([("a.xyz",)], "path string")).collect()
    pages = spark.createDataFrame([("d", ["one", " ", "three"])], "doc_name string, pages array<string>")
    assert [(r.page_number, r.text) for r in documents.pages_of(pages).collect()] == [(1, "one"), (3, "three")]
    assert documents.joined_pages(pages, skip_blank=True).first().text == "one\nthree"


def test_streams(spark, sf, tmp_path):
    source = tmp_path / "in"
    rows = spark.read.parquet(f"{sf}/events.parquet").limit(400)
    rows.repartition(3).write.parquet(str(source))
    counted = events.tumbling_counts(events.event_stream(spark, str(source), rows.schema))
    q = counted.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from windows").first()[0] == 400
    listing = tmp_path / "listing"
    spark.createDataFrame([("a", "f1"), ("b", "f2")], "doc_name string, doc_fingerprint string").write.parquet(str(listing))
    stored = spark.createDataFrame([Row(doc_name="a", doc_fingerprint="f1", text="t")])
    done = []
    stream = spark.readStream.schema("doc_name string, doc_fingerprint string").parquet(str(listing))
    run = events.ingest_stream(stream, lambda: stored, lambda df: df, lambda df, n: done.extend(r.doc_name for r in df.collect()), str(tmp_path / "cp"))
    run.awaitTermination(120)
    assert done == ["b"]
    assert events.store_signature(spark, str(listing)).first().files > 0

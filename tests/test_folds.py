"""Order-dependent operators against plain Python written from their rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import chunking, expand, rank
from corpusloom.plans import questions


def plain_chunks(text, size, overlap):
    text = text.replace("\r\n", "\n").replace("\r", "\n").strip()
    out, cur = [], ""
    for p in (p.strip() for p in text.split("\n\n")):
        if not p:
            continue
        if len(cur) + len(p) + 2 <= size:
            cur = f"{cur}\n\n{p}" if cur else p
            continue
        if cur:
            out.append(cur)
            cur = ""
        if len(p) <= size:
            cur = p
            continue
        at = 0
        while True:
            piece = p[at : at + size].strip()
            if piece:
                out.append(piece)
            if at + size >= len(p):
                break
            at += size - overlap
    return out + [cur] if cur else out


def test_chunks(spark):
    rng = random.Random(3)
    texts = ["", "  \n ", "a\r\n\r\nb\rc", "x" * 50, "x" * 49, "x" * 51, "y" * 160, "y" * 120 + "\n\ntiny", "tiny\n\n" + "z" * 48, "a" * 24 + "\n\n" + "b" * 24]
    for _ in range(150):
        texts.append("\n\n".join("".join(rng.choice("ab \n") for _ in range(rng.choice([0, 3, 20, 49, 50, 51, 130]))) for _ in range(rng.randint(1, 6))))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for size, overlap in ((50, 10), (50, 0), (7, 6)):
        got = {r.id: r.c for r in df.select("id", chunking.chunk_array(F.col("t"), size, overlap).alias("c")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == plain_chunks(t, size, overlap), (size, overlap, t)
    with pytest.raises(ValueError):
        chunking.chunk_array(F.col("t"), 10, 10)


def test_markdown_pages_sections_and_images(spark):
    md = "before\n# One\ntext ![Pump](data:image/png;base64,AAAA) on\n<!-- page break -->\n \n<!-- page break -->\n#NoSpace\n####### seven\n## Two\n![image](data:image/png;base64,BBBB)\nend"
    rows = chunking.chunk_markdown(spark.createDataFrame([("d", md)], "doc_name string, md string"), 500, 50).orderBy("chunk_index").collect()
    assert [(r.page_number, r.section_heading, r.content) for r in rows] == [(1, "", "before"), (1, "One", "# One\ntext\nPump\n on"), (3, "NoSpace", "#NoSpace\n####### seven"), (3, "Two", "## Two\n\nend")]


def test_forward_fill(spark):
    rows = [("d", 0, "a", None), ("d", 1, "b", "Sec"), ("d", 2, "c", ""), ("d", 3, "# sec\nx", None), ("e", 0, "q", None)]
    got = chunking.forward_fill_sections(spark.createDataFrame(rows, "doc_name string, chunk_index long, text string, section_path_str string")).collect()
    assert {(r.doc_name, r.chunk_index): (r.text, r.section_path_str) for r in got} == {("d", 0): ("a", None), ("d", 1): ("b", "Sec"), ("d", 2): ("Sec\n\nc", "Sec"), ("d", 3): ("# sec\nx", "Sec"), ("e", 0): ("q", None)}


def test_minute_buckets(spark):
    rows = [("v", 0, " a ", (59999, 61000)), ("v", 1, "b", (60000, 50000)), ("v", 2, "", (0, 1)), ("v", 3, "c", (-5, 10)), ("v", 4, "d", (3_600_000, 3_600_010)), ("v", 5, "e", None)]
    df = spark.createDataFrame(rows, "doc_name string, seg_no long, text string, offsets struct<`from`:long,`to`:long>")
    got = [(r.content, r.page_number, r.timestamp, r.start_sec, r.end_sec) for r in chunking.minute_buckets(df).orderBy("page_number").collect()]
    assert got == [("a c", 1, "00:00-01:00", 0, 60), ("b", 2, "01:00-02:00", 60, 120), ("d", 61, "01:00:00-01:01:00", 3600, 3660)]


@pytest.mark.parametrize("n", [0, 1, 90, 100, 101, 190, 191])
def test_ground_windows(spark, n):
    want, start = [], 0
    while n:
        want.append((start, min(start + 100, n)))
        if start + 100 >= n:
            break
        start += 90
    df = spark.range(n).select(F.lit("d").alias("doc_name"), F.col("id").alias("pos"), F.col("id").alias("vector_id"))
    got = chunking.ground_windows(df).groupBy("start_i", "end_i").agg(F.count("*").alias("n")).collect()
    assert sorted((r.start_i, r.end_i) for r in got) == want and all(r.n == r.end_i - r.start_i for r in got)


def test_assignments_and_merge(spark):
    replies = spark.createDataFrame([("d", 0, 3, 'x ```json\n{"assignments": {"1": "Pump head!", "2": " ", "9": "z"}}\n```'), ("d", 2, 5, "broken {")], "doc_name string, start_i int, end_i int, reply string")
    expected = spark.createDataFrame([("d", 0, 3, i) for i in range(3)] + [("d", 2, 5, i) for i in range(2, 5)], "doc_name string, start_i int, end_i int, vector_id long")
    got = {(r.start_i, r.vector_id): r.label for r in chunking.parse_assignments(replies, expected).collect()}
    assert got == {(0, 0): "missing_0", (0, 1): "Pump_head", (0, 2): "missing_2", (2, 2): "missing_2", (2, 3): "missing_3", (2, 4): "missing_4"}
    zero = spark.createDataFrame([("d", 0, 2, '{"1": "a"}')], "doc_name string, start_i int, end_i int, reply string")
    rows = chunking.parse_assignments(zero, expected.where("start_i = 0 and vector_id < 2").withColumn("end_i", F.lit(2)))
    assert {r.vector_id: r.label for r in rows.collect()} == {0: "a", 1: "a"}
    windows = spark.createDataFrame([("d", 0, 10, 1, "old"), ("d", 5, 15, 1, "new"), ("d", 0, 10, 2, "only")], "doc_name string, start_i int, end_i int, vector_id long, label string")
    merged = chunking.merge_windows(windows, spark.range(1, 4).select(F.lit("d").alias("doc_name"), F.col("id").alias("vector_id")))
    assert {r.vector_id: r.label for r in merged.collect()} == {1: "new", 2: "only", 3: "singleton_3"}


def test_section_stack_and_blocks(spark):
    content = ["1. Intro", "plain text", "1.2 Scope", "more", "99 bottles of beer", "2. Next", "| a |"]
    blocks = spark.createDataFrame([("d", i, "table" if c.startswith("|") else "paragraph", c, 1) for i, c in enumerate(content)], "doc_name string, block_no int, type string, content string, page_number int")
    got = [r.section_path_str for r in chunking.section_stack(blocks).orderBy("block_no").collect()]
    one, scope = "Section 1 Intro", "Section 1 Intro > Section 1.2 Scope"
    assert got == [one, one, scope, scope, scope, "Section 2 Next", "Section 2 Next"]
    chunks = [(r.chunk_id, r.text, r.chunk_type) for r in chunking.block_chunks(blocks, 40).orderBy("chunk_id").collect()]
    assert chunks == [("chunk_00000", "1. Intro", "heading"), ("chunk_00001", "plain text", "paragraph"), ("chunk_00002", "1.2 Scope", "heading"), ("chunk_00003", "more 99 bottles of beer", "paragraph"), ("chunk_00004", "2. Next", "heading"), ("chunk_00005", "| a |", "table")]


def plain_mmr(vectors, q, k, weight):
    sim = vectors @ q
    if len(sim) <= k:
        return list(np.argsort(-sim, kind="stable"))
    chosen = [int(np.argmax(sim))]
    while len(chosen) < k:
        best, top = None, -1e9
        for j in range(len(sim)):
            if j not in chosen:
                gain = weight * sim[j] - (1 - weight) * max(vectors[j] @ vectors[i] for i in chosen)
                if gain > top:
                    best, top = j, gain
        chosen.append(best)
    return sorted(chosen, key=lambda i: -sim[i])


@pytest.mark.parametrize("k,weight", [(1, 0.5), (5, 0.62), (5, 0.0), (5, 1.0), (40, 0.68)])
def test_mmr(spark, k, weight):
    rng = np.random.default_rng(k)
    v = rng.standard_normal((20, 4))
    v[7] = v[3]
    q = rng.standard_normal(4)
    pool = spark.createDataFrame([(0, i, x.tolist(), float(-i)) for i, x in enumerate(v)], "query_id long, vector_id long, embedding array<double>, fused double")
    queries = spark.createDataFrame([(0, q.tolist())], "query_id long, query_vec array<double>")
    got = [r.vector_id for r in rank.mmr(pool, queries, k, weight).orderBy("mmr_rank").collect()]
    assert got == plain_mmr(v, q, k, weight)


def plain_pack(texts, budget, stop):
    left, out = budget, []
    for i, t in texts:
        if budget <= 0 or not t.strip():
            continue
        if len(t) <= left:
            out.append((i, t))
            left -= len(t)
            if left <= 0:
                break
        elif left >= 280:
            out.append((i, t[:left]))
            break
        elif stop:
            break
    return out


def test_packing(spark):
    rng = random.Random(5)
    cases = [[500, 700, 10], [1000], [720, 400, 200], [721, 400, 200, 79], [0, 50], []]
    cases += [[rng.choice([0, 10, 100, 279, 280, 281, 400, 999]) for _ in range(rng.randint(1, 8))] for _ in range(60)]
    rows = [(q, i, "x" * n) for q, c in enumerate(cases) for i, n in enumerate(c)]
    df = spark.createDataFrame(rows, "query_id long, vector_id long, text string").withColumn("ord", F.struct(F.lit(0).alias("kind"), F.col("vector_id").alias("rank")))
    df = df.withColumn("tenant", F.lit("t")).withColumn("doc_name", F.lit("d")).withColumn("page_number", F.lit(1)).withColumn("chunk_index", F.col("vector_id"))
    for budget in (1000, 300, 0):
        for pack, stop in ((expand.pack_mixed, False), (expand.pack_top_document, True)):
            got = {}
            for r in pack(df, budget).orderBy("query_id", "position").collect():
                got.setdefault(r.query_id, []).append((r.vector_id, r.text))
            for q, c in enumerate(cases):
                assert got.get(q, []) == plain_pack([(i, "x" * n) for i, n in enumerate(c)], budget, stop), (budget, stop, c)
    saved = expand.never_empty(expand.pack_mixed(df, 100), df, 100)
    assert saved.where("query_id = 1").first().text == "x" * 100


def plain_shrink(texts, limit, length, floor=200, factors=(0.92, 0.85, 0.75, 0.65, 0.55)):
    """Cut evenly, else leave out the last text, until what is left fits."""
    texts = list(texts)
    while True:
        if sum(map(length, texts)) <= limit:
            return texts
        if len(texts) == 1:
            fine = [n for n in range(floor, len(texts[0]) + 1) if length(texts[0][:n]) <= limit]
            return [texts[0][: max(fine, default=floor)]]
        for f in factors:
            trial = [t if not t.strip() else t[: max(floor, int(len(t) * f))] for t in texts]
            if sum(map(length, trial)) <= limit:
                return trial
        texts.pop()


@pytest.mark.parametrize("limit", [60, 700, 1750, 2500])
def test_shrinking(spark, limit):
    cases = [("x" * 1000, "y" * 1000), ("z" * 50,), ("a b " * 300, " " * 600, "c" * 900, "d e" * 70), ("q" * 3000, "r"), (" " * 900,)]
    df = spark.createDataFrame([(q, i, 10 * q + i, t) for q, c in enumerate(cases) for i, t in enumerate(c)], "query_id long, position int, vector_id long, text string")
    for length, plain in ((F.char_length, len), (lambda c: F.regexp_count(c, F.lit(r"\S+")) * 5, lambda t: 5 * len(t.split()))):
        got = {}
        for r in expand.shrink_to_fit(df, limit, length=length).orderBy("query_id", "position").collect():
            got.setdefault(r.query_id, []).append(r.text)
        assert got == {q: plain_shrink(c, limit, plain) for q, c in enumerate(cases)}


def test_questions():
    assert questions.focus_of("What is the rated voltage of the machine?") == "rated voltage"
    assert questions.retrieval_query("What is the rated voltage of the machine?") == "rated voltage"
    assert questions.retrieval_query("How do I clean the filter housing?") == "clean filter housing"
    assert questions.retrieval_query("E4?") == "e4" and questions.retrieval_query("to be") == "to be" and questions.retrieval_query("") == ""
    assert questions.variants("")[0] == "equipment manual"
    v = questions.variants("line voltage safety")
    assert v[0] == "line voltage safety" and len(v) == 3 and v[1].endswith("frequency") and v[2].endswith("protective equipment")
    assert questions.stem("calibration") == "calibr" and questions.stem("valves") == "valv" and questions.stem("gas") == "gas" and questions.stem("x") == ""


def test_stems_agree_on_both_sides(spark):
    words = "calibration calibrating valves organization measurements nations sing string running bed beds national measures gas a operability".split()
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", X.stem(F.col("w")).alias("s")).collect()}
    assert got == {w: questions.stem(w) for w in words}


@pytest.mark.parametrize("seed", range(4))
def test_packing_reaches_no_more_than_the_budget_allows(spark, seed):
    """Thousands of candidates a question: equal to the plain fold, and few rows are gathered."""
    rng = random.Random(seed)
    sizes = {q: [rng.choice([1, 3, 20, 60, 200, 279, 280, 281, 900, 5000] if q % 2 else [30, 31, 270, 400]) for _ in range(1500)] for q in range(4)}
    rows = [(q, i, "x" * n if n != 60 else " " * 60, "t", "d", 1, i) for q, ns in sizes.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "query_id bigint, vector_id bigint, text string, tenant string, doc_name string, page_number bigint, chunk_index bigint").withColumn("ord", F.col("vector_id"))
    for budget in (-1, 0, 100, 777, 3700):
        for pack, stop in ((expand.pack_mixed, False), (expand.pack_top_document, True)):
            got = {}
            for r in pack(df, budget).orderBy("query_id", "position").collect():
                got.setdefault(r.query_id, []).append((r.vector_id, r.text))
            for q, ns in sizes.items():
                assert got.get(q, []) == plain_pack([(i, "x" * n) for i, n in enumerate(ns) if n != 60], budget, stop), (budget, stop, q)
        reached = expand._in_reach(df, F.col("ord"), budget, True).groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
        assert reached <= max(budget, 0) + 1 + 1700

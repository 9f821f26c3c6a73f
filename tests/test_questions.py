"""Question analysis as columns against the functions for single questions, and retrieval for a table of them."""

import random

from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.operators import rank
from corpusloom.operators.vector_index import VectorIndex
from corpusloom.plans import questions, retrieval
from corpusloom.plans.config import RetrievalConfig


def made(n, seed):
    rng = random.Random(seed)
    heads = ["What is the {} of the {}?", "which are {} of {}", "Explain the {} of\tthe {}", "tell me {}  of {} !!", "How do I {} the {}", "{} {}", "  {} ", "what is the ? of x", "define {} and {}", "E4 {}", "", " \n", "explain the a of b"]
    words = ["rated voltage", "safety", "HPLC column", "pump", "machine", "manual", "kg", "not working", "E4", "a1", "relative humidity", "eye", "the", "überdruck", "valves", "calibration", "iq check", "procedure", "of", "é", "power supply.", "x" * 300]
    out = []
    for i in range(n):
        text = rng.choice(heads)
        out.append((i, text.format(*[" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(text.count("{}"))]), [1.0, float(i)]))
    return out


def rows_of(df):
    return {r.query_id: (r.question, list(r.query_vec), r.active, r.terms, r.phrases, r.has_focus, r.bm25_terms, r.rerank_terms) for r in df.collect()}


def test_columns_equal_the_functions_on_ten_thousand_questions(spark):
    asked = made(10_000, 1)
    table = spark.createDataFrame(asked, "query_id bigint, question string, query_vec array<double>").repartition(4)
    got = rows_of(questions.question_columns(table))
    want = rows_of(questions.question_rows(spark, asked))
    assert len(got) == 10_000
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_variants_and_queries_without_cleaning_and_with_a_table_of_generic_words(spark):
    asked = made(600, 2)
    table = spark.createDataFrame(asked, "query_id bigint, question string, query_vec array<double>")
    assert rows_of(questions.question_columns(table, (), clean=False)) == rows_of(questions.question_rows(spark, asked, (), clean=False))
    generic = ["pump", "safety", "supply", "hazard", "x" * 300, "absent"]
    listed = spark.createDataFrame([(g,) for g in generic], "token string")
    assert rows_of(questions.question_columns(table, listed)) == rows_of(questions.question_rows(spark, asked, generic))
    got = table.select("question", questions.variant_columns(F.col("question"), X_GENERIC).alias("v")).collect()
    assert all(list(r.v) == questions.variants(r.question) for r in got)


X_GENERIC = questions.BASELINE_GENERIC


def test_retrieval_of_a_table_and_with_an_index(spark, sf, tmp_path):
    chunks = catalog.fx.vectors(spark, sf)
    vec = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 4").collect()}
    asked = [(i, t, [float(x) for x in vec[i]]) for i, t in enumerate(["what is the onen of the machine", "explain the safety of thor", "troubleshoot onen", "technical specification thenst"])]
    table = spark.createDataFrame(asked, "query_id bigint, question string, query_vec array<double>")
    config = RetrievalConfig(min_hybrid_rerank_score=0.0)
    told = lambda found: sorted((r.query_id, r.position, r.vector_id, r.text) for r in found.context.collect())
    want = told(retrieval.retrieve(chunks, asked, config))
    assert len(want) >= 4
    assert told(retrieval.retrieve(chunks, table, config)) == want
    index = VectorIndex.build(chunks, str(tmp_path / "index"))
    assert told(retrieval.retrieve(chunks, table, config, index=index)) == want


def test_variants_of_a_question_are_asked_by_their_mean(spark):
    rows = [(1, 0, "first", [1.0, 0.0]), (1, 1, "second", [0.0, 1.0]), (2, 0, "alone", [0.0, 2.0])]
    one = retrieval.one_vector_each(spark.createDataFrame(rows, "query_id bigint, variant int, question string, query_vec array<double>"))
    got = {r.query_id: (r.question, [round(x, 6) for x in r.query_vec]) for r in one.collect()}
    assert got == {1: ("first", [0.707107, 0.707107]), 2: ("alone", [0.0, 1.0])}
    assert rank.fused_query_vectors is not None

"""Small operators that had no test of their own."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions import text as X
from corpusloom.operators import chunking, expand, images
from corpusloom.sources import documents, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_section_list(spark):
    paths = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    assert one(spark, X.section_list(paths([" a ", "", "b"]), F.lit("c"))) == ["a", "b"]
    assert one(spark, X.section_list(paths([" "]), F.lit(" c "))) == ["c"]
    assert one(spark, X.section_list(F.lit(None).cast("array<string>"), F.lit(None).cast("string"))) == []


def test_source_page(spark):
    page = lambda *xs: one(spark, X.source_page(*[F.lit(x).cast("string") for x in xs]))
    assert page(None, "x", "p. 7", "9") == 7 and page("", None) is None and page("12-14", "3") == 12


def test_visual_reason(spark):
    reason = lambda n, w, h: one(spark, images.visual_reason(F.lit(None if n is None else b"x" * n), F.lit(w).cast("int"), F.lit(h).cast("int")))
    assert [reason(None, 9, 9), reason(0, 9, 9), reason(2499, None, None), reason(2500, None, None)] == ["invalid_b64", "empty_b64", "small_payload", ""]
    assert [reason(9, 90, 99), reason(9, 300, 34), reason(9, 100, 90)] == ["small_area:90x99", "small_side:300x34", ""]


def test_final_answer(spark):
    answer = lambda *xs: one(spark, X.final_answer(*[F.lit(x).cast("string") for x in xs]))
    assert answer(" served ", "streamed", "<img a>") == "served\n\n<img a>"
    assert answer(" ", " streamed", "") == "streamed"
    assert answer("has <img b>", "", "<img a>") == "has <img b>"
    assert answer(None, None, None) == ""


def test_image_lookup(spark, tmp_path):
    rows = spark.createDataFrame([("t", "u1", b"1", "", "d"), ("t", "u2", b"2", "image/gif", "d")], "tenant string, image_uuid string, image binary, image_mime string, doc_name string")
    rows.write.parquet(str(tmp_path / "images"))
    stored = documents.read_images(spark, str(tmp_path / "images"))
    assert stored.columns == [n for n, _ in schemas.columns_of(schemas.IMAGE)]
    got = images.image_by_uuid(stored, "u1").first()
    assert (bytes(got.image), got.image_mime) == (b"1", "image/png")
    assert images.image_by_uuid(stored, "u2").first().image_mime == "image/gif" and images.image_by_uuid(stored, "none").first() is None


def test_required_chunks(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_name string")
    chunks = spark.createDataFrame([("a", "x")], "doc_name string, text string")
    assert chunking.require_chunks(chunks, docs.where("doc_name = 'a'")).count() == 1
    with pytest.raises(ValueError, match="no chunks: b"):
        chunking.require_chunks(chunks, docs)


def test_patch_of_ground_ids(spark):
    """Windows of four rows that overlap by one; the later window's label wins, and labels are numbered by first row."""
    rows = [("Pump manual.pdf", i, f"S{i // 3}") for i in range(7)]
    chunks = spark.createDataFrame(rows, "doc_name string, vector_id bigint, section_path_str string").withColumn("section_path", F.lit(None).cast("array<string>")).withColumn("ground_id", F.lit("old"))
    replies = []
    for start in (0, 3):
        ids = range(start, min(start + 4, 7))
        replies.append(("Pump manual.pdf", start, min(start + 4, 7), "text " + json.dumps({"assignments": {str(i): f"w{start} {i // 3}" for i in ids}})))
    told = spark.createDataFrame(replies, "doc_name string, start_i bigint, end_i bigint, reply string")
    got = {r.vector_id: r.ground_id for r in chunking.patch_ground_ids(chunks, told, 4, 1).collect()}
    names = [got[i].rsplit("ground-", 1)[1] for i in range(7)]
    assert names == ["0", "0", "0", "1", "1", "1", "2"]
    assert len({g.rsplit("ground-", 1)[0] for g in got.values()}) == 1 and len(got) == 7


def test_status_lines(spark, tmp_path):
    rows = [("a", "completed", 3, "text", None), ("b", "failed", 0, None, "no \"text\"\nat all")]
    status = spark.createDataFrame(rows, "doc_name string, status string, chunks bigint, mode string, error string").repartition(2)
    sinks.write_status(status, str(tmp_path / "status"), "now")
    (tmp_path / "status" / "part-x.json").write_text("not json\n")
    got = sinks.read_status(spark, str(tmp_path / "status"))
    assert sorted((r.doc_name, r.status, r.chunks, r.mode, r.error) for r in got.collect()) == rows
    assert {r.updated_at for r in got.collect()} == {"now"}


def test_preview(spark):
    short, long_ = "a  b\nc", "h" * 140 + "m" * 50 + "t" * 90
    assert one(spark, X.preview(F.lit(short))) == "a b c"
    assert one(spark, X.preview(F.lit(long_))) == "h" * 140 + " ... " + "t" * 90
    assert one(spark, X.preview(F.lit("x" * 235))) == "x" * 235 and one(spark, X.preview(F.lit(None).cast("string"))) == ""


def test_shown_answers(spark):
    raw = spark.createDataFrame([(1, "- a\n- b"), (2, "I'm  the Help Desk."), (3, "I am the help desk"), (4, None)], "query_id bigint, answer string")
    context = spark.createDataFrame([(2, 1, "m.pdf", 4, "Seals", " Check it. "), (2, 2, "n.pdf", 1, "", "other")], "query_id bigint, position int, doc_name string, page_number bigint, section_path_str string, text string")
    stock = ("i'm the help desk", "i am the help desk")
    got = {r.query_id: (r.answer, r.replaced) for r in expand.shown_answers(raw, context, stock).collect()}
    assert got == {1: ("• a  \n• b", False), 2: ("From m.pdf (page 4, section Seals): Check it.", True), 3: ("I am the help desk", False), 4: ("", False)}

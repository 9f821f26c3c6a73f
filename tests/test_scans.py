"""Running values over groups that lie in many tasks, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, scans


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_running_values(spark, parts):
    rng = random.Random(parts)
    rows = [(d, i, rng.choice([None, rng.randrange(100)])) for d, n in (("a", 400), ("b", 3), (None, 60), ("c", 1)) for i in range(n)]
    ranged = scans.in_parts(spark.createDataFrame(rows, "d string, i bigint, v bigint").repartition(4), ("d",), "i", parts)
    assert ranged.select("_part").distinct().count() == min(parts, 16)
    got = scans.running(ranged, ("d",), "i", sums={"s": F.col("v")}, mins={"m": F.col("v")}, lasts={"l": F.col("v")}).collect()
    want, state = {}, {}
    for d, i, v in rows:
        s, m, last = state.get(d, (0, None, None))
        if v is not None:
            s, m, last = s + v, v if m is None else min(m, v), v
        want[d, i] = state[d] = (s, m, last)
    assert {(r.d, r.i): (r.s, r.m, r.l) for r in got} == want


def plain_stack(lines, heading):
    now, out = [], []
    for line in lines:
        if h := heading(line):
            now = now[: h[1] - 1] + [h[0]]
        out.append(list(now))
    return out


def test_stack_of_one_large_document_in_many_tasks(spark):
    rng = random.Random(2)
    lines = {}
    for doc, n in (("large", 3000), ("small", 5), ("none", 4)):
        lines[doc] = []
        for i in range(n):
            level = rng.choice([1, 1, 2, 2, 3, 4, 6])
            number = ".".join(str(rng.randrange(1, 9)) for _ in range(level))
            lines[doc].append(f"{number} Title {i}" if rng.random() < 0.3 and doc != "none" else f"text {i}")
    rows = [(d, i, x) for d, xs in lines.items() for i, x in enumerate(xs)]
    blocks = spark.createDataFrame(rows, "doc_name string, block_no bigint, content string")

    def heading(line):
        first = line.split(" ", 1)[0]
        return (f"Section {line}", first.count(".") + 1) if first[0].isdigit() else None

    for parts in (2, 24):
        got = {(r.doc_name, r.block_no): r.section_path for r in chunking.section_stack(blocks, parts).collect()}
        assert got == {(d, i): p for d, xs in lines.items() for i, p in enumerate(plain_stack(xs, heading))}


def test_no_task_holds_a_large_document(spark):
    blocks = spark.range(20_000).select(F.lit("d").alias("doc_name"), F.col("id").alias("chunk_index"), F.when(F.col("id") % 5000 == 0, F.concat(F.lit("S"), F.col("id").cast("string"))).alias("section_path_str"), F.lit("t").alias("text"))
    ranged = scans.in_parts(blocks, ("doc_name",), "chunk_index", 20)
    assert ranged.groupBy("_part").count().agg(F.max("count")).first()[0] < 3000
    filled = chunking.forward_fill_sections(blocks, parts=20)
    assert filled.where(F.col("section_path_str") != F.concat(F.lit("S"), (F.floor(F.col("chunk_index") / 5000) * 5000).cast("string"))).count() == 0
    assert filled.count() == 20_000


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_name string, block_no bigint, content string")
    assert chunking.section_stack(empty).count() == 0

"""Prompts that fit, against the steps one by one on whole prompts."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import expand
from corpusloom.plans import prompts

KIND = "query_id bigint, position int, vector_id bigint, text string, doc_name string, page_number bigint, timestamp string, section_path_str string"


def test_cap():
    assert prompts.prompt_cap(4096, 512) == 4096 - 640 - 256
    assert prompts.prompt_cap(4096, 0) == 4096 - 512 - 256
    assert prompts.prompt_cap(100, 4000) == max(128, 512 - 256 - 256)


def whole(question, passages, static):
    heads = [f"Passage [{r[1]}] — Document: {r[4] or ''}{f' | timestamp {r[6]}' if r[6] else (f' | page {r[5]}' if r[5] is not None else '')}{f' | section: {r[7]}' if r[7] else ''}\n" for r in passages]
    body = "\n\n".join(h + r[3] for h, r in zip(heads, passages, strict=True))
    return f"{static}\n\nQuestion: {question}\n\nContext:\n{body}"


def step_by_step(question, rows, static, cap, floor=200):
    rows = [list(r) for r in rows]
    fits = lambda rs: len(whole(question, rs, static)) <= cap
    while rows:
        if fits(rows):
            break
        if len(rows) > 1:
            trials = ([[*r[:3], r[3] if not r[3].strip() else r[3][: max(floor, int(len(r[3]) * f))], *r[4:]] for r in rows] for f in (0.92, 0.85, 0.75, 0.65, 0.55))
            fine = next((t for t in trials if fits(t)), None)
            if fine is not None:
                rows = fine
                break
            rows.pop()
            continue
        text = rows[0][3]
        if len(text) > floor:
            rows[0][3] = max((text[:n] for n in range(floor, len(text) + 1) if fits([[*rows[0][:3], text[:n], *rows[0][4:]]])), key=len, default=text[:floor])
        break
    return whole(question, rows, static)


@pytest.mark.parametrize("cap", [400, 1100, 2600])
def test_prompts_equal_the_steps_on_whole_prompts(spark, cap):
    rng = random.Random(cap)
    static, asked, rows = "Answer briefly.", [], []
    for q in range(30):
        asked.append((q, rng.choice(["How to reset?", "What is this " + "long " * rng.randrange(20) + "question"])))
        for i in range(rng.randrange(1, 6)):
            text = "".join(rng.choices("ab é.", k=rng.choice([0, 30, 199, 200, 201, 700, 1500])))
            rows.append((q, i + 1, 100 * q + i, text.strip() or "x", rng.choice(["m.pdf", None]), rng.choice([None, 3]), rng.choice([None, "00:10-01:10"]), rng.choice(["Seals", "", None])))
    context, questions = spark.createDataFrame(rows, KIND), spark.createDataFrame(asked, "query_id bigint, question string")
    told, fitted = prompts.fitted_prompts(context, questions, static, cap)
    got = {r.query_id: r.prompt for r in told.collect()}
    for q, text in asked:
        assert got[q] == step_by_step(text, [r for r in rows if r[0] == q], static, cap), q
    assert fitted.where(F.col("text").isNull()).count() == 0
    assert expand.serialize(fitted).count() == 30

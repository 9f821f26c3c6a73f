"""Every query that has SQL gives the SQL's rows, on the smallest tables."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from corpusloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if float(v).is_integer() else f"{v:.5f}"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return str(int(v)) if isinstance(v, (int, np.integer)) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(value, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(name, spark, sf, duck):
    mine, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(want.columns)
    assert rows(mine) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_has_rows(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_marked_up_holds_whole_texts(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in catalog.fx.marked_up(spark, sf).collect():
        first, _, second = r.md.split("\n<!-- page break -->\n")
        assert first.split("\n\n", 1)[1] + second.split("\n", 1)[1] == texts[r.doc_id]


def test_rolling_drafts_equal_plain_python(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {}
    for r in catalog.QUERIES["rolling_drafts"](spark, sf).orderBy("doc_id", "part").collect():
        got.setdefault(r.doc_id, []).append(r.draft)
    for i, text in texts.items():
        draft, want = "", []
        for part in text.split("\n"):
            want.append(draft)
            if part.strip():
                draft = (f"{draft}\n\n{part}" if draft else part).strip()[-40:].strip()
        assert got[i] == want, i

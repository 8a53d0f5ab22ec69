from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.oracle import SF, connect, differences


def test_stages_work_on_each_other(spark):
    from antigen.llm.common import checkpoint

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = checkpoint(stage(spark, docs, SF))
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == columns
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] <= counts[2]
    assert docs.where(F.size("ids") != F.col("n_tokens")).count() == 0
    assert set(docs.columns) == {"doc_id", "lang", "source", "n_tokens", "ids"}


def test_the_near_copy_stage_goes_by_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"x{i}" for i in range(60))
    rows = [(1, base, "en", "s", 0), (2, base + " more", "en", "s", 0), (2, other, "de", "s", 0), (3, None, None, None, None), (4, "", "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.lang) for r in dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, SF).where("doc_id < 3").collect())
    assert got == [(1, "en"), (2, "de")]


def test_stages_take_nulls(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 3), (1, "", None, "s", None), (2, "some few words here", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == {"mixing": 1}.get(name, 4), name


def test_stages_take_empty_tables(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_registry_names_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_sql_twins(spark, name):
    con: duckdb.DuckDBPyConnection = connect()
    assert not differences(entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df())

"""Every query runs; those with a SQL twin equal it."""

from __future__ import annotations

import pytest

from antigen.operators import features
from antigen.plans import registry, views
from tests.oracle import SF, connect, differences


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in registry.ORACLES:
        assert not differences(got, con.execute(registry.ORACLES[name]).df())


def test_mi_knn_uses_all_rows_and_features(spark, monkeypatch):
    seen = []
    whole = features.knn_information
    monkeypatch.setattr(features, "knn_information", lambda long, k=3: (seen.append(long), whole(long, k))[1])
    got = {r.feature for r in registry.QUERIES["mi_knn"](spark, SF).collect()}
    rows = views.flows(spark, SF).count()
    assert got == set(views.FEATURES) and {r["count"] for r in seen[0].groupBy("feature").count().collect()} == {rows}


def test_mrmr_ranks_all_features(spark):
    got = registry.QUERIES["mrmr"](spark, SF).collect()
    assert {r.feature for r in got} == set(views.FEATURES) and sorted(r["rank"] for r in got) == list(range(1, 13))


def test_the_entry_stands_without_the_text_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/antigen", tmp_path / "antigen", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})

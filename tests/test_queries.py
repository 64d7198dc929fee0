"""Every query against its SQL on the small tables, and the contract of the entry module."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from conftest import ROOT, TINY

from gapwright.plans.catalogue import ORACLE_SQL, QUERIES
from gapwright.plans.oracle import TYPES
from gapwright.functions import taxonomy

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    got, want = QUERIES[name](spark, TINY).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[columns].values.tolist()))
    assert rows(got) == rows(want)
    assert len(got) > 0


def test_names_agree():
    assert set(ORACLE_SQL) <= set(QUERIES) and TYPES == taxonomy.TYPES


def test_packages(spark):
    rows = QUERIES["evidence_package"](spark, TINY).collect()
    assert len(rows) == 15 and all(len(r.q) == 10 for r in rows)
    for r in rows:
        s = r.summary
        assert s.anomaly_count == len(r.evidence) == r.q[0]
        assert [(e.start, e.end) for e in r.evidence] == sorted((e.start, e.end) for e in r.evidence)
        if r.evidence:
            assert s.continuity_degree + s.fragmentation_degree == pytest.approx(1)
            assert s.max_confidence == max(e.confidence for e in r.evidence)


def test_one_exchange_serves_stacked_windows(spark):
    from gapwright.operators import scaling
    from gapwright.sources.testdata import points

    df = scaling.first_difference(scaling.local_zscore(scaling.zscore(points(spark, TINY))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_need_no_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, check=True).stdout.split()


def test_the_rest_stands_alone(tmp_path):
    for name in ("gapwright", "__spark_entry__.py"):
        source = Path(ROOT, name)
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'zscore' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_network_epoch(spark):
    row = QUERIES["network_epoch"](spark, TINY).head()
    assert row.steps == 1 and row.val_bc == 0.0 and row.train_loss > row.train_point > 0

import glob
import os

import pytest

import __spark_entry__
from siltstone.functions.sizes import level_limit
from siltstone.operators.compaction import SizeTiered
from siltstone.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(pdf, columns):
    pdf = pdf[columns].astype(object)
    return sorted(map(repr, pdf.where(pdf.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalogue.ORACLE_SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert norm(got, columns) == norm(want, columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_limits():
    assert [level_limit(i, 2048, 2) for i in range(5)] == [2048, 4096, 8192, 12288, 16384]
    assert [SizeTiered(10, 3, "geometric").limit(i) for i in range(3)] == [10, 30, 90]


@pytest.mark.parametrize("left", ["nothing", "caches"])
def test_entry_without_the_training_data_part(tmp_path, left):
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copy(__spark_entry__.__file__, tmp_path)
    shutil.copytree(f"{here}/siltstone", tmp_path / "siltstone", ignore=shutil.ignore_patterns("llm"))
    if left == "caches":
        (tmp_path / "siltstone/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; n = set(e.queries()); assert n and set(e.oracle_sql()) <= n; assert not any(x.startswith('op') and x[2].isdigit() for x in n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)

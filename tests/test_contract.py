import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, plain

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 2


@pytest.mark.parametrize("name", ["st1_union_calendar", "ag14_equal_weight_returns", "rn1_vol_target_scalar", "sg7_low_volatility_60",
                                  "qa10_report", "jn2_as_of_period", "jn9_reconcile_orders", "sc7_news_signal"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = contract.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(contract.oracle_sql()[name])
    at = [[c[0] for c in cur.description].index(c) for c in cols]
    theirs = sorted("|".join(plain(r[i]) for i in at) for r in cur.fetchall())
    assert sorted("|".join(plain(r[c]) for c in cols) for r in df.collect()) == theirs


def test_the_rest_works_without_the_removable_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(contract.__file__).parent
    shutil.copytree(root / "barquet", tmp_path / "barquet", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    from barquet.plans import catalog

    assert said.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES))]
    (tmp_path / "barquet" / "llm" / "__pycache__").mkdir(parents=True)
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True).returncode == 0

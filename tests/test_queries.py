"""Every registered query against its SQL."""

import pathlib
import subprocess
import sys

import pytest
from compare import differences

import __spark_entry__ as contract

ORACLE = contract.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(contract.queries()[name](spark, sf_dir), ORACLE[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(ORACLE)))
def test_query_without_sql_returns_rows(spark, small_dir, name):
    assert contract.queries()[name](spark, small_dir).count() > 0


def test_entry(spark):
    df = contract.entry(spark)
    assert set(df.columns) == {"year_month", "location", "median_price_per_sqft", "observations"}
    assert df.count() > 0


def test_entry_without_a_module_of_other_makers():
    """The queries for training data need more modules than the others; without one the rest still registers."""
    script = ("import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; "
              "print(len(e.queries()) > 70, any(n.startswith('op') and n[2].isdigit() for n in e.queries()))")
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", script], cwd=pathlib.Path(contract.__file__).parent,
                          capture_output=True, text=True, timeout=120, check=False)
    assert done.stdout.split() == ["True", "False"], done.stderr[-1000:]

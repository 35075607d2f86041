"""Every registered query of the study engine against its oracle."""

import compare
import pytest

from cohortloom import registry

ONLY_ROWS = sorted(set(registry.QUERIES) - set(registry.ORACLES))


@pytest.fixture(scope="module")
def db(request):
    from conftest import DATA

    return compare.connect(DATA)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, data, db, name):
    got, want = compare.spark_rows(registry.QUERIES[name](spark, data)), compare.oracle_rows(db, registry.ORACLES[name])
    assert got.columns == want.columns
    assert not got.differences(want)


@pytest.mark.parametrize("name", ONLY_ROWS)
def test_rows(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0

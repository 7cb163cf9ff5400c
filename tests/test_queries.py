import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import compare  # noqa: E402

from tidemark import queries  # noqa: E402
from tidemark.sources import panels  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return compare.connect(compare.SF)


@pytest.fixture(autouse=True, scope="module")
def kept_panels(spark, tmp_path_factory):
    """Derives the quarterly panels once for all tests of this module."""
    real = panels.quarterly_outturns, panels.quarterly_forecasts
    at = tmp_path_factory.mktemp("panels")

    def kept(name, df):
        path = f"{at}/{name}"
        if not os.path.isdir(path):
            df().write.parquet(path)
        return spark.read.parquet(path)

    panels.quarterly_outturns = lambda s, d: kept("outturns-" + os.path.basename(d), lambda: real[0](s, d))
    panels.quarterly_forecasts = lambda o: kept("forecasts-" + os.path.basename(o.inputFiles()[0].split("/outturns-")[1].split("/")[0]), lambda: real[1](o))
    yield
    panels.quarterly_outturns, panels.quarterly_forecasts = real


def test_panels_are_derived(spark, con):
    """The kept panels of the other tests are what the library derives."""
    own = panels.quarterly_forecasts(panels.quarterly_outturns(spark, compare.SF))
    assert own.count() == con.execute("with" + queries.OUTT + queries.FC + " select count(*) from fc").fetchone()[0]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    assert not compare.differences(spark, con, compare.SF, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert queries.queries()[name](spark, "/root/testdata/sf0.001").count() > 0

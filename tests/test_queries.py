"""Every query of the engine against its SQL, or that it runs."""

import pytest

from tests.oracle import duck, same
from weirflow.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert same(spark, con, QUERIES[name], ORACLES[name], SF) == ""
    else:
        assert QUERIES[name](spark, SF).count() > 0

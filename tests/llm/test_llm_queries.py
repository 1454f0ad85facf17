"""Every query of the subpackage, against its SQL where there is one."""

import pytest
from oracle import same, views

from lodestack.llm.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return views()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert same(spark, con, QUERIES[name])

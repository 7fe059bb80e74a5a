"""Every registered engine query against its oracle, and the driver's entry."""

import os

import pytest

import __spark_entry__
from lamina import catalog
from tests.oracle import SMALL, connect, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_sql(spark, name):
    same(connect(SMALL), catalog.oracle_sql()[name], catalog.queries()[name](spark, SMALL))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 12
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

import pytest

from verification.compare import differences
from verification.oracles import oracles
from verification.queries import registry

SF = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle():
    assert set(registry()) == set(oracles())


@pytest.mark.parametrize("name", list(registry()))
def test_query_matches_oracle(spark, name):
    assert differences(registry()[name](spark, SF), oracles()[name], SF) is None


def test_entry_runs(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0

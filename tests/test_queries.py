import pytest

from millrace.plans.queries import ORACLES, QUERIES
from oracle import same

SF = "/root/testdata/sf0.001"
MAY_BE_EMPTY = {"late_events", "rollup_diff_none"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, name):
    assert same(spark, name, QUERIES[name], ORACLES[name], SF) or name in MAY_BE_EMPTY

"""Every numbered query against its SQL twin on whole small tables."""

import pytest
from tests_llm_path import SF

from skyfold.llm.queries import ORACLES, QUERIES
from workload.check import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == ""


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))

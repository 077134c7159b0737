"""Shape of the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from skyfold.operators import filters, ranks, sampling
import workload.all  # noqa: F401  (registers every query)
from workload.merging import merged
from workload.standin import QUERIES, ORACLES
from workload.check import TABLES, compare, connect

from suite_paths import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(tables):
    df = filters.range_filters(tables.raw("orders"), {"o_totalprice": [1e5, 2e5]}).select("o_orderkey")
    text = plan(df)
    assert "GreaterThanOrEqual(o_totalprice,100000.0)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text
    assert "NotEqualTo" in plan(filters.require_features(tables.raw("orders"), ["o_totalprice"]).select("o_orderkey")) \
        or "Not(EqualTo(o_totalprice,-999.0))" in plan(filters.require_features(tables.raw("orders"), ["o_totalprice"]).select("o_orderkey"))


def test_merge_has_only_keyed_joins(tables):
    text = plan(merged(tables))
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name", ["w1_empirical_cdf", "a7_uncertainty_statistics", "w3_stratified_split", "a23_pit_histogram", "a14_comparison_metrics"])
def test_no_keyless_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_split_shuffles_no_rows(tables):
    text = plan(sampling.split(tables.catalog.select("source_id", "model_type"), strata=["model_type"]))
    assert "hashpartitioning" not in text and "BroadcastHashJoin" in text


def test_row_windows_are_partitioned(tables):
    text = plan(ranks.running_sums(tables.catalog, "g").groupBy().agg(F.max("n_before")))
    rows = [w for w in re.findall(r"Window \[.*", text) if "_first" not in w and "_next" not in w]
    assert all("_bucket" in w for w in rows)


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, name):
    assert compare(QUERIES[name](spark, SF), duck, ORACLES[name]) == ""


def test_every_query_is_named_once():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0

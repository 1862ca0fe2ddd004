"""A cross-section of the registered queries against their SQL."""

import pytest

import __spark_entry__ as entry
import checker

NAMES = [
    "scan_json_records", "context_z", "rca_explanation", "slice_threshold_join", "recommendation_join", "corr_prune", "feature_power",
    "threshold_matrix", "constrained_best", "dataset_partition_rank", "top_drivers", "inject_fault", "chunk_fixed", "retrieve_shape",
]


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, name):
    assert checker.compare(entry.queries()[name](spark, sf_dir), sf_dir, entry.oracle_sql()[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 8

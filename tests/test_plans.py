"""Plan properties of the registered queries (the scale audit as a test):
no cartesian / nested-loop joins, and Parquet scans read only needed columns."""

import re

import pytest

import __spark_entry__ as E

# queries that run jobs while being defined (model fits, k-NN batches, streams)
EAGER = {"stacking", "cv_search", "permutation_importance", "feature_importance", "corr_prune", "logreg_fit_score",
         "gbt_fit_score", "pca_variance", "vif_table", "stream_daily_agg", "knn_score", "knn_neighbors",
         "loo_attribution", "local_surrogate", "classifier_zoo", "selective_rows", "regressor_zoo", "subset_cv",
         "stream_sliding", "stream_weekend_roll", "stream_availability", "stream_ffill"}
# run jobs too, and are covered by tests of their own
EAGER |= {n for n in E.queries() if n == "pipeline" or re.match(r"op\d+_", n)}
SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in E.queries() if n not in EAGER))
def test_no_cross_joins(spark, name):
    plan = _plan(spark, name)
    assert not re.search(r"BroadcastNestedLoopJoin|CartesianProduct", plan), name


@pytest.mark.parametrize("name,table,allowed", [
    ("daily_panel", "orders", {"o_totalprice", "o_orderdate", "o_orderpriority"}),
    ("asof_join", "lineitem", {"l_quantity", "l_shipdate"}),
    ("json_extract_agg", "events", {"event_type", "props"}),
    ("roc_auc", "orders", {"o_orderkey", "o_orderstatus", "o_orderdate"}),
])
def test_column_pruning(spark, name, table, allowed):
    plan = _plan(spark, name)
    scans = [s for s in re.findall(r"FileScan parquet [^\n]*", plan) if f"/{table}.parquet" in s]
    assert scans
    for s in scans:
        cols = set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<([^>]*)>", s).group(1)))
        assert cols <= allowed, (name, cols)


def test_filter_pushdown(spark):
    plan = _plan(spark, "incremental_anti_join")
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(ts", plan)

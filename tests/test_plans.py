"""Physical-plan guards: shuffle counts of the station pipeline, no cartesian products."""

import re

import pytest

import __spark_entry__ as E
from fluvio.queries import QUERIES

SIDE_EFFECTS = {"train_eval", "train_legacy", "score_requests", "model_status", "stream_score", "stream_served", "stream_lags",
                "stream_obs_filter", "csv_scan", "scored_series", "export_tables", "json_records", "json_requests"}
OWN = [n for n in sorted(E.queries()) if n in set(QUERIES) - SIDE_EFFECTS]


def _scans(plan, table):
    return len(re.findall(rf"FileScan parquet [^\n]*{table}\.parquet", plan))


@pytest.mark.parametrize("name,table", [("impute_train_mean", "lineitem"), ("geo_quality", "events"), ("station_skill", "lineitem")])
def test_facts_are_scanned_once(spark, sf_small, name, table):
    assert _scans(_plan(spark, name, sf_small), table) == 1


def test_stored_panel_spreads_a_year(spark, sf_small, tmp_path):
    from fluvio.sources import panel as P
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        P.write_station_month(P.station_month(spark, sf_small).where("year = 1997"), str(tmp_path / "p"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(list((tmp_path / "p" / "year=1997").glob("*.parquet"))) > 1


def _plan(spark, name, sf):
    prev = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return E.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", prev)


def _shuffles(plan):
    return len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", plan))


@pytest.mark.parametrize("name", ["station_skill", "scale_search", "standardize", "coverage_last24", "mad_sigma"])
def test_station_pipeline_uses_one_station_exchange(spark, sf_small, name):
    plan = _plan(spark, name, sf_small)
    assert _shuffles(plan) == 2, plan  # partial aggregate of lineitem + the station exchange
    assert "Join" not in plan


def test_panel_scan_prunes_columns(spark, sf_small):
    df = E.queries()["station_skill"](spark, sf_small)
    mode = spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    assert "l_orderkey" not in plan and "l_returnflag" not in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_quantity:double," \
           "l_extendedprice:double,l_discount:double,l_tax:double,l_shipdate:timestamp_ntz>" in plan


@pytest.mark.parametrize("name", OWN)
def test_no_cartesian_or_nested_loop(spark, sf_small, name):
    plan = _plan(spark, name, sf_small)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_year_filter_prunes_stored_panel(spark, sf_small, tmp_path):
    from pyspark.sql import functions as F

    from fluvio.sources import panel as P
    path = str(tmp_path / "panel")
    P.write_station_month(P.station_month(spark, sf_small), path)
    q = P.read_station_month_parquet(spark, path).where(F.col("year") >= 2000).select("station_id", "month")
    mode = spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = q._jdf.queryExecution().explainString(mode)
    assert "PartitionFilters: [isnotnull(year" in plan and "(year" in plan and ">= 2000" in plan

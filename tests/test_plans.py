"""Physical-plan guards over every registered batch query: no cartesian or
nested-loop joins, no row-at-a-time Python UDFs, and column pruning reaches
the Parquet scans of the fact table."""

import __spark_entry__ as E
from tests.conftest import SF_SMALL

STREAMING_OR_WRITING = {"stream_source", "stream_prep", "stream_step_metrics", "stream_running_delta",
                        "stream_per_prompt_stats", "write_splits", "csv_exchange"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_or_row_udf(spark):
    bad = {}
    for name, fn in E.queries().items():
        if name in STREAMING_OR_WRITING:
            continue
        p = _plan(fn(spark, SF_SMALL))
        hits = [k for k in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if k in p]
        if hits:
            bad[name] = hits
    assert not bad, bad


def test_lineitem_scans_are_pruned(spark):
    p = _plan(E.queries()["cpo_loss"](spark, SF_SMALL))
    scans = [line for line in p.split("\n") if "lineitem" in line and "ReadSchema" in line]
    assert scans and all("l_shipdate" not in s and "l_extendedprice" not in s for s in scans)

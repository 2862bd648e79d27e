"""Driver contract: entry runs on sf0.001; every oracle belongs to a query."""

import __spark_entry__ as E


def test_entry_report(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert {r.model for r in rows} == {"half", "echo", "mix"}
    assert all(0.0 <= r.bleu <= 1.0 and 0.0 <= r.rouge_l <= 1.0 for r in rows)


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 90


def test_package_is_shipped(spark):
    import zipfile

    from tunelake import session

    session._SHIPPED.discard(spark.sparkContext.applicationId)
    session.ship_package(spark)
    files = [f for f in spark.sparkContext.listFiles if f.endswith("tunelake.zip")]
    assert files
    names = zipfile.ZipFile(files[-1].replace("file:", "")).namelist()
    assert "tunelake/functions/order.py" in names and "tunelake/streaming/jobs.py" in names

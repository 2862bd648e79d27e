"""Sources and sinks: CSV round trip of awkward strings, profile counts,
named eval sets keep their key."""

from pyspark.sql import types as T

from tunelake.session import scratch_path
from tunelake.sources import io

AWKWARD = ['plain', 'with "quotes" inside', 'back\\slash', 'ends with backslash\\', '\\"mixed\\"',
           'multi\nline\r\ntext', '', 'comma, separated', "tab\there"]


def test_csv_round_trip(spark):
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("text", T.StringType())])
    rows = [(i, s) for i, s in enumerate(AWKWARD)] + [(len(AWKWARD), None)]
    df = spark.createDataFrame(rows, schema)
    path = io.write_csv_table(df, scratch_path(spark, "t-csv"))
    back = {r.row_id: r.text for r in io.read_csv_table(spark, path, schema).collect()}
    want = dict(rows)
    want[len(AWKWARD)] = ""  # quoteAll writes null as an empty quoted field
    assert back == want


def test_profile_counts(spark):
    df = spark.createDataFrame([("a", 1), (" ", None), (None, 3)], "s string, n long")
    r = io.profile_dataset(df).collect()[0]
    assert (r.n_rows, r.s_nulls, r.s_blank, r.n_nulls, r.s_max_len) == (3, 1, 1, 1, 1)


def test_named_eval_sets(spark):
    a = spark.createDataFrame([(1,)], ["row_id"])
    b = spark.createDataFrame([(2,), (3,)], ["row_id"])
    out = io.named_eval_sets({"dev": a, "test": b}).collect()
    assert sorted((r.eval_name, r.row_id) for r in out) == [("dev", 1), ("test", 2), ("test", 3)]

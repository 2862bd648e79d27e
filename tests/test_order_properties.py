"""Property test: the distributed (two-pass) order paths equal pandas on
generated data - random group sizes including a dominant group, random
partition counts."""

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tunelake.functions.order import next_in_order, prefix_offsets


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sizes=st.lists(st.integers(min_value=1, max_value=60), min_size=1, max_size=8),
       hot=st.integers(min_value=0, max_value=400), parts=st.integers(min_value=1, max_value=12))
def test_two_pass_paths_equal_pandas(spark, sizes, hot, parts):
    rows = [(g, o * 3, float(o % 5)) for g, n in enumerate(sizes) for o in range(n)]
    rows += [(99, o * 2, 1.0) for o in range(hot)]  # a group that may dominate the table
    df = spark.createDataFrame(rows, "g long, o long, v double").repartition(3)
    pdf = pd.DataFrame(rows, columns=["g", "o", "v"]).sort_values(["g", "o"])
    pdf["next"] = pdf.groupby("g")["o"].shift(-1)
    pdf["off"] = pdf.groupby("g")["v"].cumsum() - pdf["v"]

    nxt = next_in_order(df, "o", ["g"], num_partitions=parts).toPandas().merge(pdf, on=["g", "o"])
    assert len(nxt) == len(rows)
    assert ((nxt["next_o"].isna() & nxt["next"].isna()) | (nxt["next_o"] == nxt["next"])).all()

    off = prefix_offsets(df, ["o"], "v", offset_col="got", part_cols=["g"], num_partitions=parts,
                         value_type="double").toPandas().merge(pdf, on=["g", "o"])
    assert len(off) == len(rows) and (abs(off["got"] - off["off"]) < 1e-9).all()

"""The order helpers against brute force, with a hot key holding a third of
the rows and more partitions than keys."""

import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tunelake.functions import order
from tunelake.functions.order import hash_rank, next_in_order, prefix_offsets, with_next_values


def _rows(n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = 0 if i % 3 == 0 else rnd.randint(1, 40)  # group 0 holds a third of all rows
        rows.append((g, i * 7 + rnd.randint(0, 3), float(rnd.randint(0, 9)) / 4))
    return rows


def test_hash_rank_matches_sort(spark):
    df = spark.range(0, 2000).withColumnRenamed("id", "row_id").repartition(13)
    got = {r.row_id: r.rank for r in hash_rank(df, "row_id", seed=42).collect()}
    order = sorted(range(2000), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert got == {rid: k for k, rid in enumerate(order)}


def test_hash_rank_partitioned(spark):
    df = spark.createDataFrame([(g, i) for g in range(3) for i in range(300)], ["g", "row_id"])
    out = hash_rank(df, "row_id", part_cols=["g"]).toPandas()
    for g, part in out.groupby("g"):
        assert sorted(part["rank"]) == list(range(len(part)))


def test_next_in_order_hot_group(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, ["g", "o", "v"]).repartition(5)
    got = next_in_order(df, "o", ["g"], num_partitions=16).toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "o", "v"]).sort_values(["g", "o"])
    pdf["want"] = pdf.groupby("g")["o"].shift(-1)
    m = got.merge(pdf, on=["g", "o"])
    assert len(m) == len(rows)
    assert ((m["next_o"].isna() & m["want"].isna()) | (m["next_o"] == m["want"])).all()


def test_next_in_order_global_and_values(spark):
    rows = [(i * 3, f"t{i}") for i in range(500)]
    df = spark.createDataFrame(rows, ["k", "txt"]).repartition(7)
    out = with_next_values(df, "k", ["txt"]).toPandas().set_index("k")
    for i in range(499):
        assert out.loc[i * 3, "next_txt"] == f"t{i + 1}"
    assert pd.isna(out.loc[499 * 3, "next_txt"])


def test_prefix_offsets_groups_and_doubles(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, ["g", "o", "v"]).repartition(3)
    got = prefix_offsets(df, ["o"], "v", offset_col="off", part_cols=["g"], num_partitions=16,
                         value_type="double").toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "o", "v"]).sort_values(["g", "o"])
    pdf["want"] = pdf.groupby("g")["v"].cumsum() - pdf["v"]
    m = got.merge(pdf, on=["g", "o"])
    assert len(m) == len(rows)
    assert (abs(m["off"] - m["want"]) < 1e-9).all()


def test_prefix_offsets_row_number(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("o"))
    got = prefix_offsets(df, ["o"], None, offset_col="rn", num_partitions=9).toPandas()
    assert (got["rn"] == got["o"]).all()


def test_null_groups_and_repeated_keys_as_with_a_window(spark):
    from tunelake.functions.order import with_row_number

    rows = [(None, 1, "a"), (None, 2, "b"), (1, 5, "c"), (1, 5, "d"), (1, 7, None), (2, 1, "e")]
    df = spark.createDataFrame(rows, "g long, o long, v string")
    for parts in (1, 3, 8):
        nxt = with_next_values(df, "o", ["v"], ["g"], num_partitions=parts).collect()
        assert len(nxt) == 6
        got = {r["v"]: r["next_v"] for r in nxt}
        assert got["a"] == "b" and got["b"] is None and got["e"] is None and got[None] is None
        assert {got["c"], got["d"]} in ({"c", None}, {"d", None})  # the tie in either order, then the null value
        num = with_row_number(df, ["o"], ["g"], out="rn", total_col="n", num_partitions=parts).collect()
        assert sorted((str(r["g"]), r["rn"], r["n"]) for r in num) == sorted(
            [("None", 0, 2), ("None", 1, 2), ("1", 0, 3), ("1", 1, 3), ("1", 2, 3), ("2", 0, 1)])
    ranks = hash_rank(df, "o", part_cols=["g"]).collect()
    assert sorted((str(r["g"]), r["rank"]) for r in ranks) == sorted(
        [("None", 0), ("None", 1), ("1", 0), ("1", 1), ("1", 2), ("2", 0)])


def test_right_without_exchange_reuse(spark):
    df = spark.range(0, 20000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o")).repartition(5)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        out = prefix_offsets(df, ["o"], None, offset_col="rn", part_cols=["g"], num_partitions=16)
        assert out.where(F.col("rn") != F.floor(F.col("o") / 3)).count() == 0 and out.count() == 20000
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_empty_table(spark):
    df = spark.createDataFrame([], "g long, o long, v string")
    assert with_next_values(df, "o", ["v"], ["g"]).collect() == []
    assert hash_rank(df, "o", total_col="n").collect() == []


@pytest.fixture()
def written(monkeypatch):
    """The columns of every table that the order helpers write."""
    seen = []
    monkeypatch.setattr(order, "materialize", lambda df, name, f=order.materialize: seen.append(set(df.columns)) or f(df, name))
    return seen


def test_epoch_plan_writes_neither_its_hash_nor_its_key(spark, written):
    import hashlib

    from tunelake.operators.split import epoch_batch_plan

    ids = [None if i == 7 else f"{i}:{i % 3}" for i in range(101)] + ["5:2"]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "k string, v long").repartition(5)
    got = epoch_batch_plan(spark, df, 3, 8, 4, 2, id_col="k").collect()
    assert written == [{"k", "v", "epoch", "_id"}]
    assert len(got) == 3 * 102
    for e in range(3):
        mine = sorted((r for r in got if r.epoch == e), key=lambda r: r.order_in_epoch)
        assert [r.order_in_epoch for r in mine] == list(range(102))
        digest = [hashlib.md5(f"42:{e}{'' if r.k is None else ':' + r.k}".encode()).hexdigest() for r in mine]
        assert digest == sorted(digest)
        assert sorted(r.v for r in mine) == list(range(102))
        assert all(r.batch_id == n // 8 and r.mini_batch_id == n % 8 // 4 and r.micro_batch_id == n % 4 // 2 for n, r in enumerate(mine))


def test_few_groups_are_numbered_like_many(spark):
    rows = [(g, (i * 37) % 101, i) for g in (None, "a", "b") for i in range(100 if g != "b" else 1)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(3)
    few, many = ({(r.g, r.o, r.v): (r.pos, r.n) for r in order.with_row_number(df, ["o", "v"], ["g"], total_col="n", num_partitions=6, few_groups=f).collect()}
                 for f in (True, False))
    assert few == many and len(few) == 201


def test_gae_writes_what_it_needs(spark, written):
    from tests.conftest import SF_SMALL
    from tunelake.plans.q_rollout import q_gae

    q_gae(spark, SF_SMALL)
    assert written[-1] == {"seq_id", "pos", "reward", "masked_val", "_d", "_rng"}


def test_long_views_cut_large_tables_into_more_tasks(spark, tmp_path, monkeypatch):
    from tunelake.sources import views

    monkeypatch.setattr(views, "TASK_ROWS", 20, raising=False)
    spark.range(500).selectExpr("id % 40 l_orderkey", "id l_linenumber", "id l_partkey", "id l_suppkey", "0.1D l_discount", "0.1D l_tax",
                                "1.0D l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(40).selectExpr("id o_orderkey", "100.0D o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    seq = views.Views(spark, str(tmp_path)).seq()
    assert seq.rdd.getNumPartitions() >= 25
    assert seq.count() == 500 and seq.agg({"pos": "max"}).first()[0] == 12

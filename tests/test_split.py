"""Split invariants: disjoint, covering, exact sizes, independent of the
input partitioning."""

import math


from tunelake.operators.split import (epoch_batch_plan, ratio_split_exact, ratio_split_hash,
                                      seeded_sample_n, shuffled_full_batches)


def test_exact_sizes_and_partition_independence(spark):
    n = 1237
    df = spark.range(0, n).withColumnRenamed("id", "row_id")
    a = {r.row_id: r.split for r in ratio_split_exact(df.repartition(1)).collect()}
    b = {r.row_id: r.split for r in ratio_split_exact(df.repartition(8)).collect()}
    assert a == b and len(a) == n
    held = math.ceil(n * 0.2)
    test = math.ceil(held * 0.5)
    counts = {k: sum(1 for v in a.values() if v == k) for k in ("train", "dev", "test")}
    assert counts == {"train": n - held, "dev": held - test, "test": test}


def test_sizes_follow_double_arithmetic(spark):
    # sizes are ceil(n * 0.2) and ceil(held * 0.5) in IEEE doubles
    for n in (1, 2, 15, 101):
        df = spark.range(0, n).withColumnRenamed("id", "row_id")
        got = {r.split: r["count"] for r in ratio_split_exact(df).groupBy("split").count().collect()}
        held = math.ceil(n * 0.2)
        test = math.ceil(held * 0.5)
        want = {k: v for k, v in {"train": n - held, "dev": held - test, "test": test}.items() if v}
        assert got == want


def test_hash_split_stable_under_append(spark):
    a = spark.range(0, 500).withColumnRenamed("id", "row_id")
    b = spark.range(0, 900).withColumnRenamed("id", "row_id")
    sa = {r.row_id: r.split for r in ratio_split_hash(a).collect()}
    sb = {r.row_id: r.split for r in ratio_split_hash(b).collect()}
    assert all(sb[k] == v for k, v in sa.items())


def test_sample_and_batches(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "row_id")
    s = seeded_sample_n(df, 50)
    assert s.count() == 50
    assert "TakeOrderedAndProject" in s._jdf.queryExecution().executedPlan().toString()
    fb = shuffled_full_batches(df, 64).toPandas()
    assert len(fb) == 960 and fb.groupby("batch_id").size().eq(64).all()
    plan = epoch_batch_plan(spark, df, 3, 128, 32, 8).toPandas()
    for e, part in plan.groupby("epoch"):
        assert sorted(part["order_in_epoch"]) == list(range(1000))
    p0 = plan[plan.epoch == 0].set_index("row_id")["order_in_epoch"]
    p1 = plan[plan.epoch == 1].set_index("row_id")["order_in_epoch"]
    assert (p0.sort_index().values != p1.sort_index().values).any()


def test_split_folder_read_is_pruned(spark):
    from tunelake.session import scratch_path
    from tunelake.sources.io import read_split, write_splits

    df = spark.range(0, 300).withColumnRenamed("id", "row_id")
    path = write_splits(ratio_split_exact(df), scratch_path(spark, "t-splits"))
    dev = read_split(spark, path, "dev")
    plan = dev._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "(split#" in plan
    assert dev.count() == 30 and {r.split for r in dev.collect()} == {"dev"}

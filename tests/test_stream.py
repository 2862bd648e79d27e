"""Streaming jobs on a caller's stream whose micro-batches cut training batches."""

import os

import shutil

import pytest
from pyspark.sql import functions as F

from tunelake.operators import rollout as G
from tunelake.sources.io import stream_source
from tunelake.streaming import jobs
from tunelake.streaming.partials import Partials

ROWS = [(i, i * 7 % 3, i // 20, float(i * 31 % 17)) for i in range(130)]
CUTS = [0, 13, 50, 55, 130]  # inside batches 0 and 2 (twice)


@pytest.fixture()
def stream(spark, tmp_path, request):
    cuts = getattr(request, "param", CUTS)
    df = spark.createDataFrame(ROWS, "event_id long, prompt_id long, batch_id long, reward double")
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = f"{tmp_path}/part{k}"
        df.where(F.col("event_id").between(a, b - 1)).coalesce(1).write.parquet(part)
        (name,) = [f for f in os.listdir(part) if f.endswith(".parquet")]
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.link(f"{part}/{name}", f"{tmp_path}/in/{k}.parquet")
        os.utime(f"{tmp_path}/in/{k}.parquet", (1000 + k, 1000 + k))
    return stream_source(spark, f"{tmp_path}/in", df.schema, max_files=1), df, str(tmp_path)


def equal_to_the_batch_operator(got, table, rows=ROWS):
    want = {r.event_id: r for r in G.advantage_per_prompt(table, buffer_size=8, min_count=10).collect()}
    assert sorted(r.event_id for r in got) == [r[0] for r in rows]
    assert all(r.used_prompt_stats == want[r.event_id].used_prompt_stats for r in got)
    assert all(r.advantage == pytest.approx(want[r.event_id].advantage, abs=1e-9) for r in got)


@pytest.mark.parametrize("stream", [[0, 13, 50, 55, 130], [0, 130], [0, 1, 20, 21, 99, 100, 128, 130]], indirect=True)
def test_prompt_statistics_do_not_depend_on_the_cut(spark, stream):
    rows, table, folder = stream
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.shuffle.partitions")
    got = jobs.per_prompt_stats(rows, buffer_size=8, min_count=10, state_path=f"{folder}/state")
    equal_to_the_batch_operator(got.collect(), table)
    assert (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.shuffle.partitions")) == before


def test_open_batches_wait_and_a_later_call_goes_on(spark, stream):
    rows, table, folder = stream
    late = f"{folder}/late"
    os.makedirs(late)
    shutil.move(f"{folder}/in/3.parquet", f"{late}/3.parquet")
    first = jobs.per_prompt_stats(rows, buffer_size=8, min_count=10, state_path=f"{folder}/state", finish=False)
    assert sorted(r.event_id for r in first.collect()) == list(range(40))  # batch 2 is open at row 55
    shutil.move(f"{late}/3.parquet", f"{folder}/in/3.parquet")
    done = jobs.per_prompt_stats(rows, buffer_size=8, min_count=10, state_path=f"{folder}/state")
    equal_to_the_batch_operator(done.collect(), table)


def test_state_session_leaves_the_callers_settings(spark):
    own = jobs.state_session(spark, 3)
    assert own.conf.get("spark.sql.shuffle.partitions") == "3" != spark.conf.get("spark.sql.shuffle.partitions")
    assert own.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")


def test_partials_stay_few_and_survive_a_stop(spark, tmp_path):
    def sums(df):
        return df.groupBy("k").agg(F.sum("s").alias("s"))

    kept, n = Partials(spark, f"{tmp_path}/p", sums, fold=3), 40
    assert kept.read() is None
    for b in range(n):
        if b == 30:
            shutil.copytree(f"{tmp_path}/p", f"{tmp_path}/before")
        kept.add(spark.createDataFrame([(b % 4, b), (7, 1)], "k long, s long"), b)
    want = {k: sum(b for b in range(n) if b % 4 == k) for k in range(4)} | {7: n}
    assert {r.k: r.s for r in kept.read().collect()} == want
    assert len(kept.ranges()) <= 2 * 4 and kept.ranges()[0] == (0, 26) and kept.ranges()[-1][1] == n - 1
    # stopped before the parts were deleted, in the middle of a writing, and with a batch that comes again
    for name in os.listdir(f"{tmp_path}/before"):
        if not os.path.exists(f"{tmp_path}/p/{name}"):
            shutil.copytree(f"{tmp_path}/before/{name}", f"{tmp_path}/p/{name}")
    os.makedirs(f"{tmp_path}/p/batches-0-99")
    again = Partials(spark, f"{tmp_path}/p", sums, fold=3)
    again.add(spark.createDataFrame([(3, n - 1), (7, 1)], "k long, s long"), n - 1)
    assert {r.k: r.s for r in again.read().collect()} == want


def test_step_means_and_running_delta_over_cuts(spark, stream):
    rows, _, folder = stream
    got = {r.log_step: r.loss for r in jobs.step_metrics(
        rows.select(F.col("event_id").alias("step"), F.col("reward").alias("loss")), 30, f"{folder}/steps").collect()}
    want = {e: round(sum(r[3] for r in ROWS[e - 29:e + 1]) / 30, 4) for e in (30, 60, 90, 120)}
    assert got == pytest.approx(want, abs=1e-4)
    got = {r.batch_id: r.delta for r in jobs.running_delta(rows.select("batch_id", "reward"), f"{folder}/delta").collect()}
    for b, delta in got.items():
        seen = [r[3] for r in ROWS if r[2] <= b]
        assert delta == pytest.approx(sum(seen) / len(seen))
    assert len(got) == 7


@pytest.mark.parametrize("files", [1, 3])
def test_tables_that_are_files_or_folders_are_read_whole(spark, tmp_path, files):
    conv = spark.createDataFrame([(i // 4, i % 4, "user", None if i == 5 else f" word{i} two ") for i in range(40)],
                                 "conv_id long, turn long, role string, text string")
    conv.repartition(files).write.parquet(f"{tmp_path}/{'written' if files == 1 else 'conversations.parquet'}")
    if files == 1:
        (name,) = [f for f in os.listdir(f"{tmp_path}/written") if f.endswith(".parquet")]
        shutil.copy(f"{tmp_path}/written/{name}", f"{tmp_path}/conversations.parquet")
    assert sorted(map(str, jobs.stream_source_copy(spark, str(tmp_path)).collect())) == sorted(map(str, conv.collect()))
    prepped = jobs.stream_prep(spark, str(tmp_path)).collect()
    assert len(prepped) == 40 and {r.n_tokens for r in prepped if r.text} == {2}
    conv.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert jobs.stream_prep(spark, f"{tmp_path}/none").count() == 0

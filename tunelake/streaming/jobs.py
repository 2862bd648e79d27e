"""Structured Streaming versions of the operators (S10, X1-X4).

* stateless prep (X1) runs the same column functions on a streaming
  DataFrame into an exactly-once file sink;
* ``step_metrics``, ``running_delta`` and ``per_prompt_stats`` take the
  caller's stream; the functions named ``stream_*`` feed them a table;
* step metrics (X2) and the running reward mean (X3) keep partial sums per
  micro-batch (``foreachBatch``), which are folded as they come
  (``partials.py``), so that a long stream keeps few files and a restart
  resumes from the checkpoint;
* per-prompt statistics (X4) use ``transformWithStateInPandas`` keyed by the
  prompt: the last 16 rewards, a count, and the rows of training batches that
  are still open; an event-time timer closes a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.expr import clean_text
from ..functions.order import prefix_offsets
from ..operators.split import ratio_split_hash
from ..operators.tokens import hashed_ids, ws_tokens
from ..session import scratch_path
from ..sources.io import run_available_now, stream_source
from .partials import Partials


def _stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream: one Parquet file, or a folder of them."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema  # metadata only
    if _status(spark, path).isDirectory():
        return stream_source(spark, path, schema)
    return stream_source(spark, sf_dir, schema, glob=f"{name}.parquet")


def _state_paths(spark: SparkSession, name: str, state_path: str | None):
    """(output folder, checkpoint folder). A given ``state_path`` makes a job
    resumable: a restart with the same path continues from its checkpoint
    and processes only new input."""
    if state_path:
        base = state_path.rstrip("/")
        return f"{base}/output", f"{base}/checkpoint"
    return scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")


def _drain(stream_df: DataFrame, name: str, state_path: str | None = None) -> DataFrame:
    out, ck = _state_paths(stream_df.sparkSession, name, state_path)
    run_available_now(stream_df, out, ck)
    return stream_df.sparkSession.read.schema(stream_df.schema).parquet(out)  # a stream without rows leaves no file to take it from


# -- S10 / X1 ---------------------------------------------------------------------------

def stream_source_copy(spark, sf_dir, name="conversations") -> DataFrame:
    """An unbounded source drained into a file sink and read back."""
    return _drain(_stream_table(spark, sf_dir, name), f"src-{name}")


def stream_prep(spark, sf_dir) -> DataFrame:
    """Stateless preparation on a stream: clean text, hashed token ids and
    their count, hash-bucket split (stable under appends)."""
    s = _stream_table(spark, sf_dir, "conversations")
    s = s.withColumn("row_key", F.col("conv_id") * 100 + F.col("turn"))
    prepped = ratio_split_hash(s.select("conv_id", "turn", "row_key", clean_text("text").alias("text")),
                               id_col="row_key")
    prepped = prepped.withColumn("n_tokens", F.size(hashed_ids(ws_tokens(F.col("text")))))
    return _drain(prepped.drop("row_key"), "prep")


# -- X2 ------------------------------------------------------------------------------------

def _into_partials(stream: DataFrame, aggregate, merge, name: str, state_path: str | None) -> Partials:
    """Drain a stream into folded partials."""
    path, ckpt = _state_paths(stream.sparkSession, name, state_path)
    kept = Partials(stream.sparkSession, path, merge)
    (stream.writeStream.foreachBatch(lambda df, batch: kept.add(aggregate(df), batch))
     .option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination())
    return kept


def step_metrics(losses: DataFrame, logging_steps=50, state_path: str | None = None) -> DataFrame:
    """Of a stream (step, loss) every ``logging_steps`` steps the mean loss
    since the last log, rounded to 4 places; nothing at step 0; a trailing
    incomplete window is not logged. Each micro-batch adds partial (sum,
    count) per log window, so a window may span micro-batches."""
    s = losses.where(F.col("step") >= 1).withColumn(
        "window_id", F.floor((F.col("step") - 1) / logging_steps).cast("bigint"))
    partials = _into_partials(
        s, lambda df: df.select("window_id", F.col("loss").alias("s"), F.lit(1).cast("bigint").alias("n"), F.col("step").cast("bigint").alias("max_step")),
        lambda df: df.groupBy("window_id").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("max_step").alias("max_step")),
        "stepmetrics", state_path).read()
    if partials is None:
        return losses.sparkSession.createDataFrame([], "log_step bigint, loss double")
    last = partials.agg(F.max("max_step")).first()[0]  # one number: the last step seen
    return (partials.withColumn("log_step", (F.col("window_id") + 1) * logging_steps)
            .where(F.col("log_step") <= F.lit(last))
            .select("log_step", F.round(F.col("s") / F.col("n"), 4).alias("loss")))


def stream_step_metrics(spark, sf_dir, logging_steps=50, state_path: str | None = None) -> DataFrame:
    """``step_metrics`` of the events table read as a stream."""
    s = _stream_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("step"), F.log(F.col("value") + 1).alias("loss"))
    return step_metrics(s, logging_steps, state_path)


# -- X3 ------------------------------------------------------------------------------------

def running_delta(rewards: DataFrame, state_path: str | None = None) -> DataFrame:
    """Of a stream (batch_id, reward) the running mean of all rewards up to
    and including each training batch (the BCO delta), across micro-batches:
    each micro-batch adds its per-batch (sum, count) partials; delta =
    cumulative sums in batch order (two-pass prefix sum), equal to the batch
    operator."""
    sums = _into_partials(
        rewards, lambda df: df.select("batch_id", F.col("reward").alias("_s"), F.col("reward").isNotNull().cast("bigint").alias("_n")),
        lambda df: df.groupBy("batch_id").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n")), "running-delta", state_path).read()
    if sums is None:
        return rewards.sparkSession.createDataFrame([], "batch_id bigint, delta double")
    cs = prefix_offsets(sums, ["batch_id"], "_s", offset_col="_cs", value_type="double").select("batch_id", "_s", "_cs")
    cn = prefix_offsets(sums, ["batch_id"], "_n", offset_col="_cn").select("batch_id", "_n", "_cn")
    return cs.join(cn, "batch_id").select(
        "batch_id", ((F.col("_cs") + F.col("_s")) / (F.col("_cn") + F.col("_n"))).alias("delta"))


def stream_running_delta(spark, sf_dir, beta=0.1, state_path: str | None = None) -> DataFrame:
    """``running_delta`` of the lineitem table read as a stream."""
    li = _stream_table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 100.0).cast("bigint").alias("batch_id"),
        (beta * (F.log(F.lit(0.05) + F.col("l_discount")) - F.log(F.lit(0.05) + F.col("l_tax")))).alias("reward"))
    return running_delta(li, state_path)


# -- X4 ------------------------------------------------------------------------------------

_X4_OUT = "event_id long, prompt_id long, batch_id long, reward double, prompt_mean double, prompt_std double, seen long"
#: Training batch b (from 0) has the event time 10 (b + 1) milliseconds, since a watermark starts at 0; the delay
#: keeps a batch open while its own rows come.
_STEP_MS, _DELAY_MS, _CLOSE_MS = 10, 5, 4
#: The batch id of the row that ends a stream; ids of batches are smaller (its event time, in 2261, is near the last that pandas holds).
_END = 921_000_000_000


def prompt_statistics(buffer_size: int) -> StatefulProcessor:
    """State of one prompt: its last rewards, how many it has had, and the rows of open training batches.
    A batch is closed when a later one has been seen, by whatever prompt; then its rows leave, in the order of
    their ids, with the statistics of the last ``buffer_size`` rewards up to its end.

    The class is local, so that it travels by value: Spark also starts it beside the driver, where the files
    shipped to executors are not on the path."""
    class PromptStatistics(StatefulProcessor):

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getListState("last", "reward double")
            self.seen = handle.getValueState("seen", "n long")
            self.open = handle.getListState("open", "batch_id long, event_id long, reward double")

        def handleInputRows(self, key, rows, timerValues):
            first = None
            for f in rows:
                f = f[f["event_id"].notna()]  # the row that ends the stream has none
                if len(f):
                    self.open.appendList([(int(b), int(e), float(r)) for b, e, r in zip(f["batch_id"], f["event_id"], f["reward"])])
                    first = min(int(f["batch_id"].min()), _END if first is None else first)
            if first is not None:
                self._wait(first)
            return iter([])

        def _wait(self, batch: int) -> None:
            """One timer, for the first open batch."""
            due, waiting = (batch + 1) * _STEP_MS + _CLOSE_MS, False
            for (t,) in ((t if isinstance(t, tuple) else (t,)) for t in self.handle.listTimers()):
                if t > due:
                    self.handle.deleteTimer(t)
                else:
                    waiting = True
            if not waiting:
                self.handle.registerTimer(due)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import numpy as np
            import pandas as pd

            closed_to = timerValues.getCurrentWatermarkInMs() - _CLOSE_MS
            rows = sorted((tuple(r) for r in self.open.get()), key=lambda r: r[:2])
            closed = [r for r in rows if (r[0] + 1) * _STEP_MS <= closed_to]
            rest = rows[len(closed):]
            if rest:
                self.open.put(rest)
                self.handle.registerTimer((rest[0][0] + 1) * _STEP_MS + _CLOSE_MS)
            else:
                self.open.clear()
            if not closed:
                return
            batch, event, reward = (np.array(c) for c in zip(*closed))
            last = np.array([r[0] for r in self.last.get()] if self.last.exists() else [], dtype="float64")
            seen = int(self.seen.get()[0]) if self.seen.exists() else 0
            history = np.concatenate([last, reward])
            ends = np.flatnonzero(np.r_[batch[1:] != batch[:-1], True]) + 1
            windows = [history[max(0, e + len(last) - buffer_size):e + len(last)] for e in ends]
            size = np.diff(np.r_[0, ends])
            self.last.put([(float(r),) for r in history[-buffer_size:]])
            self.seen.update((seen + len(closed),))
            yield pd.DataFrame({"event_id": event, "prompt_id": key[0], "batch_id": batch, "reward": reward,
                                "prompt_mean": np.repeat([w.mean() for w in windows], size),
                                "prompt_std": np.repeat([w.std() for w in windows], size),
                                "seen": np.repeat(seen + ends, size)})

    return PromptStatistics()


def state_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session of the same application for streams with state: it has the RocksDB state store that timers and
    list states need, and its own number of state partitions (by default one per core, since each has a fixed
    start-up cost). The caller's settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass",
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")  # a micro-batch commits its changes only
    own.conf.set("spark.sql.shuffle.partitions", str(state_partitions or spark.sparkContext.defaultParallelism))
    return own


def per_prompt_stats(rewards: DataFrame, buffer_size=16, min_count=16, state_path: str | None = None, finish: bool = True,
                     reader: SparkSession | None = None) -> DataFrame:
    """Per-prompt statistics of a stream (event_id, prompt_id, batch_id,
    reward) with streaming state (``prompt_statistics``), then the advantage:
    the prompt's own statistics once it has ``min_count`` rewards, else the
    batch's global ones (an aggregate over the sink output).

    Training batches come in their order and may be cut by micro-batches
    anywhere; a row of a batch that has been closed is late and is dropped, as
    by any watermark. The last batch is closed by ``finish``, which ends the
    stream for good; without it the batch stays open, and a later call with
    the same ``state_path`` goes on. The stream's session needs the RocksDB
    state store (``state_session``); ``reader`` reads the result."""
    from ..session import ship_package

    spark = rewards.sparkSession
    ship_package(spark)
    out, checkpoint = _state_paths(spark, "per-prompt", state_path)
    end = f"{out}-end"
    rows = rewards.select(F.col("event_id").cast("bigint").alias("event_id"), F.col("prompt_id").cast("bigint").alias("prompt_id"),
                          F.col("batch_id").cast("bigint").alias("batch_id"), F.col("reward").cast("double").alias("reward"))
    nothing = spark.createDataFrame([], rows.schema)
    if not _exists(spark, end):
        nothing.write.parquet(end)
    ends = stream_source(spark, end, rows.schema)
    timed = (rows.unionByName(ends).withColumn("at", F.timestamp_millis((F.col("batch_id") + 1) * _STEP_MS))
             .withWatermark("at", f"{_DELAY_MS} milliseconds"))
    stats = timed.groupBy("prompt_id").transformWithStateInPandas(prompt_statistics(buffer_size), _X4_OUT, "Append", "EventTime")
    run_available_now(stats, out, checkpoint)
    if finish:
        spark.range(1).select(*[(F.lit(_END) if f.name == "batch_id" else F.lit(None)).cast(f.dataType).alias(f.name)
                                for f in rows.schema.fields]).write.mode("append").parquet(end)
        run_available_now(stats, out, checkpoint)
    done = (reader or spark).read.schema(_X4_OUT).parquet(out)
    glob = done.groupBy("batch_id").agg(F.avg("reward").alias("_gm"), F.stddev_pop("reward").alias("_gs"))
    j = done.join(glob, "batch_id")
    own = F.col("seen") >= min_count
    mean = F.when(own, F.col("prompt_mean")).otherwise(F.col("_gm"))
    std = F.when(own, F.col("prompt_std")).otherwise(F.col("_gs")) + 1e-6
    return j.select("event_id", ((F.col("reward") - mean) / std).alias("advantage"),
                    own.alias("used_prompt_stats"))


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def _status(spark: SparkSession, path: str):
    fs, p = _file_system(spark, path)
    return fs.getFileStatus(p)


def stream_per_prompt_stats(spark, sf_dir, buffer_size=16, min_count=16, batch_events=1000,
                            state_path: str | None = None, state_partitions: int | None = None) -> DataFrame:
    """``per_prompt_stats`` of the events table read as a stream."""
    ev = _stream_table(state_session(spark, state_partitions), sf_dir, "events").select(
        "event_id", F.col("user_id").alias("prompt_id"),
        F.floor(F.col("event_id") / batch_events).cast("bigint").alias("batch_id"),
        F.log(F.col("value") + 1).alias("reward"))
    return per_prompt_stats(ev, buffer_size, min_count, state_path, reader=spark)

"""Splits, sampling and batching (T*). All randomness is a seeded md5 of the
row id, so results do not depend on partitioning or on re-execution after an
executor loss."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import hex8_to_long, seeded_md5
from ..functions.order import hash_rank, with_row_number


def ratio_split_exact(df: DataFrame, id_col: str = "row_id", seed=42,
                      ratios=(0.8, 0.1, 0.1), split_col: str = "split") -> DataFrame:
    """train/dev/test with exact sizes: held-out = ceil(n * (dev+test)),
    test = ceil(held * test/(dev+test)) (IEEE doubles, as the two-stage
    split computes them), dev = the rest. Order = (md5(seed:id), id)."""
    tr, dv, te = ratios
    if abs(tr + dv + te - 1.0) > 1e-9:
        raise ValueError("ratios must sum to 1")
    held_frac = dv + te
    test_frac = te / held_frac
    ranked = hash_rank(df, id_col, seed=seed, rank_col="_rank", total_col="_total")
    held = F.ceil(F.col("_total").cast("double") * F.lit(held_frac))
    test = F.ceil(held.cast("double") * F.lit(test_frac))
    n_train = F.col("_total") - held
    n_dev = held - test
    split = (F.when(F.col("_rank") < n_train, "train")
             .when(F.col("_rank") < n_train + n_dev, "dev").otherwise("test"))
    return ranked.withColumn(split_col, split).drop("_rank", "_total")


def split_counts(split_df: DataFrame, split_col: str = "split") -> DataFrame:
    return split_df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"))


def ratio_split_hash(df: DataFrame, id_col: str = "row_id", seed=42,
                     ratios=(0.8, 0.1, 0.1), split_col: str = "split",
                     buckets: int = 1000) -> DataFrame:
    """Per-row split decision from the hash bucket of the id: stable under
    appends and usable on streams."""
    tr, dv, _ = ratios
    b = hex8_to_long(seeded_md5(seed, id_col)) % F.lit(buckets)
    cut1, cut2 = round(tr * buckets), round((tr + dv) * buckets)
    return df.withColumn("bucket", b).withColumn(
        split_col, F.when(F.col("bucket") < cut1, "train")
        .when(F.col("bucket") < cut2, "dev").otherwise("test"))


def seeded_sample_n(df: DataFrame, n: int, id_col: str = "row_id", seed=42,
                    where=None) -> DataFrame:
    """``shuffle(seed).select(range(n))``: first n rows in (md5(seed:id), id)
    order, planned as TakeOrderedAndProject (per-task top-n, no full sort)."""
    if where is not None:
        df = df.where(where)
    return (df.withColumn("_h", seeded_md5(seed, id_col))
            .orderBy("_h", id_col).limit(n).drop("_h"))


def sample_with_replacement_n(spark: SparkSession, df: DataFrame, size: int = 1024,
                              id_col: str = "row_id", seed=42) -> DataFrame:
    """``n = min(len, size)`` draws with replacement. Draw k picks index
    md5(seed:draw:k) mod len of the rows in hash order; draws and rows meet
    in an equi-join on that index. The row count is one number on the
    driver; the draws table has n rows."""
    total = df.count()
    if total == 0:
        return df.limit(0).withColumn("draw", F.lit(0).cast("bigint"))
    ranked = hash_rank(df, id_col, seed=seed, rank_col="_idx")
    draws = (spark.range(min(size, total)).withColumnRenamed("id", "draw")
             .withColumn("_idx", hex8_to_long(seeded_md5(seed, F.lit("draw"), F.col("draw"))) % F.lit(total)))
    return draws.join(ranked, "_idx").drop("_idx")


def shuffled_full_batches(df: DataFrame, batch_size: int, id_col: str = "row_id",
                          seed=42) -> DataFrame:
    """Shuffle, cut into batches of ``batch_size``, drop the ragged last
    batch. Adds ``batch_id`` and ``batch_pos``."""
    ranked = hash_rank(df, id_col, seed=seed, rank_col="_rank", total_col="_total")
    full = F.floor(F.col("_total") / batch_size) * batch_size
    return (ranked.where(F.col("_rank") < full)
            .withColumn("batch_id", F.floor(F.col("_rank") / batch_size).cast("bigint"))
            .withColumn("batch_pos", (F.col("_rank") % batch_size).cast("bigint"))
            .drop("_rank", "_total"))


def epoch_batch_plan(spark: SparkSession, df: DataFrame, epochs: int, batch_size: int,
                     mini_batch_size: int, micro_batch_size: int,
                     id_col: str = "row_id", seed=42) -> DataFrame:
    """Offline training-order plan: a fresh permutation per epoch, with batch,
    mini-batch and micro-batch ids. The epoch copies come from exploding a
    literal array (no join); the rank per epoch orders by md5(seed:epoch:id),
    then the id."""
    ep = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    ep = ep.withColumn("_h", F.unhex(seeded_md5(seed, "epoch", id_col)))
    out = with_row_number(ep, ["_h", id_col], ["epoch"], "_rank", few_groups=True, drop=("_h",))
    return out.select(
        *[c for c in df.columns], "epoch", F.col("_rank").alias("order_in_epoch"),
        F.floor(F.col("_rank") / batch_size).cast("bigint").alias("batch_id"),
        F.floor((F.col("_rank") % batch_size) / mini_batch_size).cast("bigint").alias("mini_batch_id"),
        F.floor((F.col("_rank") % mini_batch_size) / micro_batch_size).cast("bigint").alias("micro_batch_id"))

"""Packing, mismatched pairs, row alignment, on-policy mixing (K15-K20, K31)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import seeded_md5, seeded_uniform
from ..functions.order import hash_rank, prefix_offsets


def pack_wrapped(tokens: DataFrame, seq="seq_id", pos="pos", token="token", block_size=64) -> DataFrame:
    """Concatenate all sequences in ``seq`` order and cut into blocks of
    ``block_size`` (the last block may be short). Global offsets come from
    a two-pass prefix sum of sequence lengths; each block is one group of
    at most ``block_size`` tokens."""
    lengths = tokens.groupBy(seq).agg(F.count(F.lit(1)).alias("_len"))
    offs = prefix_offsets(lengths, [seq], "_len", offset_col="_off").select(seq, "_off")
    g = tokens.join(offs, seq).withColumn("_g", F.col("_off") + F.col(pos))
    return (g.groupBy(F.floor(F.col("_g") / block_size).cast("bigint").alias("block_id"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("_g", token))), lambda s: s[token])
                 .alias("input_ids"))
            .withColumn("n_tokens", F.size("input_ids")))


def _bfd_schema(key_type):
    return T.StructType([T.StructField("shard", T.LongType()), T.StructField("bin_id", T.IntegerType()),
                         T.StructField("seq_ids", T.ArrayType(key_type)),
                         T.StructField("seq_lengths", T.ArrayType(T.LongType())),
                         T.StructField("total", T.LongType())])


def pack_bfd(lengths: DataFrame, seq="seq_id", length="length", capacity=512,
             n_shards: int | None = None, shard_ids: int = 100_000) -> DataFrame:
    """Best-fit-decreasing bins of ``capacity`` per shard. Sequences longer
    than the capacity are truncated first. A shard is a range of
    ``shard_ids`` consecutive sequence numbers, so with one row per sequence
    it never holds more than that, and a packing doesn't depend on the rest
    of the table. Given ``n_shards`` instead, shards are that many hash
    groups of any id type; 1 = the exact global packing of a small table."""
    from ..session import ship_package

    ship_package(lengths.sparkSession)
    if n_shards is None:
        shard = F.floor(F.col(seq) / F.lit(shard_ids))
    else:
        shard = F.conv(F.substring(seeded_md5("bfd", seq), 1, 8), 16, 10).cast("bigint") % n_shards
    key_type = lengths.schema[seq].dataType
    prepared = lengths.select(
        seq, F.least(F.col(length), F.lit(capacity)).cast("bigint").alias("_len"), shard.cast("bigint").alias("shard"))

    def bfd(pdf):
        import bisect

        import pandas as pd

        shard = int(pdf["shard"].iloc[0])
        order = pdf.sort_values(["_len", seq], ascending=[False, True])
        free: list[tuple[int, int]] = []  # (remaining capacity, bin id), sorted
        bins: list[list] = []
        for sid, ln in zip(order[seq].tolist(), order["_len"].tolist()):
            i = bisect.bisect_left(free, (ln, -1))
            if i < len(free):
                rem, b = free.pop(i)
            else:
                rem, b = capacity, len(bins)
                bins.append([])
            bins[b].append((sid, ln))
            bisect.insort(free, (rem - ln, b))
        rows = [(shard, b, [s for s, _ in items], [l for _, l in items], sum(l for _, l in items))
                for b, items in enumerate(bins)]
        return pd.DataFrame(rows, columns=["shard", "bin_id", "seq_ids", "seq_lengths", "total"])

    return prepared.groupBy("shard").applyInPandas(bfd, _bfd_schema(key_type))


def kl_mismatch_pairs(df: DataFrame, id_col="row_id", completion="completion", batch_size=8, seed=42,
                      mode="shift") -> DataFrame:
    """Within each batch (hash order, batches of ``batch_size``) pair row i
    with the completion of another row: ``shift`` takes row i-1 (the first
    row takes the last), ``reverse`` takes row size-1-i. Batches of one row
    cannot be mismatched and are dropped. The source row is found by an
    equi-join on (batch_id, position)."""
    if batch_size <= 1:
        raise ValueError("batch size must be > 1 to build mismatched pairs")
    ranked = hash_rank(df, id_col, seed=seed, rank_col="_rank", total_col="_total")
    b = (ranked.withColumn("batch_id", F.floor(F.col("_rank") / batch_size).cast("bigint"))
         .withColumn("batch_pos", (F.col("_rank") % batch_size).cast("bigint"))
         .withColumn("_bsize", F.least(F.lit(batch_size), F.col("_total") - F.col("batch_id") * batch_size))
         .where(F.col("_bsize") > 1))
    if mode == "shift":
        src = (F.col("batch_pos") + F.col("_bsize") - 1) % F.col("_bsize")
    elif mode == "reverse":
        src = F.col("_bsize") - 1 - F.col("batch_pos")
    else:
        raise ValueError(f"unknown mismatch mode {mode}")
    b = b.withColumn("_src", src)
    srcs = b.select(F.col("batch_id").alias("_sb"), F.col("batch_pos").alias("_sp"),
                    F.col(id_col).alias("kl_row_id"), F.col(completion).alias("kl_completion"))
    return (b.join(srcs, (F.col("batch_id") == F.col("_sb")) & (F.col("_src") == F.col("_sp")))
            .drop("_sb", "_sp", "_src", "_rank", "_total", "_bsize"))


def kl_mismatch_report(df: DataFrame, batch_size=8) -> DataFrame:
    """One row: n_rows, n_batches, and n_dropped, the rows that
    ``kl_mismatch_pairs`` leaves out (a last batch of one row)."""
    if batch_size <= 1:
        raise ValueError("batch size must be > 1 to build mismatched pairs")
    n = F.col("n_rows")
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        n, F.ceil(n / F.lit(batch_size)).alias("n_batches"),
        F.when(n % batch_size == 1, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("n_dropped"))


def align_by_row_id(left: DataFrame, right: DataFrame, id_col="row_id", how="inner") -> DataFrame:
    """Column-wise concatenation of two row-aligned datasets: an equi-join
    on the row id, never on position."""
    dup = set(left.columns) & set(right.columns) - {id_col}
    if dup:
        right = right.select(id_col, *[F.col(c).alias(f"{c}_right") if c in dup else F.col(c)
                                       for c in right.columns if c != id_col])
    return left.join(right, id_col, how)


def on_policy_mix(df: DataFrame, batch="batch_id", reference="reference", student="student",
                  teacher="teacher", lmbda=0.5, seq_kd=False, seed=42) -> DataFrame:
    """Per batch, with probability ``lmbda`` (a seeded hash of the batch id)
    the inputs are replaced by the student's generations; ``seq_kd`` first
    replaces them by the teacher's."""
    base = F.col(teacher) if seq_kd else F.col(reference)
    base_name = F.lit("teacher" if seq_kd else "dataset")
    on = seeded_uniform(seed, batch) <= lmbda
    return (df.withColumn("text", F.when(on, F.col(student)).otherwise(base))
            .withColumn("text_source", F.when(on, F.lit("student")).otherwise(base_name)))

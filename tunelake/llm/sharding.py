"""Two-pass external shuffle into shards (DataFrame functions only).

Pass 1 scatters records uniformly into buckets by a seeded hash; the number of
buckets follows the input's bytes, so that a bucket fits in memory
(``bucket_bytes``; at least ``min_buckets`` for parallel work). Pass 2 gathers
each bucket, puts it into a defined order and shuffles it with
``pyspark.sql.functions.shuffle``, Spark's seeded Fisher-Yates. Buckets in
turn give one random order of all records; shard s takes the s-th of
``n_shards`` equal runs of it. Law ``rows``: shard counts are at most one
apart, whatever the texts.

The hash takes the row's place in its input file beside id and text checksum:
rows that repeat, even a third of the table, spread over all buckets. Pass 1
is written to the shared folder, so a retry finds the same buckets.

Results: a null text counts 8 bytes and has checksum 0; rows repeat as they
are; an empty table gives an empty result; further columns are ignored by
``assign`` and written by ``write_shards``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .base import packed, table

N_SHARDS = 24
BUCKET_BYTES = 64 << 20
MIN_BUCKETS = 384
SEED = 7


def scatter(docs: DataFrame, carry, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
            min_buckets: int = MIN_BUCKETS) -> tuple[DataFrame, int, int]:
    """Pass 1: the records with a bucket each; also the number of buckets and rows."""
    text = F.coalesce("text", F.lit(""))
    rows = materialize(docs.select(
        *carry, (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), "doc_id", F.crc32(text.cast("binary")), F.monotonically_increasing_id()).alias("h")), "scattered")
    total, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    buckets = max(min_buckets, -(-(total or 0) // bucket_bytes))
    return rows.withColumn("bucket", F.pmod("h", F.lit(buckets))), buckets, n


def shuffle_buckets(rows: DataFrame, buckets: int, n: int, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """Pass 2: the records with shard and slot, by Fisher-Yates within each bucket."""
    record = F.struct("h", *[c for c in rows.columns if c not in ("h", "bucket")])
    # an explicit number of partitions: the generator of F.shuffle is seeded per partition
    parts = min(buckets, 10_000)
    gathered = (rows.repartition(parts, "bucket").groupBy("bucket").agg(F.collect_list(record).alias("r"))
                .withColumn("r", F.array_sort("r", lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0)))
                .sortWithinPartitions("bucket"))
    shuffled = gathered.select("bucket", F.posexplode(F.shuffle("r", F.lit(seed))).alias("slot_in_bucket", "r"))
    # one row per bucket, at most one for each bucket_bytes of input
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = materialize(counts.select("bucket", F.coalesce(F.sum("n").over(
        Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start")), "bucket-starts")
    short, longer = divmod(n, n_shards)  # the first ``longer`` shards hold one row more
    edge = longer * (short + 1)
    pos = F.col("start") + F.col("slot_in_bucket")
    placed = shuffled.join(starts, "bucket").withColumn("pos", pos)
    head = F.col("pos") < edge
    shard = F.when(head, F.floor(F.col("pos") / (short + 1))).otherwise(
        longer + F.floor((F.col("pos") - edge) / max(short, 1)))
    slot = F.when(head, F.pmod("pos", F.lit(short + 1))).otherwise(F.pmod(F.col("pos") - edge, F.lit(max(short, 1))))
    return placed.select("r.*", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def assign(docs: DataFrame, n_shards: int = N_SHARDS, **how) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    rows, buckets, n = scatter(docs, ["doc_id"], **how)
    return shuffle_buckets(rows, buckets, n, n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS, **how) -> None:
    """Write the shards, whole records in shuffled order, to ``path``/shard=N."""
    clash = [c for c in docs.columns if c.lower() in ("shard", "slot")]
    if clash:
        raise ValueError(f"the shard files add the columns shard and slot; rename {clash}")
    rows, buckets, n = scatter(docs, [packed(docs)], **how)
    (shuffle_buckets(rows, buckets, n, n_shards).select("d.*", "shard", "slot")
     .repartitionByRange(n_shards, "shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").mode("overwrite").parquet(path))


def op3_shard(spark, sf_dir):
    return assign(table(spark, sf_dir, "documents"))

"""Mixing sources to target weights.

Tokens (words) are aggregated per source; each source's target gives its
repetition rate = target / size; a document is emitted floor(rate) times, plus
one copy with probability rate - floor(rate), drawn from a seeded hash of its
id, so that reruns agree whatever the partitioning.

Targets: sources by code point (null last) weigh 1, 2, 3, repeating, and share
100 % of all words; a target stops at CAP times its source's size and the
excess is shared again by weight until none is above. That is
min(weight * level, CAP * size) for the one level at which the targets add up;
each round of the loop fetches two sums over the source table and raises the
level, and the sources above it stay above, so it ends.

Results: a null or empty text has size 0 and draws like any other; rows
without an id draw by their text; repeated rows draw alike; the null source is
a source; an empty table gives an empty result; further columns are kept by
``mix``. A source that holds most rows costs nothing more: sizes are summed
before the shuffle, and the source table is broadcast only if Spark finds its
file below the session's broadcast threshold, else joined by shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import with_row_number
from ..session import materialize
from .base import WORD, id_hash, null_key, packed, table, uniform, unpacked

WEIGHTS = (1, 2, 3)
CAP = 3.0
SEED = "mix-1"


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       uniform(id_hash(F.col("doc_id"), F.col("text"), SEED)).alias("u"))


def rates(sized: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(key, source, source_size, target, rate), one row per source, written once."""
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # null last, then by code point; the rank is taken over the source table in parts
    per = per.withColumn("source_order", null_key(F.col("source"))).withColumn("null_last", F.col("source").isNull())
    ranked = materialize(with_row_number(per, ["null_last", "source_order"], out="rank").select(
        F.col("source_order").alias("key"), "source", "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                     (F.col("rank") % len(weights) + 1).cast("int")).alias("weight")), "sources")
    top = F.col("source_size") * F.lit(cap)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        below = F.col("weight") * F.lit(level) < top
        free, held, n = ranked.agg(F.sum(F.when(below, F.col("weight"))), F.sum(F.when(~below, top)),
                                   F.count(F.when(~below, 1))).first()
        if free is None or n == full:
            break
        full, level = n, (total - (held or 0.0)) / free
    target = F.least(F.col("weight") * F.lit(level), top)
    return ranked.select("key", "source", "source_size", target.alias("target"),
                         F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def copies(rate, u):
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def plan(docs: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """How often each document is taken: doc_id, source, size, source_size, target, copies, taken."""
    sized = materialize(sizes(docs).withColumn("key", null_key(F.col("source"))), "sizes")
    per = rates(sized, weights, cap).select("key", "source_size", "target", "rate")
    return (sized.join(per, "key").withColumn("copies", copies(F.col("rate"), F.col("u")))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns."""
    per = rates(sizes(docs), weights, cap).select(F.col("key").alias("k"), "rate")
    rows = docs.select(packed(docs), null_key(F.col("source")).alias("k"),
                       uniform(id_hash(F.col("doc_id"), F.col("text"), SEED)).alias("u"))
    taken = rows.join(per, "k").select("d", copies(F.col("rate"), F.col("u")).cast("int").alias("n"))
    return unpacked(taken.select("d", F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("i")), docs)


def op1_mix_sources(spark, sf_dir):
    return plan(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))), 1, 13))::BIGINT
           / 4503599627370496.0::DOUBLE AS u
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM sized GROUP BY source),
rounds(i, level) AS (
  SELECT 0, sum(source_size)::DOUBLE / sum(weight) FROM per
  UNION ALL
  SELECT i + 1, coalesce((SELECT (sum(source_size) - coalesce(sum(CASE WHEN weight * level >= 3.0 * source_size
                                  THEN 3.0 * source_size END), 0))::DOUBLE
                   / sum(CASE WHEN weight * level < 3.0 * source_size THEN weight END) FROM per), level)
  FROM rounds WHERE i < 60),
rated AS (
  SELECT source, source_size, least(weight * (SELECT max_by(level, i) FROM rounds), 3.0 * source_size) AS target,
         CASE WHEN source_size > 0 THEN least(weight * (SELECT max_by(level, i) FROM rounds), 3.0 * source_size)
              / source_size ELSE 0 END AS rate
  FROM per),
taken AS (
  SELECT doc_id, s.source, size, source_size, target,
         (floor(rate) + (u < rate - floor(rate))::INT)::BIGINT AS copies
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM taken
"""

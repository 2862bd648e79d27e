"""Order-dependent helpers without a single-task step.

Spark runs a window without ``partitionBy`` in one task, and a window over a
hot key in one task. These helpers give the same answers in one way, whatever
the table's size:

1. the rows are range partitioned on (group, order) and written once to the
   shared folder, each with the number of its range (so later passes see the
   same ranges, and a lost executor re-reads files);
2. windows run inside (range, group) only: a hot group spreads over as many
   ranges as its size needs;
3. one row per (range, group), the group's count, sum and first row in that
   range, gives every range what comes before or after it, by a window over
   the ranges of one group (without a group: one row per range).

Whole rows travel through the pass, joins on the group are null-safe, and
repeated keys keep their rows (in an arbitrary order among themselves), as
with a window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .expr import seeded_md5


def _ranged(df: DataFrame, groups, orders, num_partitions=None) -> DataFrame:
    """``df`` with ``_rng``, the number of its range of (group, order), written once."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in [*groups, *orders]]
    return materialize(df.repartitionByRange(n, *keys).withColumn("_rng", F.spark_partition_id()), "ranged")


#: The row's number within its range is in the lower bits of an increasing id, the range above them.
_ROW_BITS = 33


def _sorted_ranges(df: DataFrame, groups, orders, keep, num_partitions=None) -> DataFrame:
    """The columns ``keep`` of ``df`` with ``_rng`` and ``_no``, the row's number (from 0) within its range, written
    once. The rows are sorted as they are written, so the order columns need not be kept."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in [*groups, *orders]]
    rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    rows = materialize(rows.select(*[F.col(c) for c in keep], "_id"), "ranged")
    return rows.select(*[F.col(c) for c in keep], F.shiftrightunsigned("_id", _ROW_BITS).alias("_rng"),
                       F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_no"))


def _join_ranges(rows: DataFrame, per: DataFrame, groups, columns, few: bool = False) -> DataFrame:
    """``rows`` with ``columns`` of the table of one row per (range, group)."""
    other = per.select(F.col("_rng").alias("_r2"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], *columns)
    other = F.broadcast(other) if few else other
    same = [F.col("_rng") == F.col("_r2")] + [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    joined = rows.join(other, reduce(lambda a, b: a & b, same))
    return joined.drop("_r2", *[f"_g{i}" for i in range(len(groups))])


def _before(groups):
    """The ranges of a group that come before this one."""
    return Window.partitionBy(*groups).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)


def prefix_offsets(df: DataFrame, order_cols, size_col: str | None = None,
                   offset_col: str = "offset", part_cols=(),
                   num_partitions: int | None = None, value_type: str = "bigint",
                   keep_columns: bool = False) -> DataFrame:
    """``(part_cols..., order_cols..., size, offset_col)`` where
    ``offset_col`` is the exclusive running sum of ``size_col`` (1 per row
    when None, i.e. a 0-based row number; a null size adds nothing) inside
    each group of ``part_cols`` (whole table when empty) in the order
    ``order_cols``. ``keep_columns``: every column of ``df`` travels along."""
    groups, orders = list(part_cols), list(order_cols)
    extra = [c for c in df.columns if c not in {*groups, *orders, size_col}] if keep_columns else []
    size = F.col(size_col) if size_col else F.lit(1)
    rows = _ranged(df.select(*groups, *orders, *extra, size.cast(value_type).alias("_size")), groups, orders, num_partitions)
    inside = Window.partitionBy("_rng", *groups).orderBy(*orders).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(value_type)
    per = rows.groupBy("_rng", *groups).agg(F.sum("_size").alias("_sum"))
    per = per.withColumn("_base", F.coalesce(F.sum("_sum").over(_before(groups)), zero))
    out = _join_ranges(rows.withColumn("_in", F.coalesce(F.sum("_size").over(inside), zero)), per, groups, ["_base"])
    out = out.withColumn(offset_col, (F.col("_base") + F.col("_in")).cast(value_type)).drop("_rng", "_in", "_base")
    return out.withColumnRenamed("_size", size_col) if size_col else out.drop("_size")


def with_row_number(df: DataFrame, order_cols, part_cols=(), out: str = "pos", total_col: str | None = None,
                    num_partitions: int | None = None, few_groups: bool = False, drop=()) -> DataFrame:
    """``df`` plus the 0-based row number inside each group in the order
    ``order_cols``, and the group's row count if ``total_col`` is given.
    Without a group, or with ``few_groups`` (few enough for one row per range
    and group on every task), the rows are shuffled and sorted once only.
    ``drop``: order columns that the result leaves out."""
    if few_groups or not part_cols:
        return _numbered_few(df, list(order_cols), list(part_cols), out, total_col, num_partitions, drop)
    return numbered(df, order_cols, part_cols, out, total_col, num_partitions)[0].drop(*drop)


def _numbered_few(df: DataFrame, orders, groups, out, total_col, num_partitions, drop) -> DataFrame:
    rows = _sorted_ranges(df, groups, orders, [c for c in df.columns if c not in drop], num_partitions)
    per = rows.groupBy("_rng", *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_no").alias("_first"))
    per = (per.withColumn("_base", F.coalesce(F.sum("_n").over(_before(groups)), F.lit(0)) - F.col("_first"))
           .withColumn("_total", F.sum("_n").over(Window.partitionBy(*groups))))
    done = _join_ranges(rows, per, groups, ["_base", "_total"], few=True)
    done = done.withColumn(out, (F.col("_base") + F.col("_no")).cast("bigint")).drop("_rng", "_no", "_base")
    return done.withColumnRenamed("_total", total_col) if total_col else done.drop("_total")


def numbered(df: DataFrame, order_cols, part_cols=(), out: str = "pos", total_col: str | None = None,
             num_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``with_row_number`` and a one-row table with the ``longest`` group's row count, read from the written pass."""
    groups, orders = list(part_cols), list(order_cols)
    rows = _ranged(df, groups, orders, num_partitions)
    if num_partitions:
        rows = rows.repartition(num_partitions, "_rng", *groups)  # the windows keep the count that was asked for
    inside = Window.partitionBy("_rng", *groups).orderBy(*orders)
    per = rows.groupBy("_rng", *groups).agg(F.count(F.lit(1)).alias("_n"))
    per = (per.withColumn("_base", F.coalesce(F.sum("_n").over(_before(groups)), F.lit(0)))
           .withColumn("_total", F.sum("_n").over(Window.partitionBy(*groups))))
    done = _join_ranges(rows.withColumn("_in", F.row_number().over(inside)), per, groups, ["_base", "_total"])
    done = done.withColumn(out, (F.col("_base") + F.col("_in") - 1).cast("bigint")).drop("_rng", "_in", "_base")
    longest = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("longest"))
    return done.withColumnRenamed("_total", total_col) if total_col else done.drop("_total"), longest


def hash_rank(df: DataFrame, id_col: str, seed=42, rank_col: str = "rank", hash_col: str | None = None, part_cols=(),
              total_col: str | None = None) -> DataFrame:
    """Add ``rank_col`` = 0-based position of the row when the rows (of each
    ``part_cols`` group) are ordered by (md5(seed:id), id)."""
    h, md5 = hash_col or "_h", seeded_md5(seed, id_col)
    # its 16 bytes have the order of the digits
    return with_row_number(df.withColumn(h, md5 if hash_col else F.unhex(md5)), [h, id_col], part_cols, rank_col, total_col,
                           drop=() if hash_col else (h,))


def with_next_values(df: DataFrame, order_col: str, value_cols, part_cols=(),
                     prefix: str = "next_", num_partitions: int | None = None) -> DataFrame:
    """``df`` plus LEAD(value) for each of ``value_cols`` over
    (PARTITION BY part_cols ORDER BY order_col)."""
    groups = list(part_cols)
    rows = _ranged(df, groups, [order_col], num_partitions).withColumn("_v", F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(value_cols)]))
    inside = Window.partitionBy("_rng", *groups).orderBy(order_col)
    # one pass numbers the rows: the first of each (range, group) is the row that a lead gives its predecessor
    rows = rows.withColumn("_nv", F.lead("_v").over(inside)).withColumn("_no", F.row_number().over(inside))
    per = rows.groupBy("_rng", *groups).agg(F.max("_no").alias("_last"), F.min_by("_v", "_no").alias("_fv"))
    per = per.withColumn("_after", F.lead("_fv").over(Window.partitionBy(*groups).orderBy("_rng")))
    out = _join_ranges(rows, per, groups, ["_last", "_after"])
    nxt = F.when(F.col("_no") == F.col("_last"), F.col("_after")).otherwise(F.col("_nv"))
    out = out.withColumn("_nv", nxt)
    for i, v in enumerate(value_cols):
        out = out.withColumn(f"{prefix}{v}", F.col("_nv").getField(f"v{i}"))
    return out.drop("_rng", "_v", "_nv", "_no", "_last", "_after")


def next_in_order(df: DataFrame, order_col: str, part_cols=(),
                  next_col: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """``(part_cols..., order_col, next_col)``: the next ``order_col`` of the same group."""
    out = with_next_values(df.select(*part_cols, order_col), order_col, [order_col], part_cols, "_next_", num_partitions)
    return out.withColumnRenamed(f"_next_{order_col}", next_col or f"next_{order_col}")

"""Affine scans along an order: A of a row = d + coef * (A of the row after it).

Such steps compose to steps of the same form, so a group is cut into blocks
that are scanned each on its own, the blocks' ends are scanned in the same way
with the coefficient of a whole block, and every row adds what its block
receives. Blocks are keys of their own: a group of any length spreads over all
tasks, nothing collects it, and the scan inside a block is a running sum.

Numbered from the end of its group, a row at place v of its block has
A = coef**v * sum of d / coef**v' over the block's places up to v. Blocks are
short enough for coef**-v to stay far below the largest double."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .order import numbered

BLOCK = 4096
#: A coefficient below this adds nothing that a double could show.
NOTHING = 1e-140


def _block(coef: float, most: int) -> int:
    """Rows of a block: coef**-rows stays within e**230."""
    change = abs(math.log(abs(coef)))
    return max(2, min(most, int(230 / change) if change else most))


def _scan(rows: DataFrame, groups, u: str, d: str, coef: float, out: str, most: int, longest: int) -> DataFrame:
    """``rows`` (numbered by ``u`` from the end of their group, without gaps, below ``longest``) plus ``out``."""
    if abs(coef) < NOTHING:
        return rows.withColumn(out, F.col(d))
    size, own = _block(coef, most), f"{out}_{u}"
    b, v, s = f"{own}_b", f"{own}_v", f"{own}_s"
    rows = rows.withColumn(b, F.floor(F.col(u) / size).cast("bigint")).withColumn(v, (F.col(u) % size).cast("bigint"))
    upto = Window.partitionBy(*groups, b).orderBy(v).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = F.lit(float(coef))
    rows = rows.withColumn(s, F.pow(c, F.col(v)) * F.coalesce(F.sum(F.col(d) / F.pow(c, F.col(v))).over(upto), F.lit(0.0)))
    if longest <= size:  # no block has one before it
        return rows.withColumn(out, F.col(s)).drop(b, v, s)
    rows = materialize(rows, "scan")
    ends = rows.where(F.col(v) == size - 1).select(*[F.col(g) for g in groups], F.col(b).alias("u"), F.col(s).alias("d"))
    ends = _scan(ends, groups, "u", "d", coef ** size, "a", most, longest // size)
    ends = ends.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], (F.col("u") + 1).alias("_to"), F.col("a").alias("_a"))
    same = [F.col(b) == F.col("_to")] + [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    joined = rows.join(ends, reduce(lambda x, y: x & y, same), "left")
    received = F.coalesce(F.pow(c, F.col(v) + 1) * F.col("_a"), F.lit(0.0))
    return joined.withColumn(out, F.col(s) + received).drop(b, v, s, "_to", "_a", *[f"_g{i}" for i in range(len(groups))])


def affine_scan(df: DataFrame, order_col: str, d_col: str, coef: float, part_cols=(), out: str = "scan", block: int = BLOCK,
                drop=()) -> DataFrame:
    """``df`` plus ``out`` = d + coef * (``out`` of the next row of the group in the order), 0 after the last.
    A null d counts as 0. ``drop``: columns that the result leaves out (the d column, say); they don't travel."""
    d = F.coalesce(F.col(d_col).cast("double"), F.lit(0.0))
    if abs(coef) < NOTHING:
        return df.withColumn(out, d).drop(*drop)
    rows, longest = numbered(df.withColumn("_d", d).drop(*drop), [order_col], part_cols, "_no", "_total")
    rows = rows.withColumn("_u", F.col("_total") - 1 - F.col("_no")).drop("_no", "_total")
    return _scan(rows, list(part_cols), "_u", "_d", coef, out, block, longest.first()[0] or 0).drop("_u", "_d")

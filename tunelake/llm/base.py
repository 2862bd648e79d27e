"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: the longest run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, alias: str = "d") -> Column:
    """All columns of ``df`` as one struct, so that helper columns beside it
    can't clash with the table's own names."""
    return F.struct(*[col(c) for c in df.columns]).alias(alias)


def unpacked(df: DataFrame, like: DataFrame, alias: str = "d") -> DataFrame:
    """The columns of ``like`` out of the struct made by ``packed``."""
    return df.select(*[F.col(alias).getField(c).alias(c) for c in like.columns])


def id_text(doc_id: Column) -> Column:
    """doc_id as text; a null id counts as the empty text."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``."""
    return F.crc32(id_text(doc_id).cast("binary")) % F.lit(modulus)


def id_hash(doc_id: Column, text: Column, seed: str) -> Column:
    """md5 of the seed and the id; rows without an id hash their text."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")))))
    return F.md5(F.concat(F.lit(seed + ":"), key))


def uniform(md5: Column) -> Column:
    """The first 13 hex digits of an md5 as a double in [0, 1)."""
    return F.conv(F.substring(md5, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def null_key(c: Column) -> Column:
    """A string join key that is never null and keeps null apart from every value."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))


BROADCAST_BYTES = 32 << 20


def if_small(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (a written table) marked for broadcast if its counted rows take at
    most ``most`` bytes; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df

"""Sources and sinks (S*): datasets, split folders, CSV result tables,
named eval sets, review samples and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import is_blank


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 fmt: str | None = None) -> DataFrame:
    """Parquet (default), JSON or CSV by extension or ``fmt``; an explicit
    schema skips inference."""
    fmt = fmt or ("json" if path.endswith((".json", ".jsonl")) else
                  "csv" if path.endswith(".csv") else "parquet")
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", True).option("multiLine", True).option("escape", "\\")
    return r.format(fmt).load(path)


def profile_dataset(df: DataFrame) -> DataFrame:
    """Row count plus per-column null count (and blank count, min/max/avg
    length for strings) in a single aggregate."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for f in df.schema.fields:
        c = f.name
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"))
        if isinstance(f.dataType, T.StringType):
            aggs += [F.count_if(F.col(c).isNotNull() & is_blank(c)).alias(f"{c}_blank"),
                     F.min(F.length(c)).cast("bigint").alias(f"{c}_min_len"),
                     F.max(F.length(c)).cast("bigint").alias(f"{c}_max_len"),
                     F.avg(F.length(c)).alias(f"{c}_avg_len")]
    return df.agg(*aggs)


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> str:
    """One folder per split (``split=train`` ...), Parquet."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)
    return path


def read_split(spark: SparkSession, path: str, split: str, split_col: str = "split") -> DataFrame:
    """Read one split back; the filter on the partition column prunes the
    other folders (PartitionFilters in the scan)."""
    return spark.read.parquet(path).where(F.col(split_col) == split)


CSV_OPTIONS = {"header": "true", "quoteAll": "true", "escape": "\\"}


def write_csv_table(df: DataFrame, path: str, quote_all: bool = True) -> str:
    w = df.write.mode("overwrite").option("header", True)
    if quote_all:
        w = w.option("quoteAll", True).option("escape", "\\")
    w.csv(path)
    return path


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a table written by ``write_csv_table`` back. Every field is
    quoted, so an empty field is the empty string; a null written with
    ``quoteAll`` is indistinguishable from it and also reads back as ''
    (result tables hold cleaned text, where null already means '')."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", "\\").option("nullValue", "\u0000").option("emptyValue", "")
            .csv(path))


def named_eval_sets(sets: dict, prep=None, name_col: str = "eval_name") -> DataFrame:
    """Union of the eval sets with their key as a column; ``prep`` runs once
    on the union instead of once per set."""
    parts = [df.withColumn(name_col, F.lit(k)) for k, df in sets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return prep(out) if prep else out


def stream_source(spark: SparkSession, folder: str, schema: T.StructType,
                  glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; ``max_files`` bounds the files
    of one micro-batch, and with it the rows of a prompt held at once."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(folder)


def run_available_now(stream_df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Drain everything available into ``path`` and stop (exactly-once file
    sink; the checkpoint lets a restart resume)."""
    q = (stream_df.writeStream.format(fmt).option("path", path)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()

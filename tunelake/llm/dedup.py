"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text is cut into chunks where its content says so: a chunk ends at the first
end of a sentence or line after MIN_CHUNK characters, or after MAX_CHUNK
characters without one. Equal texts have equal chunk lists, so

1. every chunk gets an identifier. Chunks move once, grouped by identifier and
   chunk text (partial aggregation drops repeats before the shuffle); an
   identifier that stands for two different chunks is found there and its
   chunks get different ranks, so that identifiers are verified and not only
   probably right;
2. each text becomes its recipe, the ordered list of identifiers, computed in
   place; only recipes (8 bytes for about 1,000 characters) are shuffled,
   grouped and joined.

Results: null counts as the empty text, whose recipe is the empty list. Of
equal texts the row with the largest doc_id stays (null ids are smallest); if
that id repeats within the group, one of its rows stays. An empty table gives
an empty result; further columns are ignored by ``decide`` and kept by
``deduplicate``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .base import packed, table, unpacked

MIN_CHUNK, MAX_CHUNK = 1024, 4096


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The text cut at content-defined places, whole and in order."""
    cut = rf"(?s).{{{least},{most - 1}}}?(?<=[\n.!?])|(?s).{{1,{most}}}"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(cut), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def ambiguous(docs: DataFrame, ident=identifier) -> DataFrame:
    """(h, chunk, rank) of the chunks that share an identifier with a different chunk."""
    distinct = (docs.select(F.explode(chunks(F.col("text"))).alias("chunk"))
                .select(ident(F.col("chunk")).alias("h"), "chunk").distinct())
    # one text an identifier is the rule: only identifiers of several go on
    several = distinct.groupBy("h").agg(F.collect_set("chunk").alias("texts")).where(F.size("texts") > 1)
    return several.select("h", F.posexplode(F.array_sort("texts")).alias("rank", "chunk"))


def recipes(docs: DataFrame, ident=identifier) -> DataFrame:
    """One row per document: rid (unique), doc_id, recipe, ranks, text_sha256."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shared = materialize(ambiguous(docs, ident), "chunk-ids")
    base = docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "text",
        F.transform(chunks(F.col("text")), ident).alias("recipe"),
        F.sha2("text", 256).alias("text_sha256"))
    if shared.isEmpty():
        return materialize(base.select("rid", "doc_id", "recipe", F.array().cast("array<int>").alias("ranks"),
                                       "text_sha256"), "recipes")
    rows = materialize(base, "recipes")
    parts = (rows.select("rid", F.posexplode(chunks(F.col("text"))).alias("pos", "chunk"))
             .withColumn("h", ident(F.col("chunk")))
             .join(shared, ["h", "chunk"], "left")
             .groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("rank", F.lit(0)).alias("r")))).alias("p"))
             .select("rid", F.col("p.r").alias("ranks")))
    return rows.join(parts, "rid", "left").select(
        "rid", "doc_id", "recipe", F.coalesce("ranks", F.array().cast("array<int>")).alias("ranks"), "text_sha256")


def decide(docs: DataFrame, ident=identifier) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    rows = recipes(docs, ident)
    # summed before the shuffle; written, so that Spark may split a large group's rows in the join
    groups = materialize(rows.groupBy("recipe", "ranks").agg(
        F.max(F.struct("doc_id", "rid")).alias("top"), F.count(F.lit(1)).alias("group_size")), "recipe-groups")
    return rows.join(groups, ["recipe", "ranks"]).select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("top.rid")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    def key(doc_id, sha):
        return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), sha)

    keepers = decide(docs).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("k")).distinct()
    rows = docs.select(packed(docs), key(F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("k"))
    # rows that repeat id and text meet on k: one of them stays
    return unpacked(rows.join(keepers, "k", "left_semi").dropDuplicates(["k"]), docs)


def op6_exact_dedup(spark, sf_dir):
    return decide(table(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

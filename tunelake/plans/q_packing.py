"""Queries for packing, mismatched pairs, alignment and on-policy mixing
(K15, K16, K19, K20, K31)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packing as PK
from ..operators import report as R
from ..sources.views import Views
from .catalog import register
from .q_data import sql_hex8, sql_md5


@register("pack_wrapped", """
WITH l AS (SELECT seq_id, COUNT(*) AS n FROM seq GROUP BY seq_id),
o AS (SELECT seq_id, COALESCE(SUM(n) OVER (ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l),
g AS (SELECT CAST((o.off + s.pos) // 64 AS BIGINT) AS block_id, o.off + s.pos AS gpos, s.token_id % 10 AS tok
      FROM seq s JOIN o USING (seq_id))
SELECT block_id, CAST(COUNT(*) AS INT) AS n_tokens, array_to_string(list(tok ORDER BY gpos), ' ') AS ids
FROM g GROUP BY block_id""", ["seq"])
def q_pack_wrapped(spark, sf_dir):
    seq = Views(spark, sf_dir).seq().withColumn("token", F.col("token_id") % 10)
    out = PK.pack_wrapped(seq, block_size=64)
    return out.select("block_id", "n_tokens", F.array_join("input_ids", " ").alias("ids"))


@register("pack_bfd")
def q_pack_bfd(spark, sf_dir):
    # bin packing is a heuristic search per shard: checked by invariants
    # (capacity, every sequence exactly once) in tests/test_packing.py
    seq = Views(spark, sf_dir).seq()
    lengths = seq.groupBy("seq_id").agg(F.count(F.lit(1)).alias("length"))
    return PK.pack_bfd(lengths, capacity=16).select(
        "shard", "bin_id", F.size("seq_ids").alias("n_seqs"), "total")


@register("kl_mismatch_pairs", f"""
WITH r AS (SELECT row_id, completion, ROW_NUMBER() OVER (ORDER BY {sql_md5(42, 'row_id')}, row_id) - 1 AS rk,
                  COUNT(*) OVER () AS n FROM unpaired),
b AS (SELECT row_id, completion, CAST(rk // 8 AS BIGINT) AS batch_id, CAST(rk % 8 AS BIGINT) AS batch_pos,
             LEAST(8, n - (rk // 8) * 8) AS bsize FROM r)
SELECT a.row_id, a.batch_id, a.batch_pos, s.row_id AS kl_row_id, s.completion AS kl_completion
FROM b a JOIN b s ON s.batch_id = a.batch_id AND s.batch_pos = (a.batch_pos + a.bsize - 1) % a.bsize
WHERE a.bsize > 1""", ["unpaired"])
def q_kl_mismatch_pairs(spark, sf_dir):
    out = PK.kl_mismatch_pairs(Views(spark, sf_dir).unpaired(), batch_size=8)
    return out.select("row_id", "batch_id", "batch_pos", "kl_row_id", "kl_completion")


@register("kl_mismatch_report", """
SELECT COUNT(*) AS n_rows, CAST(CEIL(COUNT(*) / 8.0) AS BIGINT) AS n_batches,
       CAST(CASE WHEN COUNT(*) % 8 = 1 THEN 1 ELSE 0 END AS BIGINT) AS n_dropped
FROM unpaired""", ["unpaired"])
def q_kl_mismatch_report(spark, sf_dir):
    return PK.kl_mismatch_report(Views(spark, sf_dir).unpaired(), batch_size=8)


@register("align_by_row_id", """
WITH w AS (SELECT row_id, MAX(CASE WHEN model = 'half' THEN prediction END) AS half,
                  MAX(CASE WHEN model = 'echo' THEN prediction END) AS echo,
                  MAX(CASE WHEN model = 'mix' THEN prediction END) AS mix FROM preds GROUP BY row_id)
SELECT p.row_id, p.prompt, p.chosen, p.rejected, w.half, w.echo, w.mix FROM pref p JOIN w USING (row_id)""",
          ["preds", "pref"])
def q_align_by_row_id(spark, sf_dir):
    v = Views(spark, sf_dir)
    wide = R.merge_outputs_wide(v.preds(), ("half", "echo", "mix"), keep=())
    return PK.align_by_row_id(v.pref(), wide)


@register("on_policy_mix", f"""
WITH w AS (SELECT row_id, ANY_VALUE(reference) AS reference, MAX(CASE WHEN model = 'half' THEN prediction END) AS teacher,
                  MAX(CASE WHEN model = 'mix' THEN prediction END) AS student FROM preds GROUP BY row_id),
b AS (SELECT *, CAST(row_id // 800 AS BIGINT) AS batch_id FROM w)
SELECT row_id, batch_id,
       CASE WHEN {sql_hex8(sql_md5(42, 'batch_id'))} / 4294967296.0 <= 0.5 THEN student ELSE reference END AS text,
       CASE WHEN {sql_hex8(sql_md5(42, 'batch_id'))} / 4294967296.0 <= 0.5 THEN 'student' ELSE 'dataset' END AS text_source
FROM b""", ["preds"])
def q_on_policy_mix(spark, sf_dir):
    p = Views(spark, sf_dir).preds()
    w = p.groupBy("row_id").agg(
        F.first("reference").alias("reference"),
        F.max(F.when(F.col("model") == "half", F.col("prediction"))).alias("teacher"),
        F.max(F.when(F.col("model") == "mix", F.col("prediction"))).alias("student"))
    w = w.withColumn("batch_id", F.floor(F.col("row_id") / 800).cast("bigint"))
    return PK.on_policy_mix(w, lmbda=0.5).select("row_id", "batch_id", "text", "text_source")

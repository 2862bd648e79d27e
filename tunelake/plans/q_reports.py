"""Queries for ratings, benchmarks and hyper-parameter grids (M7-M14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as R
from ..sources.views import Views
from .catalog import register

MODELS = ("half", "echo", "mix")


def rating_sheet(preds):
    """A filled review sheet over all prediction rows: ratings derived from
    the data (stand-in for the hand-filled sheet, which is an input)."""
    wide = R.merge_outputs_wide(preds, MODELS)
    cols = ["row_id", "instruction", "reference"]
    sel = [F.col(c) for c in cols]
    for m in MODELS:
        sel.append(F.col(m))
        sel.append((1 + F.length(m) % 5).alias(f"{m}_helpfulness (1-5)"))
        sel.append((1 + F.col("row_id") % 5).alias(f"{m}_factuality (1-5)"))
        sel.append((1 + (F.length(m) + F.col("row_id")) % 5).alias(f"{m}_instruction_following (1-5)"))
    return wide.select(*sel)


@register("ratings_summary", """
WITH l AS (
  SELECT model, 'helpfulness' AS criterion, 1 + LENGTH(prediction) % 5 AS rating FROM preds
  UNION ALL SELECT model, 'factuality', 1 + row_id % 5 FROM preds
  UNION ALL SELECT model, 'instruction_following', 1 + (LENGTH(prediction) + row_id) % 5 FROM preds)
SELECT model, criterion, AVG(CAST(rating AS DOUBLE)) AS mean_rating, COUNT(*) AS n FROM l GROUP BY model, criterion""",
          ["preds"])
def q_ratings_summary(spark, sf_dir):
    return R.ratings_summary(rating_sheet(Views(spark, sf_dir).preds()))


@register("bench_ratio_of_sums", """
WITH p AS (SELECT model, prompt_id, AVG(latency_s) AS latency_s, CASE WHEN SUM(latency_s) > 0 THEN SUM(gen_tokens) / SUM(latency_s) END AS throughput_tok_s,
                  MAX(reward) AS peak FROM bench GROUP BY model, prompt_id)
SELECT model, AVG(latency_s) AS latency_s, AVG(throughput_tok_s) AS throughput_tok_s, AVG(peak) AS peak,
       COUNT(*) AS n_prompts FROM p GROUP BY model""", ["bench"])
def q_bench_ratio_of_sums(spark, sf_dir):
    b = Views(spark, sf_dir).bench().withColumn("peak", F.col("reward"))
    return R.bench_ratio_of_sums(b)


@register("bench_mean_of_ratios", """
SELECT model, AVG(latency_s) AS latency_s, AVG(CASE WHEN latency_s > 0 THEN gen_tokens / latency_s END) AS throughput_tok_s, MAX(reward) AS peak,
       COUNT(*) AS n_requests FROM bench GROUP BY model""", ["bench"])
def q_bench_mean_of_ratios(spark, sf_dir):
    b = Views(spark, sf_dir).bench().withColumn("peak", F.col("reward"))
    return R.bench_mean_of_ratios(b)


@register("bench_server_reported", """
WITH r AS (SELECT model, latency_s, latency_s * 1e8 AS mem_before, gen_tokens * 1e7 AS mem_after,
                  CASE WHEN event_id % 2 = 0 THEN CAST(json_object('eval_count', gen_tokens, 'eval_duration',
                       CAST(FLOOR(latency_s * 1e9) AS BIGINT)) AS VARCHAR) ELSE '{"k": 1}' END AS response
           FROM bench),
v AS (SELECT model, latency_s, mem_before, mem_after,
             COALESCE(CAST(json_extract(response, '$.eval_count') AS BIGINT), 0) AS cnt,
             COALESCE(CAST(json_extract(response, '$.eval_duration') AS BIGINT), 1) / 1e9 AS dur_s FROM r)
SELECT model, AVG(latency_s) AS latency_s, AVG(CASE WHEN dur_s > 0 THEN cnt / dur_s ELSE 0.0 END) AS throughput_tok_s,
       AVG(GREATEST(mem_before, mem_after) / 1073741824.0) AS peak_ram_gb, COUNT(*) AS n_requests
FROM v GROUP BY model""", ["bench"])
def q_bench_server_reported(spark, sf_dir):
    b = Views(spark, sf_dir).bench()
    resp = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(
        F.col("gen_tokens").alias("eval_count"),
        F.floor(F.col("latency_s") * 1e9).cast("bigint").alias("eval_duration")))).otherwise(F.lit('{"k": 1}'))
    r = b.select("model", "latency_s", (F.col("latency_s") * 1e8).alias("mem_before"),
                 (F.col("gen_tokens") * 1e7).alias("mem_after"), resp.alias("response"))
    return R.bench_server_reported(r)


@register("param_grid", """
SELECT run, r, alpha, lr, toolkit, ROUND(eval_loss, 4) AS eval_loss, ROUND(time_min, 2) AS time_min,
       ROUND(peak_vram, 2) AS peak_vram FROM grid_runs""", ["grid_runs"])
def q_param_grid(spark, sf_dir):
    return R.round_results(Views(spark, sf_dir).grid_runs())


@register("best_run", """
SELECT toolkit, best_run, best_eval_loss FROM (
  SELECT toolkit, run AS best_run, MIN(eval_loss) OVER (PARTITION BY toolkit) AS best_eval_loss,
         ROW_NUMBER() OVER (PARTITION BY toolkit ORDER BY eval_loss, run) AS rn FROM grid_runs) t WHERE rn = 1""",
          ["grid_runs"])
def q_best_run(spark, sf_dir):
    return R.best_run(Views(spark, sf_dir).grid_runs())


@register("compare_toolkits", """
SELECT u.run, u.r, u.alpha, u.lr, u.eval_loss AS eval_loss_u, u.time_min AS time_min_u, u.peak_vram AS peak_vram_u,
       p.eval_loss AS eval_loss_p, p.time_min AS time_min_p, p.peak_vram AS peak_vram_p,
       p.eval_loss - u.eval_loss AS delta_eval_loss, p.time_min - u.time_min AS delta_time_min,
       p.peak_vram - u.peak_vram AS delta_peak_vram
FROM grid_runs u JOIN grid_runs p ON u.run = p.run AND u.r = p.r AND u.alpha = p.alpha AND u.lr = p.lr
WHERE u.toolkit = 'U' AND p.toolkit = 'P'""", ["grid_runs"])
def q_compare_toolkits(spark, sf_dir):
    return R.compare_toolkits(Views(spark, sf_dir).grid_runs())

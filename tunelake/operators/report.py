"""Result tables: wide merge, review sheets, ratings, latency benchmarks,
hyper-parameter grids (M5-M14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import seeded_md5

# The three human-rating criteria and the rating column suffix.
CRITERIA = ("helpfulness", "factuality", "instruction_following")
RATING_SUFFIX = " (1-5)"


def merge_outputs_wide(preds: DataFrame, models, id_col="row_id", keep=("instruction", "reference"),
                       model_col="model", value="prediction") -> DataFrame:
    """Long predictions -> one column per model, aligned by row id (never
    by position). The model list is given, so the pivot needs no extra job
    to find the distinct values."""
    return (preds.groupBy(id_col, *keep).pivot(model_col, list(models))
            .agg(F.first(value)))


def review_table(preds: DataFrame, models, k: int = 5, seed=42, id_col="row_id") -> DataFrame:
    """Seeded k-row sample of the merged outputs with three blank rating
    columns per model, interleaved after the model's output."""
    ids = (preds.select(id_col).distinct()
           .withColumn("_h", seeded_md5(seed, id_col)).orderBy("_h", id_col).limit(k)
           .select(id_col))
    wide = merge_outputs_wide(preds.join(ids, id_col, "left_semi"), models, id_col)
    cols = [id_col, "instruction", "reference"]
    sel = [F.col(c) for c in cols]
    for m in models:
        sel.append(F.col(m))
        sel += [F.lit("").alias(f"{m}_{c}{RATING_SUFFIX}") for c in CRITERIA]
    return wide.select(*sel)


def ratings_summary(ratings: DataFrame, id_cols=("row_id",)) -> DataFrame:
    """Filled review sheet (wide) -> mean rating per model x criterion:
    unpivot every rating column, parse model and criterion from its name."""
    rating_cols = [c for c in ratings.columns if c.endswith(RATING_SUFFIX)]
    long = ratings.unpivot(list(id_cols), rating_cols, "column", "rating")
    pat = r"^(.*)_(" + "|".join(CRITERIA) + r") \(1-5\)$"
    return (long.select(F.regexp_extract("column", pat, 1).alias("model"),
                        F.regexp_extract("column", pat, 2).alias("criterion"),
                        F.col("rating").cast("double").alias("rating"))
            .where(F.col("rating").isNotNull())
            .groupBy("model", "criterion")
            .agg(F.avg("rating").alias("mean_rating"), F.count(F.lit(1)).alias("n")))


def bench_ratio_of_sums(bench: DataFrame, model="model", prompt="prompt_id", latency="latency_s",
                        tokens="gen_tokens", peak="peak") -> DataFrame:
    """Per prompt over its runs: latency = mean time, throughput = total
    tokens / total time, peak = max; then the mean over prompts per model.
    Both levels aggregate partially before their shuffle. A zero total time
    leaves the throughput undefined (null), so it does not enter the mean."""
    per_prompt = bench.groupBy(model, prompt).agg(
        F.avg(latency).alias("latency_s"),
        F.when(F.sum(latency) > 0, F.sum(tokens) / F.sum(latency)).alias("throughput_tok_s"),
        F.max(peak).alias("peak"))
    return per_prompt.groupBy(model).agg(
        F.avg("latency_s").alias("latency_s"), F.avg("throughput_tok_s").alias("throughput_tok_s"),
        F.avg("peak").alias("peak"), F.count(F.lit(1)).alias("n_prompts"))


def bench_mean_of_ratios(bench: DataFrame, model="model", latency="latency_s", tokens="gen_tokens",
                         peak="peak") -> DataFrame:
    """Per request throughput = tokens / latency, then plain means per
    model (kept apart from the ratio of sums on purpose); zero-latency
    requests have no throughput (null, skipped by the mean)."""
    return bench.groupBy(model).agg(
        F.avg(latency).alias("latency_s"),
        F.avg(F.when(F.col(latency) > 0, F.col(tokens) / F.col(latency))).alias("throughput_tok_s"),
        F.max(peak).alias("peak"), F.count(F.lit(1)).alias("n_requests"))


def bench_server_reported(df: DataFrame, response="response", model="model",
                          count_path="$.eval_count", duration_path="$.eval_duration",
                          mem_before="mem_before", mem_after="mem_after", latency="latency_s") -> DataFrame:
    """Throughput from server counters in a JSON response: missing count ->
    0, missing duration -> 1 ns, ns -> s, guarded division; latency = mean of
    the client's wall time; memory = mean of max(before, after) in GiB."""
    cnt = F.coalesce(F.get_json_object(response, count_path).cast("bigint"), F.lit(0))
    dur_ns = F.coalesce(F.get_json_object(response, duration_path).cast("bigint"), F.lit(1))
    dur_s = dur_ns / F.lit(1e9)
    tps = F.when(dur_s > 0, cnt / dur_s).otherwise(F.lit(0.0))
    mem = F.greatest(F.col(mem_before), F.col(mem_after)) / F.lit(float(2 ** 30))
    return df.groupBy(model).agg(
        F.avg(latency).alias("latency_s"), F.avg(tps).alias("throughput_tok_s"),
        F.avg(mem).alias("peak_ram_gb"), F.count(F.lit(1)).alias("n_requests"))


def lr_tag(lr: float) -> str:
    return str(lr).replace("-", "").replace(".", "")


def param_grid(spark: SparkSession, ranks=(8, 16, 32), alpha_factors=(1, 2),
               lrs=(1e-4, 2e-4)) -> DataFrame:
    """Product of ranks x alpha factors x learning rates built by exploding
    parameter arrays (no join); alpha = factor * r; run name
    ``r{r}_a{alpha}_lr{lr without '-' and '.'}``."""
    lr_arr = F.array(*[F.struct(F.lit(float(lr)).alias("lr"), F.lit(lr_tag(lr)).alias("lr_tag"))
                       for lr in lrs])
    g = (spark.range(1)
         .select(F.explode(F.array(*[F.lit(int(r)) for r in ranks])).alias("r"))
         .select("r", F.explode(F.array(*[F.lit(int(f)) for f in alpha_factors])).alias("f"))
         .select("r", (F.col("f") * F.col("r")).alias("alpha"), F.explode(lr_arr).alias("l")))
    return g.select("r", "alpha", F.col("l.lr").alias("lr"), F.col("l.lr_tag").alias("lr_tag"),
                    F.concat(F.lit("r"), F.col("r").cast("string"), F.lit("_a"),
                             F.col("alpha").cast("string"), F.lit("_lr"), F.col("l.lr_tag")).alias("run"))


def round_results(runs: DataFrame) -> DataFrame:
    """Result columns rounded 2 / 2 / 4 like the grid result files."""
    return (runs.withColumn("time_min", F.round("time_min", 2))
            .withColumn("peak_vram", F.round("peak_vram", 2))
            .withColumn("eval_loss", F.round("eval_loss", 4)))


def best_run(runs: DataFrame, group="toolkit") -> DataFrame:
    """Run with the lowest eval_loss per group; ties -> smallest run name."""
    return runs.groupBy(group).agg(
        F.min_by("run", F.struct("eval_loss", "run")).alias("best_run"),
        F.min("eval_loss").alias("best_eval_loss"))


def compare_toolkits(runs: DataFrame, a="U", b="P", toolkit="toolkit") -> DataFrame:
    """Join the two grids on (r, alpha, lr) and report deltas b - a."""
    keys = ["run", "r", "alpha", "lr"]
    left = runs.where(F.col(toolkit) == a).select(
        *keys, *[F.col(c).alias(f"{c}_{a.lower()}") for c in ("eval_loss", "time_min", "peak_vram")])
    right = runs.where(F.col(toolkit) == b).select(
        *keys, *[F.col(c).alias(f"{c}_{b.lower()}") for c in ("eval_loss", "time_min", "peak_vram")])
    j = left.join(right, keys)
    for c in ("eval_loss", "time_min", "peak_vram"):
        j = j.withColumn(f"delta_{c}", F.col(f"{c}_{b.lower()}") - F.col(f"{c}_{a.lower()}"))
    return j

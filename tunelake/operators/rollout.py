"""Rollout / RL table operators (K25, K26, G1-G10) over the long token table
``(seq_id, pos, token_id, logp, ref_logp, val, score)``.

Per-sequence facts (stop position, length, EOS) are aggregates joined back
on the sequence id; batch statistics are aggregates joined back on the batch
id; the GAE recursion is an affine scan in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import with_next_values
from ..functions.scan import BLOCK, affine_scan

INVALID_LOGPROB = 1.0  # fixed value used for masked log-probs


# -- K26 ------------------------------------------------------------------------------

def rollout_postprocess(tok: DataFrame, seq="seq_id", pos="pos", token="token", stop_token=1, pad_token=0,
                        logp="logp", ref_logp="ref_logp", val="val", score="score",
                        missing_eos_penalty=1.0) -> DataFrame:
    """After the first stop token every token becomes pad; sequence length =
    first pad index - 1 (row width - 1 when there is none); sequences
    without EOS get ``score - penalty``; log-probs of both models beyond the
    length -> INVALID_LOGPROB (so that pads have no KL), values beyond
    length + 1 -> 0. ``padding_mask``: beyond the length; ``padding_mask_p1``:
    beyond length + 1, where the score is paid."""
    # one aggregate per sequence: first stop, first pad, width. After the
    # stop every token is pad, so the first pad of the processed sequence is
    # the earlier of an original pad and stop + 1 (when inside the row).
    per = tok.groupBy(seq).agg(
        F.min(F.when(F.col(token) == stop_token, F.col(pos))).alias("_stop"),
        F.min(F.when(F.col(token) == pad_token, F.col(pos))).alias("_pad"),
        F.count(F.lit(1)).alias("width"))
    first_pad = F.least(F.col("_pad"), F.when(F.col("_stop") + 1 < F.col("width"), F.col("_stop") + 1))
    per = per.select(seq, "width", "_stop",
                     (F.coalesce(first_pad, F.col("width")) - 1).alias("seq_len"),
                     F.col("_stop").isNotNull().alias("contains_eos"))
    out = tok.join(per, seq)
    out = out.withColumn("post_token", F.when(F.col("_stop").isNotNull() & (F.col(pos) > F.col("_stop")),
                                              F.lit(pad_token)).otherwise(F.col(token))).drop("_stop")
    out = (out.withColumn("masked_logp", F.when(F.col(pos) > F.col("seq_len"), F.lit(INVALID_LOGPROB))
                          .otherwise(F.col(logp)))
           .withColumn("masked_val", F.when(F.col(pos) > F.col("seq_len") + 1, F.lit(0.0)).otherwise(F.col(val)))
           .withColumn("padding_mask", F.col(pos) > F.col("seq_len"))
           .withColumn("padding_mask_p1", F.col(pos) > F.col("seq_len") + 1))
    if ref_logp in tok.columns:
        out = out.withColumn("masked_ref_logp", F.when(F.col("padding_mask"), F.lit(INVALID_LOGPROB)).otherwise(F.col(ref_logp)))
    if score is not None:
        out = out.withColumn("score_adj", F.when(F.col("contains_eos"), F.col(score))
                             .otherwise(F.col(score) - missing_eos_penalty))
    return out


# -- K25 ------------------------------------------------------------------------------

def align_token_logprobs(tok: DataFrame, records: DataFrame, seq="seq_id", pos="pos", mask="mask",
                         batch="batch_id", k="k", value="rec_logp", default=0.0) -> DataFrame:
    """Align log-prob records indexed by real-token position ``k`` to a token
    table whose sequences start after left pads: left_pads = first position
    with mask = 1; record k lands on pos = k + left_pads (left join, default
    for missing); positions with mask = 0 keep the default; completion
    tokens are pos >= max left pads of the batch and not pad."""
    lp = tok.groupBy(seq).agg(F.coalesce(F.min(F.when(F.col(mask) == 1, F.col(pos))),
                                         F.count(F.lit(1))).alias("left_pads"),
                              F.first(batch).alias("_b"))
    mx = lp.groupBy("_b").agg(F.max("left_pads").alias("max_left_pads"))
    t = tok.join(lp.drop("_b"), seq).join(mx.withColumnRenamed("_b", batch), batch)
    r = records.select(F.col(seq).alias("_rs"), F.col(k).alias("_rk"), F.col(value).alias("_rv"))
    j = t.join(r, (F.col(seq) == F.col("_rs")) & (F.col(pos) == F.col("_rk") + F.col("left_pads")), "left")
    return (j.withColumn("aligned_logp", F.when(F.col(mask) == 1, F.coalesce(F.col("_rv"), F.lit(default)))
                         .otherwise(F.lit(default)))
            .withColumn("is_completion", (F.col(pos) >= F.col("max_left_pads")) & (F.col(mask) == 1))
            .drop("_rs", "_rk", "_rv"))


# -- G1 / G2 ----------------------------------------------------------------------------

def shaped_rewards(tok: DataFrame, seq="seq_id", pos="pos", logp="masked_logp", ref_logp="masked_ref_logp",
                   seq_len="seq_len", width="width", score="score", kl_coef=0.05, estimator="k1") -> DataFrame:
    """Per token -kl_coef * kl with kl = -r (``k1``) or exp(r) - 1 - r (``k3``),
    r = ref - logp; the sequence score is added at position seq_len + 1 when
    it is inside the row, else at seq_len."""
    r = F.col(ref_logp) - F.col(logp)
    if estimator not in ("k1", "k3"):
        raise ValueError(f"estimator {estimator!r} is neither k1 nor k3")
    nsr = -kl_coef * (-r if estimator == "k1" else F.exp(r) - 1 - r)
    end = F.when(F.col(seq_len) + 1 < F.col(width), F.col(seq_len) + 1).otherwise(F.col(seq_len))
    return (tok.withColumn("non_score_reward", nsr)
            .withColumn("reward", F.when(F.col(pos) == end, nsr + F.col(score)).otherwise(nsr)))


def masked_whiten(df: DataFrame, value, mask, batch="batch_id", out=None, shift_mean=True,
                  unbiased=True, eps=1e-8) -> DataFrame:
    """(x - mean) / sqrt(var + eps) over unmasked rows of each batch (one
    aggregate per batch joined back); ``shift_mean=False`` adds the mean
    back; masked rows -> 0."""
    out = out or f"{value}_white"
    m = F.col(mask)
    var = F.var_samp(F.when(m, F.col(value))) if unbiased else F.var_pop(F.when(m, F.col(value)))
    stats = df.groupBy(batch).agg(F.avg(F.when(m, F.col(value))).alias("_mu"), var.alias("_var"))
    j = df.join(stats.withColumnRenamed(batch, "_b"), F.col(batch).eqNullSafe(F.col("_b"))).drop("_b")
    w = (F.col(value) - F.col("_mu")) / F.sqrt(F.col("_var") + eps)
    if not shift_mean:
        w = w + F.col("_mu")
    return j.withColumn(out, F.when(m, w).otherwise(F.lit(0.0))).drop("_mu", "_var")


# -- G3 ---------------------------------------------------------------------------------

def gae(tok: DataFrame, seq="seq_id", pos="pos", reward="reward", value="val", gamma=1.0, lam=0.95,
        block: int = BLOCK) -> DataFrame:
    """Generalised advantage estimation per sequence (backward recursion
    A_t = r_t - v_t + gamma v_{t+1} + gamma lam A_{t+1}, 0 after the last row):
    adds ``advantage`` and ``return`` = advantage + value; a null reward or value counts as 0 in the recursion.

    With Z_t = A_t + v_t / lam the next value drops out,
    Z_t = r_t + (1 / lam - 1) v_t + gamma lam Z_{t+1}, which is one affine
    scan (``functions/scan.py``): a sequence of any length spreads over tasks,
    no array holds it. For a lam below 0.1, where 1 / lam would cost digits,
    the next value is fetched along the order instead."""
    r, v = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in (reward, value))
    if lam < 0.1:
        rows = with_next_values(tok, pos, [value], [seq], "_next_")
        step = r - v + gamma * F.coalesce(F.col(f"_next_{value}").cast("double"), F.lit(0.0))
        out = affine_scan(rows.withColumn("_step", step).drop(f"_next_{value}"), pos, "_step", gamma * lam, [seq], "advantage", block, drop=("_step",))
    else:
        step = r + (1 / lam - 1) * v
        out = affine_scan(tok.withColumn("_step", step), pos, "_step", gamma * lam, [seq], "_z", block, drop=("_step",))
        out = out.withColumn("advantage", F.col("_z") - v / lam).drop("_z")
    return out.withColumn("return", F.col("advantage") + F.col(value))


# -- G4 / G5 / G9 -------------------------------------------------------------------------

def ppo_policy_loss(df: DataFrame, logp="logp", old_logp="old_logp", adv="advantage", mask=None,
                    cliprange=0.2, group=None) -> DataFrame:
    m = mask if mask is not None else F.lit(True)
    ratio = F.exp(F.col(logp) - F.col(old_logp))
    l1 = -F.col(adv) * ratio
    l2 = -F.col(adv) * F.least(F.greatest(ratio, F.lit(1 - cliprange)), F.lit(1 + cliprange))
    aggs = [F.avg(F.when(m, F.greatest(l1, l2))).alias("pg_loss"),
            F.avg(F.when(m, (l2 > l1).cast("double"))).alias("pg_clipfrac"),
            F.avg(F.when(m, 0.5 * (F.col(logp) - F.col(old_logp)) ** 2)).alias("approxkl")]
    return df.groupBy(group).agg(*aggs) if group else df.agg(*aggs)


def ppo_value_loss(df: DataFrame, vpred="vpred", values="val", returns="return", mask=None,
                   cliprange_value=0.2, group=None) -> DataFrame:
    m = mask if mask is not None else F.lit(True)
    vclip = F.least(F.greatest(F.col(vpred), F.col(values) - cliprange_value), F.col(values) + cliprange_value)
    l1 = (F.col(vpred) - F.col(returns)) ** 2
    l2 = (vclip - F.col(returns)) ** 2
    aggs = [(0.5 * F.avg(F.when(m, F.greatest(l1, l2)))).alias("vf_loss"),
            F.avg(F.when(m, (l2 > l1).cast("double"))).alias("vf_clipfrac")]
    return df.groupBy(group).agg(*aggs) if group else df.agg(*aggs)


def clipped_surrogate(df: DataFrame, logp="logp", old_logp="old_logp", adv="advantage", adv_clip_max=5.0,
                      clip_range=1e-4, group=None) -> DataFrame:
    a = F.least(F.greatest(F.col(adv), F.lit(-adv_clip_max)), F.lit(adv_clip_max))
    ratio = F.exp(F.col(logp) - F.col(old_logp))
    l1 = -a * ratio
    l2 = -a * F.least(F.greatest(ratio, F.lit(1 - clip_range)), F.lit(1 + clip_range))
    aggs = [F.avg(F.greatest(l1, l2)).alias("loss"),
            (0.5 * F.avg((F.col(logp) - F.col(old_logp)) ** 2)).alias("approx_kl"),
            F.avg((F.abs(ratio - 1.0) > clip_range).cast("double")).alias("clipfrac")]
    return df.groupBy(group).agg(*aggs) if group else df.agg(*aggs)


# -- G6 -----------------------------------------------------------------------------------

def ppo_epoch_metrics(tok: DataFrame, seq="seq_id", batch="batch_id", logp="masked_logp", ref_logp="masked_ref_logp",
                      score="score_adj", token="token", eos_token=1, kl_coef=0.05, minibatch="minibatch") -> DataFrame:
    """Sums per sequence over the masked columns, then means per batch; EOS
    tokens are counted one by one; ``val_ratio`` and ``val_ratio_var`` are mean
    and sample variance of the ratio's means per minibatch (variance null for
    one minibatch)."""
    kl = F.col(logp) - F.col(ref_logp)
    per_seq = tok.groupBy(batch, minibatch, seq).agg(
        F.sum(kl).alias("kl"), F.sum(-F.col(logp)).alias("entropy"),
        F.sum(-kl_coef * kl).alias("non_score"), F.first(score).alias("score"),
        F.count_if(F.col(token) == eos_token).alias("eos"),
        F.sum(F.exp(kl)).alias("_rs"), F.count(F.lit(1)).alias("_n"))
    sums = [F.sum(c).alias(c) for c in ("kl", "entropy", "non_score", "score", "eos", "_rs", "_n")]
    per_mini = per_seq.groupBy(batch, minibatch).agg(*sums, F.count(F.lit(1)).alias("_seqs"))
    ratio = F.col("_rs") / F.col("_n")
    mean = lambda c: (F.sum(c) / F.sum("_seqs"))
    return per_mini.groupBy(batch).agg(
        mean("kl").alias("objective_kl"), mean("entropy").alias("objective_entropy"),
        mean("non_score").alias("objective_non_score_reward"),
        (mean("non_score") + mean("score")).alias("objective_rlhf_reward"),
        mean("score").alias("objective_scores"), F.sum("eos").cast("bigint").alias("eos_count"),
        F.avg(ratio).alias("val_ratio"), F.var_samp(ratio).alias("val_ratio_var"))


def ppo_update_metrics(tok: DataFrame, batch="batch_id", minibatch="minibatch", logp="new_logp", old_logp="masked_logp",
                       adv="advantage", vpred="vpred", values="masked_val", returns="return", entropy="entropy",
                       padding="padding_mask", padding_p1="padding_mask_p1", cliprange=0.2,
                       cliprange_value=0.2) -> DataFrame:
    """Policy and value statistics of the update, one value per minibatch and
    then the plain mean over a batch's minibatches. Losses and clip fractions
    leave padding out; KL, entropy and ratio are means over all positions,
    where a padded position has no log-prob difference."""
    diff = F.when(F.col(padding), 0.0).otherwise(F.col(logp) - F.col(old_logp))
    ratio = F.exp(diff)
    l1 = -F.col(adv) * ratio
    l2 = -F.col(adv) * F.least(F.greatest(ratio, F.lit(1 - cliprange)), F.lit(1 + cliprange))
    v = F.when(F.col(padding_p1), 0.0).otherwise(F.col(vpred))
    vclip = F.least(F.greatest(v, F.col(values) - cliprange_value), F.col(values) + cliprange_value)
    v1, v2 = (v - F.col(returns)) ** 2, (vclip - F.col(returns)) ** 2
    real, real_p1 = ~F.col(padding), ~F.col(padding_p1)
    stats = {"policy_approxkl_avg": 0.5 * F.avg(diff ** 2),
             "policy_clipfrac_avg": F.avg(F.when(real, (l2 > l1).cast("double"))),
             "loss_policy_avg": F.avg(F.when(real, F.greatest(l1, l2))),
             "loss_value_avg": 0.5 * F.avg(F.when(real_p1, F.greatest(v1, v2))),
             "val_clipfrac_avg": F.avg(F.when(real_p1, (v2 > v1).cast("double"))),
             "policy_entropy_avg": F.avg(entropy), "val_ratio": F.avg(ratio)}
    per_mini = tok.groupBy(batch, minibatch).agg(*[c.alias(k) for k, c in stats.items()])
    return per_mini.groupBy(batch).agg(*[F.avg(k).alias(k) for k in stats],
                                       F.var_samp("val_ratio").alias("val_ratio_var"))


# -- G7 / G8 / G10 ----------------------------------------------------------------------------

def advantage_global(df: DataFrame, reward="reward", group="model", eps=1e-8) -> DataFrame:
    """(r - mean) / (population std + eps) over each group (a batch)."""
    stats = df.groupBy(group).agg(F.avg(reward).alias("_mu"), F.stddev_pop(reward).alias("_sd"))
    j = df.join(stats.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    return j.withColumn("advantage", (F.col(reward) - F.col("_mu")) / (F.col("_sd") + eps)).drop("_mu", "_sd")


def advantage_per_prompt(df: DataFrame, prompt="prompt_id", batch="batch_id", order="event_id",
                         reward="reward", buffer_size=16, min_count=16, eps=1e-6) -> DataFrame:
    """Per-prompt buffer of the last ``buffer_size`` rewards, the whole batch
    appended before statistics are taken. A prompt with fewer than
    ``min_count`` rewards so far uses the batch's global mean/std, else its
    own buffer's mean/std (population). Buffers: each (prompt, batch) pair
    expands to its last ``buffer_size`` positions and meets the rows in an
    equi-join on (prompt, position): at most buffer_size rows per pair."""
    from ..functions.order import with_row_number

    rows = with_row_number(df, [order], [prompt], out="_k")
    ends = rows.groupBy(prompt, batch).agg(F.max("_k").alias("_kend"))
    slots = ends.select(prompt, batch, "_kend", F.explode(F.sequence(
        F.greatest(F.col("_kend") - (buffer_size - 1), F.lit(0)), F.col("_kend"))).alias("_k"))
    buf = (slots.join(rows.select(prompt, "_k", F.col(reward).alias("_r")), [prompt, "_k"])
           .groupBy(prompt, batch).agg(F.avg("_r").alias("_pm"), F.stddev_pop("_r").alias("_ps"),
                                       F.max("_kend").alias("_kend")))
    glob = df.groupBy(batch).agg(F.avg(reward).alias("_gm"), F.stddev_pop(reward).alias("_gs"))
    j = rows.join(buf, [prompt, batch]).join(glob, batch)
    own = (F.col("_kend") + 1) >= min_count
    mean = F.when(own, F.col("_pm")).otherwise(F.col("_gm"))
    std = F.when(own, F.col("_ps")).otherwise(F.col("_gs")) + eps
    return (j.withColumn("advantage", (F.col(reward) - mean) / std)
            .withColumn("used_prompt_stats", own)
            .drop("_k", "_kend", "_pm", "_ps", "_gm", "_gs"))


def reward_stats(df: DataFrame, reward="reward", group="model") -> DataFrame:
    return df.groupBy(group).agg(
        F.avg(reward).alias("reward_mean"), F.stddev_pop(reward).alias("reward_std"),
        (F.lit(10.0) - F.avg(reward)).alias("alignprop_loss"), F.count(F.lit(1)).alias("n"))

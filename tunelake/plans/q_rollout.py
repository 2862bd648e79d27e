"""Queries for rollout / RL table operators (K25, K26, G1-G10) over the
``seq`` and ``bench`` views. Token ids are ``token_id % 10`` (0 = pad,
1 = stop/EOS)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollout as G
from ..sources.views import Views
from .catalog import register

KL_COEF = 0.05

# -- shared oracle CTE chain ---------------------------------------------------------------

ROLL_CTES = """
t AS (SELECT seq_id, pos, token_id % 10 AS tok, logp, ref_logp, val, score, CAST(seq_id // 100 AS BIGINT) AS batch_id FROM seq),
p AS (SELECT seq_id, MIN(CASE WHEN tok = 1 THEN pos END) AS stop, COUNT(*) AS w FROM t GROUP BY seq_id),
q AS (SELECT t.*, p.w, CASE WHEN p.stop IS NOT NULL AND t.pos > p.stop THEN 0 ELSE t.tok END AS post
      FROM t JOIN p USING (seq_id)),
r AS (SELECT seq_id, COALESCE(MIN(CASE WHEN post = 0 THEN pos END), MAX(w)) - 1 AS seq_len,
             MAX(CASE WHEN post = 1 THEN 1 ELSE 0 END) = 1 AS contains_eos FROM q GROUP BY seq_id),
roll AS (SELECT q.*, r.seq_len, r.contains_eos,
                CASE WHEN r.contains_eos THEN q.score ELSE q.score - 1.0 END AS score_adj,
                CASE WHEN q.pos > r.seq_len THEN 1.0 ELSE q.logp END AS masked_logp,
                CASE WHEN q.pos > r.seq_len THEN 1.0 ELSE q.ref_logp END AS masked_ref_logp,
                CASE WHEN q.pos > r.seq_len + 1 THEN 0.0 ELSE q.val END AS masked_val,
                q.pos > r.seq_len AS padding_mask, q.pos > r.seq_len + 1 AS padding_mask_p1
         FROM q JOIN r USING (seq_id)),
shaped AS (SELECT *, -0.05 * (masked_logp - masked_ref_logp) AS nsr,
                  CASE WHEN pos = CASE WHEN seq_len + 1 < w THEN seq_len + 1 ELSE seq_len END
                       THEN -0.05 * (masked_logp - masked_ref_logp) + score_adj
                       ELSE -0.05 * (masked_logp - masked_ref_logp) END AS reward
           FROM roll)"""


def _with(body: str) -> str:
    return "WITH " + ROLL_CTES.strip() + "\n" + body


def rollout(spark, sf_dir):
    seq = Views(spark, sf_dir).seq().withColumn("token", F.col("token_id") % 10) \
        .withColumn("batch_id", F.floor(F.col("seq_id") / 100).cast("bigint"))
    return G.rollout_postprocess(seq)


def shaped(spark, sf_dir):
    return G.shaped_rewards(rollout(spark, sf_dir), score="score_adj", kl_coef=KL_COEF)


@register("rollout_postprocess", _with("""
SELECT seq_id, ANY_VALUE(seq_len) AS seq_len, ANY_VALUE(contains_eos) AS contains_eos, ANY_VALUE(score_adj) AS score_adj,
       SUM(masked_logp) AS masked_logp_sum, SUM(masked_val) AS masked_val_sum, COUNT_IF(padding_mask) AS n_padded
FROM roll GROUP BY seq_id"""), ["seq"])
def q_rollout_postprocess(spark, sf_dir):
    return rollout(spark, sf_dir).groupBy("seq_id").agg(
        F.first("seq_len").alias("seq_len"), F.first("contains_eos").alias("contains_eos"),
        F.first("score_adj").alias("score_adj"), F.sum("masked_logp").alias("masked_logp_sum"),
        F.sum("masked_val").alias("masked_val_sum"), F.count_if("padding_mask").alias("n_padded"))


@register("align_token_logprobs", """
WITH t AS (SELECT seq_id, pos, CAST(seq_id // 100 AS BIGINT) AS batch_id,
                  CASE WHEN token_id % 10 <> 0 THEN 1 ELSE 0 END AS mask FROM seq),
lp AS (SELECT seq_id, ANY_VALUE(batch_id) AS batch_id,
              COALESCE(MIN(CASE WHEN mask = 1 THEN pos END), COUNT(*)) AS left_pads FROM t GROUP BY seq_id),
mx AS (SELECT batch_id, MAX(left_pads) AS max_left_pads FROM lp GROUP BY batch_id),
rec AS (SELECT seq_id, pos AS k, ref_logp AS rv FROM seq)
SELECT t.seq_id, ANY_VALUE(lp.left_pads) AS left_pads, ANY_VALUE(mx.max_left_pads) AS max_left_pads,
       COUNT_IF(t.pos >= mx.max_left_pads AND t.mask = 1) AS n_completion,
       SUM(CASE WHEN t.mask = 1 THEN COALESCE(rec.rv, 0.0) ELSE 0.0 END) AS aligned_sum
FROM t JOIN lp USING (seq_id) JOIN mx ON mx.batch_id = lp.batch_id
LEFT JOIN rec ON rec.seq_id = t.seq_id AND t.pos = rec.k + lp.left_pads
GROUP BY t.seq_id""", ["seq"])
def q_align_token_logprobs(spark, sf_dir):
    seq = Views(spark, sf_dir).seq()
    tok = seq.select("seq_id", "pos", F.floor(F.col("seq_id") / 100).cast("bigint").alias("batch_id"),
                     F.when(F.col("token_id") % 10 != 0, 1).otherwise(0).alias("mask"))
    rec = seq.select("seq_id", F.col("pos").alias("k"), F.col("ref_logp").alias("rec_logp"))
    out = G.align_token_logprobs(tok, rec)
    return out.groupBy("seq_id").agg(
        F.first("left_pads").alias("left_pads"), F.first("max_left_pads").alias("max_left_pads"),
        F.count_if("is_completion").alias("n_completion"), F.sum("aligned_logp").alias("aligned_sum"))


@register("shaped_rewards", _with("""
SELECT seq_id, SUM(reward) AS reward_sum, SUM(nsr) AS non_score_sum FROM shaped GROUP BY seq_id"""), ["seq"])
def q_shaped_rewards(spark, sf_dir):
    return shaped(spark, sf_dir).groupBy("seq_id").agg(
        F.sum("reward").alias("reward_sum"), F.sum("non_score_reward").alias("non_score_sum"))


@register("masked_whiten", _with(""",
st AS (SELECT batch_id, AVG(CASE WHEN NOT padding_mask_p1 THEN reward END) AS mu,
              VAR_SAMP(CASE WHEN NOT padding_mask_p1 THEN reward END) AS v FROM shaped GROUP BY batch_id),
wh AS (SELECT s.batch_id, CASE WHEN NOT padding_mask_p1 THEN (reward - mu) / sqrt(v + 1e-8) + mu ELSE 0.0 END AS x
       FROM shaped s JOIN st USING (batch_id))
SELECT batch_id, SUM(x) AS white_sum, SUM(x * x) AS white_sq_sum FROM wh GROUP BY batch_id""".lstrip(",")
                                     .replace("\nst AS", ",\nst AS", 1)), ["seq"])
def q_masked_whiten(spark, sf_dir):
    s = shaped(spark, sf_dir).withColumn("valid", ~F.col("padding_mask_p1"))
    w = G.masked_whiten(s, "reward", "valid", out="x", shift_mean=False)
    return w.groupBy("batch_id").agg(F.sum("x").alias("white_sum"), F.sum(F.col("x") * F.col("x")).alias("white_sq_sum"))


@register("gae", _with(""",
d AS (SELECT a.seq_id, a.pos, a.masked_val, a.reward + 1.0 * COALESCE(b.masked_val, 0.0) - a.masked_val AS delta
      FROM shaped a LEFT JOIN shaped b ON b.seq_id = a.seq_id AND b.pos = a.pos + 1)
SELECT a.seq_id, a.pos, SUM(power(0.95, b.pos - a.pos) * b.delta) AS advantage,
       SUM(power(0.95, b.pos - a.pos) * b.delta) + ANY_VALUE(a.masked_val) AS "return"
FROM d a JOIN d b ON a.seq_id = b.seq_id AND b.pos >= a.pos GROUP BY a.seq_id, a.pos""".lstrip(",")
                 .replace("\nd AS", ",\nd AS", 1)), ["seq"])
def q_gae(spark, sf_dir):
    # the scan writes its rows: only what it needs travels
    tok = shaped(spark, sf_dir).select("seq_id", "pos", "reward", "masked_val")
    out = G.gae(tok, reward="reward", value="masked_val", gamma=1.0, lam=0.95)
    return out.select("seq_id", "pos", "advantage", "return")


@register("ppo_policy_loss", """
WITH t AS (SELECT exp(logp - ref_logp) AS ratio, val - 0.5 AS adv, logp, ref_logp FROM seq WHERE token_id % 10 <> 0)
SELECT AVG(GREATEST(-adv * ratio, -adv * LEAST(GREATEST(ratio, 0.8), 1.2))) AS pg_loss,
       AVG(CAST(-adv * LEAST(GREATEST(ratio, 0.8), 1.2) > -adv * ratio AS DOUBLE)) AS pg_clipfrac,
       AVG(0.5 * (logp - ref_logp) ** 2) AS approxkl FROM t""", ["seq"])
def q_ppo_policy_loss(spark, sf_dir):
    s = Views(spark, sf_dir).seq().withColumn("advantage", F.col("val") - 0.5)
    return G.ppo_policy_loss(s, old_logp="ref_logp", mask=F.col("token_id") % 10 != 0, cliprange=0.2)


@register("ppo_value_loss", """
WITH t AS (SELECT val + 0.1 * (logp - ref_logp) AS vpred, val, score AS ret FROM seq WHERE token_id % 10 <> 0),
c AS (SELECT (vpred - ret) ** 2 AS l1, (LEAST(GREATEST(vpred, val - 0.2), val + 0.2) - ret) ** 2 AS l2 FROM t)
SELECT 0.5 * AVG(GREATEST(l1, l2)) AS vf_loss, AVG(CAST(l2 > l1 AS DOUBLE)) AS vf_clipfrac FROM c""", ["seq"])
def q_ppo_value_loss(spark, sf_dir):
    s = Views(spark, sf_dir).seq().withColumn("vpred", F.col("val") + 0.1 * (F.col("logp") - F.col("ref_logp"))) \
        .withColumn("return", F.col("score"))
    return G.ppo_value_loss(s, mask=F.col("token_id") % 10 != 0, cliprange_value=0.2)


@register("ppo_epoch_metrics", _with(""",
s AS (SELECT batch_id, seq_id, SUM(masked_logp - masked_ref_logp) AS kl, SUM(-masked_logp) AS entropy,
             SUM(-0.05 * (masked_logp - masked_ref_logp)) AS non_score, ANY_VALUE(score_adj) AS score,
             COUNT(CASE WHEN tok = 1 THEN 1 END) AS eos FROM roll GROUP BY batch_id, seq_id),
m AS (SELECT batch_id, seq_id % 4 AS mb, AVG(exp(masked_logp - masked_ref_logp)) AS ratio FROM roll GROUP BY 1, 2),
v AS (SELECT batch_id, AVG(ratio) AS val_ratio, VAR_SAMP(ratio) AS val_ratio_var FROM m GROUP BY 1)
SELECT batch_id, AVG(kl) AS objective_kl, AVG(entropy) AS objective_entropy, AVG(non_score) AS objective_non_score_reward,
       AVG(non_score) + AVG(score) AS objective_rlhf_reward, AVG(score) AS objective_scores,
       CAST(SUM(eos) AS BIGINT) AS eos_count, ANY_VALUE(v.val_ratio) AS val_ratio, ANY_VALUE(v.val_ratio_var) AS val_ratio_var
FROM s JOIN v USING (batch_id) GROUP BY batch_id""".lstrip(",").replace("\ns AS", ",\ns AS", 1)), ["seq"])
def q_ppo_epoch_metrics(spark, sf_dir):
    s = rollout(spark, sf_dir).withColumn("minibatch", F.col("seq_id") % 4)
    return G.ppo_epoch_metrics(s, kl_coef=KL_COEF)


@register("ppo_update_metrics", _with(""",
x AS (SELECT *, seq_id % 4 AS mb, val - 0.5 AS adv, CASE WHEN padding_mask THEN 0.0 ELSE 0.5 * (val - 0.5) END AS diff,
             CASE WHEN padding_mask_p1 THEN 0.0 ELSE val + 0.1 * (logp - ref_logp) END AS v FROM roll),
y AS (SELECT *, exp(diff) AS ratio, LEAST(GREATEST(v, masked_val - 0.2), masked_val + 0.2) AS vc FROM x),
z AS (SELECT *, -adv * ratio AS l1, -adv * LEAST(GREATEST(ratio, 0.8), 1.2) AS l2,
             (v - score_adj) ** 2 AS v1, (vc - score_adj) ** 2 AS v2 FROM y),
m AS (SELECT batch_id, mb, 0.5 * AVG(diff ** 2) AS kl,
             AVG(CASE WHEN NOT padding_mask THEN CAST(l2 > l1 AS DOUBLE) END) AS pc,
             AVG(CASE WHEN NOT padding_mask THEN GREATEST(l1, l2) END) AS pl,
             0.5 * AVG(CASE WHEN NOT padding_mask_p1 THEN GREATEST(v1, v2) END) AS vl,
             AVG(CASE WHEN NOT padding_mask_p1 THEN CAST(v2 > v1 AS DOUBLE) END) AS vcf,
             AVG(-logp) AS ent, AVG(ratio) AS r FROM z GROUP BY 1, 2)
SELECT batch_id, AVG(kl) AS policy_approxkl_avg, AVG(pc) AS policy_clipfrac_avg, AVG(pl) AS loss_policy_avg,
       AVG(vl) AS loss_value_avg, AVG(vcf) AS val_clipfrac_avg, AVG(ent) AS policy_entropy_avg, AVG(r) AS val_ratio,
       VAR_SAMP(r) AS val_ratio_var FROM m GROUP BY batch_id"""), ["seq"])
def q_ppo_update_metrics(spark, sf_dir):
    s = (rollout(spark, sf_dir).withColumn("minibatch", F.col("seq_id") % 4)
         .withColumn("advantage", F.col("val") - 0.5).withColumn("return", F.col("score_adj"))
         .withColumn("new_logp", F.col("logp") + 0.5 * (F.col("val") - 0.5))
         .withColumn("vpred", F.col("val") + 0.1 * (F.col("logp") - F.col("ref_logp"))).withColumn("entropy", -F.col("logp")))
    return G.ppo_update_metrics(s)


@register("clipped_surrogate", """
WITH t AS (SELECT LEAST(GREATEST((val - 0.5) * 20, -5.0), 5.0) AS a, exp(logp - ref_logp) AS ratio, logp, ref_logp FROM seq)
SELECT AVG(GREATEST(-a * ratio, -a * LEAST(GREATEST(ratio, 1 - 1e-4), 1 + 1e-4))) AS loss,
       0.5 * AVG((logp - ref_logp) ** 2) AS approx_kl, AVG(CAST(abs(ratio - 1.0) > 1e-4 AS DOUBLE)) AS clipfrac FROM t""",
          ["seq"])
def q_clipped_surrogate(spark, sf_dir):
    s = Views(spark, sf_dir).seq().withColumn("advantage", (F.col("val") - 0.5) * 20)
    return G.clipped_surrogate(s, old_logp="ref_logp")


@register("advantage_global", """
WITH s AS (SELECT model, AVG(reward) AS mu, STDDEV_POP(reward) AS sd FROM bench GROUP BY model)
SELECT event_id, (reward - mu) / (sd + 1e-8) AS advantage FROM bench JOIN s USING (model)""", ["bench"])
def q_advantage_global(spark, sf_dir):
    return G.advantage_global(Views(spark, sf_dir).bench()).select("event_id", "advantage")


@register("advantage_per_prompt", """
WITH b AS (SELECT event_id, prompt_id, event_id // 1000 AS batch_id, reward,
                  ROW_NUMBER() OVER (PARTITION BY prompt_id ORDER BY event_id) - 1 AS k FROM bench),
e AS (SELECT prompt_id, batch_id, MAX(k) AS kk FROM b GROUP BY 1, 2),
buf AS (SELECT e.prompt_id, e.batch_id, ANY_VALUE(e.kk) AS kk, AVG(b.reward) AS pm, STDDEV_POP(b.reward) AS ps
        FROM e JOIN b ON b.prompt_id = e.prompt_id AND b.k BETWEEN e.kk - 15 AND e.kk GROUP BY 1, 2),
g AS (SELECT batch_id, AVG(reward) AS gm, STDDEV_POP(reward) AS gs FROM b GROUP BY 1)
SELECT b.event_id, CASE WHEN buf.kk + 1 >= 16 THEN (b.reward - buf.pm) / (buf.ps + 1e-6)
                        ELSE (b.reward - g.gm) / (g.gs + 1e-6) END AS advantage,
       buf.kk + 1 >= 16 AS used_prompt_stats
FROM b JOIN buf USING (prompt_id, batch_id) JOIN g USING (batch_id)""", ["bench"])
def q_advantage_per_prompt(spark, sf_dir):
    b = Views(spark, sf_dir).bench().withColumn("batch_id", F.floor(F.col("event_id") / 1000).cast("bigint"))
    return G.advantage_per_prompt(b).select("event_id", "advantage", "used_prompt_stats")


@register("reward_stats", """
SELECT model, AVG(reward) AS reward_mean, STDDEV_POP(reward) AS reward_std, 10.0 - AVG(reward) AS alignprop_loss,
       COUNT(*) AS n FROM bench GROUP BY model""", ["bench"])
def q_reward_stats(spark, sf_dir):
    return G.reward_stats(Views(spark, sf_dir).bench())

"""Queries for log-probability numerics (L*) and preference losses and
metrics (R*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logps as L
from ..operators import losses as R
from ..sources.views import Views, table
from .catalog import register

# DuckDB snippets -------------------------------------------------------------------


def sql_logsig(x: str) -> str:
    return f"(-(GREATEST(-({x}), 0) + ln(1 + exp(-abs({x})))))"


def sql_sig(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


def sql_lse(x: str) -> str:
    return f"(list_max({x}) + ln(list_sum(list_transform({x}, lambda w: exp(w - list_max({x}))))))"


# -- L1 / L7 ----------------------------------------------------------------------------

@register("selective_log_softmax", f"""
WITH s AS (SELECT vec_id, label, list_transform(embedding, lambda v: ((CAST(v AS DOUBLE) * 1.5 / 2.0)
             * tanh((CAST(v AS DOUBLE) * 1.5 / 2.0) / 5.0)) / 0.7) AS x FROM embeddings)
SELECT vec_id, x[label + 1] - {sql_lse('x')} AS logp FROM s""")
def q_selective_log_softmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return L.selective_log_softmax(e, logits="embedding", target="label", multiply=1.5, divide=2.0,
                                   softcap=5.0, temperature=0.7).select("vec_id", "logp")


@register("selective_log_softmax_long", f"""
WITH s AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)
SELECT vec_id, x[label + 1] - {sql_lse('x')} AS logp FROM s""")
def q_selective_log_softmax_long(spark, sf_dir):
    # one row per (position, vocabulary entry), for vocabularies too wide for an array
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("target"),
                                                  F.posexplode("embedding").alias("vocab_id", "logit"))
    return L.selective_log_softmax_long(e.withColumn("logit", F.col("logit").cast("double")), ["vec_id"])


@register("token_entropy", f"""
WITH s AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)
SELECT vec_id, {sql_lse('x')} - list_sum(list_transform(x, lambda v: exp(v - {sql_lse('x')}) * v)) AS entropy FROM s""")
def q_token_entropy(spark, sf_dir):
    return L.token_entropy(table(spark, sf_dir, "embeddings"), logits="embedding").select("vec_id", "entropy")


# -- L3 / L4 / L5 / L8 -------------------------------------------------------------------

_LEAD = ("WITH l AS (SELECT seq_id, pos, logp, LEAD(token_id) OVER (PARTITION BY seq_id ORDER BY pos) AS nt "
         "FROM seq)")


@register("sequence_logps", _LEAD + """
SELECT seq_id, COALESCE(SUM(CASE WHEN nt % 10 <> 0 THEN logp END), 0.0) AS logps_sum, COUNT_IF(nt % 10 <> 0) AS n_tokens,
       SUM(CASE WHEN nt % 10 <> 0 THEN logp END) / NULLIF(COUNT_IF(nt % 10 <> 0), 0) AS logps_mean
FROM l GROUP BY seq_id""", ["seq"])
def q_sequence_logps(spark, sf_dir):
    seq = Views(spark, sf_dir).seq()
    lab = L.shifted_labels(seq, ignore=lambda c: c % 10 == 0)
    return L.sequence_logps(lab).select("seq_id", "logps_sum", "n_tokens", "logps_mean")


@register("chosen_nll", """
SELECT v.variant, -SUM(logp) / COUNT(*) AS nll, COUNT(*) AS n_tokens
FROM seq CROSS JOIN (SELECT 'cpo' AS variant UNION ALL SELECT 'orpo') v
WHERE token_id % 10 <> 0 AND (v.variant = 'orpo' OR pos >= 1)
GROUP BY v.variant""", ["seq"])
def q_chosen_nll(spark, sf_dir):
    # every sequence is a chosen sequence here; cpo masks the first (prompt)
    # position, orpo keeps the full sequence; pads (token 0) never count
    seq = Views(spark, sf_dir).seq()
    both = seq.withColumn("variant", F.explode(F.array(F.lit("cpo"), F.lit("orpo"))))
    mask = (F.col("token_id") % 10 != 0) & ((F.col("variant") == "orpo") | (F.col("pos") >= 1))
    return L.chosen_nll(both, mask=mask, group="variant")


@register("dft_loss", """
SELECT AVG(-exp(logp) * logp) AS dft_loss, COUNT(*) AS n_tokens FROM seq WHERE token_id % 10 <> 0""", ["seq"])
def q_dft_loss(spark, sf_dir):
    return L.dft_loss(Views(spark, sf_dir).seq(), mask=F.col("token_id") % 10 != 0)


KL_SQL = """
SELECT seq_id % 4 AS source, 0.5 * AVG((logp - ref_logp) ** 2) AS approx_kl, AVG(-(ref_logp - logp)) AS kl_k1,
       AVG(exp(ref_logp - logp) - 1 - (ref_logp - logp)) AS kl_k3 FROM seq GROUP BY 1"""


@register("kl_estimators", KL_SQL, ["seq"])
def q_kl_estimators(spark, sf_dir):
    seq = Views(spark, sf_dir).seq().withColumn("source", F.col("seq_id") % 4)
    return L.kl_estimators(seq, group="source")


# the inventory names this operator approx_kl / kl_k1 / kl_k3
register("approx_kl", KL_SQL, ["seq"])(q_kl_estimators)


# -- L6 ----------------------------------------------------------------------------------

def _jsd_sql() -> str:
    parts = []
    for beta in (0.0, 0.5, 1.0):
        if beta == 0.0:
            el = "exp(lt[i]) * (lt[i] - ls[i])"
        elif beta == 1.0:
            el = "exp(ls[i]) * (ls[i] - lt[i])"
        else:
            import math

            lb, l1b = math.log(beta), math.log(1 - beta)
            a, b = f"(ls[i] + {l1b!r})", f"(lt[i] + {lb!r})"
            mix = f"(GREATEST({a}, {b}) + ln(1 + exp(-abs({a} - {b}))))"
            el = f"({beta!r} * exp(lt[i]) * (lt[i] - {mix}) + {1 - beta!r} * exp(ls[i]) * (ls[i] - {mix}))"
        parts.append(f"""SELECT CAST({beta!r} AS DOUBLE) AS beta, SUM(CASE WHEN lab <> -100 THEN j END) / COUNT_IF(lab <> -100) AS jsd_batchmean,
       SUM(CASE WHEN lab <> -100 THEN j END) AS jsd_sum,
       SUM(CASE WHEN lab <> -100 THEN j END) / SUM(CASE WHEN lab <> -100 THEN len(ls) END) AS jsd_mean
FROM (SELECT lab, ls, list_sum(list_transform(range(1, len(ls) + 1), lambda i: {el})) AS j FROM p) q""")
    return f"""
WITH s AS (SELECT vec_id, CASE WHEN label = 9 THEN -100 ELSE label END AS lab,
                  list_transform(embedding, lambda v: CAST(v AS DOUBLE) / 2.0) AS x FROM embeddings),
ls AS (SELECT vec_id, lab, list_transform(x, lambda v: v - {sql_lse('x')}) AS l FROM s),
p AS (SELECT vec_id, lab, l AS ls, list_reverse(l) AS lt FROM ls)
""" + "\nUNION ALL\n".join(parts)


@register("generalized_jsd", _jsd_sql())
def q_generalized_jsd(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    student = e.select("vec_id", F.when(F.col("label") == 9, F.lit(-100)).otherwise(F.col("label")).alias("label"),
                       F.col("embedding").alias("logits"))
    # the teacher of every vector holds its components in reverse order
    teacher = e.select("vec_id", F.reverse("embedding").alias("logits"))
    return L.generalized_jsd(student, teacher, "vec_id", betas=(0.0, 0.5, 1.0), temperature=2.0)


# -- R1 / R2 / R4 ------------------------------------------------------------------------

def _cpo_sql(kind: str) -> str:
    z = "(chosen_logp - rejected_logp)"
    if kind == "simpo":
        z = f"({z} - 0.5 / 0.1)"
    if kind in ("sigmoid", "simpo"):
        loss = f"(-{sql_logsig(f'0.1 * {z}')} * 0.9 - {sql_logsig(f'-0.1 * {z}')} * 0.1)"
    elif kind == "hinge":
        loss = f"GREATEST(0.0, 1 - 0.1 * {z})"
    else:
        loss = f"(({z} - 1 / (2 * 0.1)) ** 2)"
    return (f"SELECT '{kind}' AS loss_type, AVG({loss}) AS loss, AVG(0.1 * chosen_logp) AS chosen_reward, "
            f"AVG(0.1 * rejected_logp) AS rejected_reward, AVG({loss}) + 1.0 * AVG(-chosen_logp) AS total_loss "
            f"FROM pair_logp")


@register("cpo_loss", "\nUNION ALL\n".join(_cpo_sql(k) for k in R.CPO_LOSS_TYPES), ["pair_logp"])
def q_cpo_loss(spark, sf_dir):
    p = Views(spark, sf_dir).pair_logp()
    # all four loss types from one scan and one aggregate, one row per type
    cols = [F.avg(R.cpo_loss_expr(loss_type=k, beta=0.1, label_smoothing=0.1, simpo_gamma=0.5)[0]).alias(f"l{i}")
            for i, k in enumerate(R.CPO_LOSS_TYPES)]
    agg = p.agg(*cols, F.avg(0.1 * F.col("chosen_logp")).alias("cr"),
                F.avg(0.1 * F.col("rejected_logp")).alias("rr"), F.avg(-F.col("chosen_logp")).alias("nll"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("loss_type"), F.col(f"l{i}").alias("loss"))
                               for i, k in enumerate(R.CPO_LOSS_TYPES)])).alias("r")
    return agg.select(rows, "cr", "rr", "nll").select(
        "r.loss_type", "r.loss", F.col("cr").alias("chosen_reward"), F.col("rr").alias("rejected_reward"),
        (F.col("r.loss") + 1.0 * F.col("nll")).alias("total_loss"))


_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@register("alphapo_transform", f"""
SELECT {_KEYS}, (1 - exp(-0.3 * chosen_logp)) / 0.3 - (1 - exp(-0.3 * rejected_logp)) / 0.3 AS logits,
       0.1 * (1 - exp(-0.3 * chosen_logp)) / 0.3 AS chosen_reward, 0.1 * (1 - exp(-0.3 * rejected_logp)) / 0.3 AS rejected_reward
FROM pair_logp""", ["pair_logp"])
def q_alphapo_transform(spark, sf_dir):
    p = Views(spark, sf_dir).pair_logp()
    out = R.cpo_loss(p, loss_type="sigmoid", beta=0.1, alpha=0.3)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "logits", "chosen_reward",
                      "rejected_reward")


@register("orpo_odds_ratio", f"""
WITH o AS (SELECT l_orderkey % 8 AS grp, chosen_logp,
                  (chosen_logp - rejected_logp) - (ln(1 - exp(chosen_logp)) - ln(1 - exp(rejected_logp))) AS lo
           FROM pair_logp)
SELECT grp, AVG(-chosen_logp) AS nll, AVG(lo) AS log_odds_chosen, AVG({sql_logsig('lo')}) AS log_odds_ratio,
       AVG(-chosen_logp) - AVG(0.1 * {sql_logsig('lo')}) AS total_loss FROM o GROUP BY grp""", ["pair_logp"])
def q_orpo_odds_ratio(spark, sf_dir):
    p = R.orpo_odds_ratio(Views(spark, sf_dir).pair_logp(), beta=0.1)
    return p.groupBy((F.col("l_orderkey") % 8).alias("grp")).agg(
        F.avg(-F.col("chosen_logp")).alias("nll"), F.avg("log_odds").alias("log_odds_chosen"),
        F.avg("log_odds_ratio").alias("log_odds_ratio"),
        (F.avg(-F.col("chosen_logp")) - F.avg("or_loss")).alias("total_loss"))


# -- R5 / R6 / R7 / R15 --------------------------------------------------------------------

def _unp_batch_sql(loss_expr: str, with_kl: bool) -> str:
    kl = ("WITH k AS (SELECT batch_id, GREATEST(AVG(policy_kl_logp - reference_kl_logp), 0) AS kl FROM unp_logp "
          "GROUP BY batch_id), u AS (SELECT u.*, k.kl FROM unp_logp u JOIN k USING (batch_id))")
    src = "u" if with_kl else "unp_logp"
    head = kl if with_kl else ""
    return f"""{head}
SELECT batch_id, {'ANY_VALUE(kl)' if with_kl else 'CAST(0.0 AS DOUBLE)'} AS kl, SUM({loss_expr}) AS loss_sum,
       COUNT_IF(label) AS n_chosen, COUNT_IF(NOT label) AS n_rejected,
       SUM(CASE WHEN label THEN 0.1 * (policy_logp - reference_logp) END) AS chosen_reward_sum,
       SUM(CASE WHEN NOT label THEN 0.1 * (policy_logp - reference_logp) END) AS rejected_reward_sum
FROM {src} GROUP BY batch_id"""


def _unp_batch_spark(df, with_kl):
    return df.groupBy("batch_id").agg(
        (F.first("kl") if with_kl else F.lit(0.0)).alias("kl"), F.sum("loss").alias("loss_sum"),
        F.count_if("label").alias("n_chosen"), F.count_if(~F.col("label")).alias("n_rejected"),
        F.sum(F.when(F.col("label"), F.col("reward"))).alias("chosen_reward_sum"),
        F.sum(F.when(~F.col("label"), F.col("reward"))).alias("rejected_reward_sum"))


_D = "(policy_logp - reference_logp)"


@register("kto_loss", _unp_batch_sql(
    f"CASE WHEN label THEN 1 - {sql_sig(f'0.1 * ({_D} - kl)')} ELSE 1.0 * (1 - {sql_sig(f'0.1 * (kl - {_D})')}) END",
    True), ["unp_logp"])
def q_kto_loss(spark, sf_dir):
    return _unp_batch_spark(R.kto_loss(Views(spark, sf_dir).unp_logp(), beta=0.1), True)


@register("apo_zero_unpaired", _unp_batch_sql(
    f"CASE WHEN label THEN 1 - {sql_sig(f'0.1 * {_D}')} ELSE {sql_sig(f'0.1 * {_D}')} END", False), ["unp_logp"])
def q_apo_zero_unpaired(spark, sf_dir):
    return _unp_batch_spark(R.kto_loss(Views(spark, sf_dir).unp_logp(), beta=0.1, loss_type="apo_zero_unpaired"),
                            False)


@register("bco_loss", f"""
WITH r AS (SELECT batch_id, label, 0.1 * {_D} AS reward FROM unp_logp),
b AS (SELECT batch_id, SUM(reward) AS s, COUNT(*) AS n FROM r GROUP BY batch_id),
c AS (SELECT batch_id, SUM(s) OVER (ORDER BY batch_id) / SUM(n) OVER (ORDER BY batch_id) AS delta FROM b)
SELECT r.batch_id, ANY_VALUE(c.delta) AS delta,
       SUM(CASE WHEN label THEN -{sql_logsig('reward - delta')} ELSE -{sql_logsig('-(reward - delta)')} END) AS loss_sum,
       COUNT(*) AS n
FROM r JOIN c USING (batch_id) GROUP BY r.batch_id""", ["unp_logp"])
def q_bco_loss(spark, sf_dir):
    out = R.bco_loss(Views(spark, sf_dir).unp_logp(), beta=0.1)
    return out.groupBy("batch_id").agg(F.first("delta").alias("delta"), F.sum("loss").alias("loss_sum"),
                                       F.count(F.lit(1)).alias("n"))


@register("unpaired_metrics", f"""
WITH k AS (SELECT batch_id, GREATEST(AVG(policy_kl_logp - reference_kl_logp), 0) AS kl FROM unp_logp GROUP BY batch_id),
u AS (SELECT u.label, 0.1 * {_D} AS reward, u.policy_logp AS lp, u.policy_kl_logp - u.policy_logp AS lg,
             CASE WHEN label THEN 1 - {sql_sig(f'0.1 * ({_D} - kl)')} ELSE 1 - {sql_sig(f'0.1 * (kl - {_D})')} END AS loss
      FROM unp_logp u JOIN k USING (batch_id)),
t AS (SELECT SUM(CASE WHEN label THEN reward END) AS cr, COUNT_IF(label) AS cn,
             SUM(CASE WHEN NOT label THEN reward END) AS rr, COUNT_IF(NOT label) AS rn,
             SUM(CASE WHEN label THEN lp END) AS cl, SUM(CASE WHEN NOT label THEN lp END) AS rl,
             SUM(loss) AS ls, COUNT(loss) AS ln,
             SUM(CASE WHEN label THEN lg END) AS cg, SUM(CASE WHEN NOT label THEN lg END) AS rg FROM u)
SELECT * FROM (
  SELECT 'rewards/chosen' AS metric, CASE WHEN cn > 0 THEN cr / cn END AS value FROM t
  UNION ALL SELECT 'rewards/rejected', CASE WHEN rn > 0 THEN rr / rn END FROM t
  UNION ALL SELECT 'rewards/margins', CASE WHEN cn > 0 AND rn > 0 THEN cr / cn - rr / rn END FROM t
  UNION ALL SELECT 'logps/chosen', CASE WHEN cn > 0 THEN cl / cn END FROM t
  UNION ALL SELECT 'logps/rejected', CASE WHEN rn > 0 THEN rl / rn END FROM t
  UNION ALL SELECT 'logits/chosen', CASE WHEN cn > 0 THEN cg / cn END FROM t
  UNION ALL SELECT 'logits/rejected', CASE WHEN rn > 0 THEN rg / rn END FROM t
  UNION ALL SELECT 'loss', ls / ln FROM t
  UNION ALL SELECT 'count/chosen', CAST(cn AS DOUBLE) FROM t
  UNION ALL SELECT 'count/rejected', CAST(rn AS DOUBLE) FROM t) x WHERE value IS NOT NULL""", ["unp_logp"])
def q_unpaired_metrics(spark, sf_dir):
    scored = R.kto_loss(Views(spark, sf_dir).unp_logp(), beta=0.1)
    scored = scored.withColumn("logit", F.col("policy_kl_logp") - F.col("policy_logp"))
    return R.unpaired_metrics(scored, logits="logit")


# -- R8 / R9 / R10 ----------------------------------------------------------------------------

@register("udm_density_ratio", f"""
WITH s AS (SELECT vec_id, label < 5 AS desirable, list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) AS x
           FROM embeddings),
p AS (SELECT vec_id, desirable, {sql_sig('x')} AS p FROM s)
SELECT vec_id, CASE WHEN desirable THEN 1.0 ELSE LEAST(GREATEST(p / (1 - p + 1e-8), 0.5), 10.0) END AS udm_weight
FROM p""")
def q_udm_density_ratio(spark, sf_dir):
    # a fixed linear model over all components, so that SQL can follow; udm_weights has the fitted one
    x = F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("label") < 5).alias("desirable"), (1 / (1 + F.exp(-x))).alias("prob_desirable"))
    return R.udm_density_ratio(e, label="desirable").select("vec_id", "udm_weight")


@register("udm_weights")
def q_udm_weights(spark, sf_dir):
    # a fit in 64 dimensions: no SQL oracle; desirability_probabilities has the same fit in one, udm_density_ratio the formula
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).alias("desirable"))
    _, scored, _ = R.desirability_classifier(e, features="embedding", label="desirable")
    return R.udm_density_ratio(scored, label="desirable").select("vec_id", "desirable", "prob_desirable", "udm_weight")


@register("desirability_classifier")
def q_desirability_classifier(spark, sf_dir):
    # a fit in 64 dimensions: no SQL oracle; tests hold the fit against an independent optimum
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).alias("desirable"))
    _, _, acc = R.desirability_classifier(e, features="embedding", label="desirable")
    return acc


@register("desirability_probabilities", """
WITH RECURSIVE e AS (
  SELECT vec_id, list_sum(list_transform(embedding, lambda v: v::DOUBLE)) AS x, (label < 5)::INT AS y FROM embeddings),
c AS (SELECT y, COUNT(*) AS nc FROM e GROUP BY y),
d AS (SELECT vec_id, x, y, (SELECT COUNT(*) FROM e) / (2.0::DOUBLE * nc) AS w FROM e JOIN c USING (y)),
steps(k, b0, b1) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT k, b0, b1, SUM(w * (p - y)) AS g0, SUM(w * (p - y) * x) + b1 AS g1, SUM(w * p * (1 - p)) AS h00,
               SUM(w * p * (1 - p) * x) AS h01, SUM(w * p * (1 - p) * x * x) + 1 AS h11
        FROM (SELECT k, b0, b1, x, y, w, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM steps, d WHERE k < 20) GROUP BY k, b0, b1))
SELECT vec_id, 1 / (1 + exp(-(b0 + b1 * x))) AS prob_desirable FROM d, (SELECT b0, b1 FROM steps WHERE k = 20)""")
def q_desirability_probabilities(spark, sf_dir):
    # the fit over one feature, the sum of the components, so that SQL can take the same Newton steps
    x = F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.array(x).alias("sum"), (F.col("label") < 5).alias("desirable"))
    _, scored, _ = R.desirability_classifier(e, features="sum", label="desirable")
    return scored.select("vec_id", "prob_desirable")


@register("desirable_weight_bounds", """
WITH c AS (SELECT GREATEST(COUNT_IF(label), 1) AS nd, COUNT(*) AS n FROM unp_logp),
d AS (SELECT nd AS num_desirable, GREATEST(n - nd, 1) AS num_undesirable FROM c),
b AS (SELECT *, round_even(num_undesirable * 1.0 / num_desirable * 1, 2) AS des_lower,
             round_even(num_undesirable * 1.0 / num_desirable * 1.33, 2) AS des_upper,
             round_even(num_desirable * 1.0 / num_undesirable / 1.33, 2) AS und_lower,
             round_even(num_desirable * 1.0 / num_undesirable / 1, 2) AS und_upper FROM d)
SELECT *, num_desirable <> num_undesirable AND NOT ((des_lower <= 1.0 AND 1.0 <= des_upper)
          OR (und_lower <= 1.0 AND 1.0 <= und_upper)) AS advise FROM b""", ["unp_logp"])
def q_desirable_weight_bounds(spark, sf_dir):
    return R.desirable_weight_bounds(Views(spark, sf_dir).unp_logp())


# -- R11 / R12 / R13 / R14 / R16 ----------------------------------------------------------------

@register("reward_pairwise_loss", f"""
SELECT l_orderkey % 8 AS grp, -AVG({sql_logsig('chosen_logp - rejected_logp - margin')})
       + 0.01 * AVG((chosen_logp + rejected_logp) ** 2) AS loss, COUNT(*) AS n
FROM pair_logp GROUP BY 1""", ["pair_logp"])
def q_reward_pairwise_loss(spark, sf_dir):
    p = Views(spark, sf_dir).pair_logp().withColumn("grp", F.col("l_orderkey") % 8)
    return R.reward_pairwise_loss(p, chosen="chosen_logp", rejected="rejected_logp", margin="margin",
                                  center_coef=0.01, group="grp")


@register("preference_softmax", f"""
SELECT {_KEYS}, 1 / (1 + exp(rejected_logp - chosen_logp)) AS p_chosen, chosen_logp > rejected_logp AS chosen_wins
FROM pair_logp""", ["pair_logp"])
def q_preference_softmax(spark, sf_dir):
    p = R.preference_softmax(Views(spark, sf_dir).pair_logp(), chosen="chosen_logp", rejected="rejected_logp")
    return p.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_chosen", "chosen_wins")


@register("token_accuracy", """
WITH s AS (SELECT CASE WHEN step = 1 THEN -100 ELSE label END AS label,
                  CAST(LENGTH(completion) % 3 = 0 AS BIGINT) AS pred FROM steps)
SELECT AVG(CASE WHEN label <> -100 THEN CAST(pred = label AS DOUBLE) END) AS accuracy, COUNT_IF(label <> -100) AS n
FROM s""", ["steps"])
def q_token_accuracy(spark, sf_dir):
    s = Views(spark, sf_dir).steps().select(
        F.when(F.col("step") == 1, F.lit(-100)).otherwise(F.col("label")).alias("label"),
        (F.length("completion") % 3 == 0).cast("bigint").alias("pred"))
    return R.token_accuracy(s)


@register("pair_metrics", """
WITH p AS (SELECT CASE WHEN l_orderkey % 10 = 0 THEN 'eval' ELSE 'train' END AS split, chosen_logp, rejected_logp,
                  0.1 * chosen_logp AS cr, 0.1 * rejected_logp AS rr, margin FROM pair_logp),
w AS (SELECT split, AVG(cr) AS rc, AVG(rr) AS rj, AVG(CAST(cr > rr AS DOUBLE)) AS acc, AVG(cr - rr) AS mg,
             AVG(chosen_logp) AS lc, AVG(rejected_logp) AS lr, AVG(-chosen_logp) AS nll,
             AVG(chosen_logp + margin) AS gc, AVG(rejected_logp - margin) AS gr FROM p GROUP BY split),
l AS (SELECT split, 'rewards/chosen' AS metric, rc AS value FROM w
      UNION ALL SELECT split, 'rewards/rejected', rj FROM w UNION ALL SELECT split, 'rewards/accuracies', acc FROM w
      UNION ALL SELECT split, 'rewards/margins', mg FROM w UNION ALL SELECT split, 'logps/chosen', lc FROM w
      UNION ALL SELECT split, 'logps/rejected', lr FROM w UNION ALL SELECT split, 'nll_loss', nll FROM w
      UNION ALL SELECT split, 'logits/chosen', gc FROM w UNION ALL SELECT split, 'logits/rejected', gr FROM w)
SELECT split, CASE WHEN split = 'eval' THEN 'eval_' || metric ELSE metric END AS metric, value FROM l""",
          ["pair_logp"])
def q_pair_metrics(spark, sf_dir):
    p = Views(spark, sf_dir).pair_logp().withColumn(
        "split", F.when(F.col("l_orderkey") % 10 == 0, "eval").otherwise("train"))
    p = R.cpo_loss(p, beta=0.1).withColumn("nll", -F.col("chosen_logp"))
    p = (p.withColumn("chosen_logit", F.col("chosen_logp") + F.col("margin"))
         .withColumn("rejected_logit", F.col("rejected_logp") - F.col("margin")))
    return R.pair_metrics(p, nll="nll", chosen_logits="chosen_logit", rejected_logits="rejected_logit")


@register("log_mean", """
SELECT mode, CASE WHEN mode = 'eval' THEN 'eval_' || metric ELSE metric END AS metric, AVG(val) AS mean, COUNT(*) AS n
FROM steplog GROUP BY mode, metric""", ["steplog"])
def q_log_mean(spark, sf_dir):
    return R.log_mean(Views(spark, sf_dir).steplog())


@register("log_mean_by_epoch", """
WITH l AS (SELECT epoch, inner_epoch, step // 5 AS log_id, val, CASE WHEN step % 7 = 0 THEN 'loss' ELSE metric END AS metric
           FROM steplog),
m AS (SELECT *, CASE WHEN MAX(CASE WHEN metric = 'loss' THEN 1 ELSE 0 END) OVER (PARTITION BY log_id) = 1
                THEN 'train' ELSE 'eval' END AS mode FROM l)
SELECT mode, epoch, inner_epoch, CASE WHEN mode = 'eval' THEN 'eval_' || metric ELSE metric END AS metric,
       AVG(val) AS mean, COUNT(*) AS n
FROM m GROUP BY mode, epoch, inner_epoch, metric""", ["steplog"])
def q_log_mean_by_epoch(spark, sf_dir):
    # five steps make one log record; those that log a loss are training records
    logs = Views(spark, sf_dir).steplog().drop("mode").withColumn("log_id", F.floor(F.col("step") / 5)).withColumn(
        "metric", F.when(F.col("step") % 7 == 0, "loss").otherwise(F.col("metric")))
    return R.log_mean(R.with_log_mode(logs), by=("epoch", "inner_epoch"))

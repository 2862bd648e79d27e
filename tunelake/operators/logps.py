"""Log-probabilities and token-level numerics (L*).

Two layouts:
* array form - one row per token position with its logits as an array
  (vocabularies up to a few thousand entries): higher-order functions;
* long form - one row per (sequence, position[, vocab id]): grouped
  aggregates, partial per task, for large vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import IGNORE_INDEX


def _arr_sum(a):
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def scale_logits(logits, multiply=0.0, divide=0.0, softcap=0.0, temperature=1.0, standard=False):
    """x * m (m != 0), / d (d != 0), soft-cap, / T, in that order. The cap is
    ``x * tanh(x / cap)`` as the training code writes it, or
    ``cap * tanh(x / cap)`` with ``standard=True``."""
    x = F.transform(logits, lambda v: v.cast("double"))
    if multiply:
        x = F.transform(x, lambda v: v * multiply)
    if divide:
        x = F.transform(x, lambda v: v / divide)
    if softcap:
        if standard:
            x = F.transform(x, lambda v: F.lit(softcap) * F.tanh(v / softcap))
        else:
            x = F.transform(x, lambda v: v * F.tanh(v / softcap))
    if temperature != 1.0:
        x = F.transform(x, lambda v: v / temperature)
    return x


def log_sum_exp(arr):
    """One pass, running (max, scaled sum): no value from outside the lambda
    is read per element (Catalyst would inline it and re-evaluate it for
    every element)."""
    init = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s"))

    def step(acc, x):
        m = F.greatest(acc["m"], x)
        return F.struct(m.alias("m"), (acc["s"] * F.exp(acc["m"] - m) + F.exp(x - m)).alias("s"))

    return F.aggregate(arr, init, step, lambda acc: acc["m"] + F.log(acc["s"]))


def _minus_each(arr, scalar):
    """arr[i] - scalar, with the scalar computed once per row."""
    return F.zip_with(arr, F.array_repeat(scalar, F.size(arr)), lambda v, c: v - c)


def log_softmax(arr):
    return _minus_each(arr, log_sum_exp(arr))


def selective_log_softmax(df: DataFrame, logits="logits", target="target", out="logp", **scale) -> DataFrame:
    """logit[target] - logsumexp(logits) per row (array form)."""
    x = scale_logits(F.col(logits), **scale)
    return (df.withColumn("_x", x).withColumn("_lse", log_sum_exp(F.col("_x")))
            .withColumn(out, F.element_at("_x", F.col(target).cast("int") + 1) - F.col("_lse"))
            .drop("_x", "_lse"))


def selective_log_softmax_long(long: DataFrame, keys, vocab="vocab_id", logit="logit",
                               target="target") -> DataFrame:
    """Long form: rows (keys..., vocab_id, logit, target). Max and the sum of
    shifted exponentials are aggregates per position."""
    keys = list(keys)
    mx = long.groupBy(*keys).agg(F.max(logit).alias("_mx"))
    j = long.join(mx, keys)
    return j.groupBy(*keys).agg(
        (F.first("_mx") + F.log(F.sum(F.exp(F.col(logit) - F.col("_mx"))))).alias("_lse"),
        F.max(F.when(F.col(vocab) == F.col(target), F.col(logit))).alias("_sel")).select(
        *keys, (F.col("_sel") - F.col("_lse")).alias("logp"))


def token_entropy(df: DataFrame, logits="logits", out="entropy") -> DataFrame:
    """logsumexp(l) - sum softmax(l) * l."""
    # the log-sum-exp is its own column so the lambda reads it, not recomputes it
    d = (df.withColumn("_x", F.transform(F.col(logits), lambda v: v.cast("double")))
         .withColumn("_lse", log_sum_exp(F.col("_x"))))
    ent = F.col("_lse") - _arr_sum(F.zip_with(
        "_x", F.array_repeat(F.col("_lse"), F.size("_x")), lambda v, c: F.exp(v - c) * v))
    return d.withColumn(out, ent).drop("_x", "_lse")


def shifted_labels(tokens: DataFrame, seq="seq_id", pos="pos", token="token_id",
                   ignore=None, shift=True) -> DataFrame:
    """Attach ``label`` = the token one position later (decoder shift; a
    sequence is one window) or the same position (``shift=False``,
    encoder-decoder). ``ignore(label_col)`` marks labels to ignore (-100);
    the last position of a shifted sequence has none and is ignored, so that
    every sequence keeps its rows."""
    if shift:
        nxt = F.lead(token).over(Window.partitionBy(seq).orderBy(pos))
        out = tokens.withColumn("_lab", F.coalesce(nxt, F.lit(IGNORE_INDEX)))
    else:
        out = tokens.withColumn("_lab", F.col(token))
    lab = F.col("_lab")
    if ignore is not None:
        lab = F.when((lab == IGNORE_INDEX) | ignore(lab), F.lit(IGNORE_INDEX)).otherwise(lab)
    return out.withColumn("label", lab.cast("bigint")).drop("_lab")


def sequence_logps(labeled: DataFrame, seq="seq_id", logp="logp", label="label") -> DataFrame:
    """Per sequence: sum of per-token log-probs over labels != -100 (0 if there
    is none), their count and mean (null if there is none)."""
    m = F.col(label) != IGNORE_INDEX
    return labeled.groupBy(seq).agg(
        F.coalesce(F.sum(F.when(m, F.col(logp))), F.lit(0.0)).alias("logps_sum"),
        F.count_if(m).alias("n_tokens")).withColumn(
        "logps_mean", F.try_divide("logps_sum", "n_tokens"))


def chosen_nll(tokens: DataFrame, logp="logp", mask=None, group=None) -> DataFrame:
    """Token-mean cross-entropy (micro average over all unmasked tokens)."""
    m = mask if mask is not None else F.lit(True)
    aggs = [(-F.sum(F.when(m, F.col(logp))) / F.count_if(m)).alias("nll"), F.count_if(m).alias("n_tokens")]
    return tokens.groupBy(group).agg(*aggs) if group else tokens.agg(*aggs)


def dft_loss(tokens: DataFrame, logp="logp", mask=None) -> DataFrame:
    """Probability-weighted NLL: token mean of -p * log p."""
    m = mask if mask is not None else F.lit(True)
    lp = F.col(logp)
    return tokens.agg(F.avg(F.when(m, -F.exp(lp) * lp)).alias("dft_loss"), F.count_if(m).alias("n_tokens"))


def kl_estimators(tokens: DataFrame, logp="logp", ref_logp="ref_logp", group=None) -> DataFrame:
    """approx_kl = 0.5 * mean((lp - ref)^2); k1 = -logr; k3 = exp(logr) - 1 - logr
    with logr = ref - lp."""
    logr = F.col(ref_logp) - F.col(logp)
    aggs = [(0.5 * F.avg((F.col(logp) - F.col(ref_logp)) ** 2)).alias("approx_kl"),
            F.avg(-logr).alias("kl_k1"), F.avg(F.exp(logr) - 1 - logr).alias("kl_k3")]
    return tokens.groupBy(group).agg(*aggs) if group else tokens.agg(*aggs)


def jsd_pairs(student: DataFrame, teacher: DataFrame, key, logits="logits", label="label",
              temperature=1.0) -> DataFrame:
    """Student and teacher log-softmax arrays (``_ls``, ``_lt``) side by side,
    joined on the position key."""
    def lsm(df, name, *keep):
        d = (df.select(key, *keep, F.transform(logits, lambda v: v.cast("double") / temperature).alias("_x"))
             .withColumn("_lse", log_sum_exp(F.col("_x"))))
        return d.select(key, *keep, _minus_each(F.col("_x"), F.col("_lse")).alias(name))

    return lsm(student, "_ls", label).join(lsm(teacher, "_lt"), key)


def jsd_expr(beta: float, ls="_ls", lt="_lt"):
    """Per-position divergence summed over the vocabulary. beta = 0:
    KL(teacher || student); beta = 1: KL(student || teacher); otherwise
    beta * KL(t || m) + (1 - beta) * KL(s || m) with the mixture m."""
    def kl(target, inp):  # sum exp(target) * (target - inp)
        return F.zip_with(target, inp, lambda a, b: F.exp(a) * (a - b))

    if beta == 0:
        el = kl(F.col(lt), F.col(ls))
    elif beta == 1:
        el = kl(F.col(ls), F.col(lt))
    else:
        import math

        lb, l1b = math.log(beta), math.log(1 - beta)
        mix = F.zip_with(ls, lt, lambda a, b: F.greatest(a + l1b, b + lb) + F.log1p(
            F.exp(-F.abs((a + l1b) - (b + lb)))))
        el = F.zip_with(kl(F.col(lt), mix), kl(F.col(ls), mix), lambda x, y: beta * x + (1 - beta) * y)
    return _arr_sum(el)


def generalized_jsd(student: DataFrame, teacher: DataFrame, key, logits="logits", label="label",
                    betas=(0.5,), temperature=1.0) -> DataFrame:
    """One row per beta: the generalised Jensen-Shannon divergence over the
    positions whose label is not masked, as sum, per position (batchmean) and
    per element (mean). One join and one aggregate serve all betas."""
    m = F.col(label) != IGNORE_INDEX
    j = jsd_pairs(student, teacher, key, logits, label, temperature)
    j = j.select(label, F.size("_ls").alias("_nv"), *[jsd_expr(b).alias(f"_j{i}") for i, b in enumerate(betas)])
    agg = j.agg(F.count_if(m).alias("_n"), F.sum(F.when(m, F.col("_nv"))).alias("_nv"),
                *[F.sum(F.when(m, F.col(f"_j{i}"))).alias(f"_s{i}") for i in range(len(betas))])
    rows = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("beta"), F.col(f"_s{i}").alias("s"))
                               for i, b in enumerate(betas)])).alias("r")
    return agg.select("_n", "_nv", rows).select(
        "r.beta", (F.col("r.s") / F.col("_n")).alias("jsd_batchmean"), F.col("r.s").alias("jsd_sum"),
        (F.col("r.s") / F.col("_nv")).alias("jsd_mean"))

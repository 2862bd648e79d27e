"""Rollout operators on literal sequences: stop handling, EOS penalty,
GAE against the plain recursion."""

from tunelake.operators import rollout as G


def test_postprocess_stop_and_penalty(spark):
    rows = [(1, p, t, -0.5, 0.1, 2.0) for p, t in enumerate([5, 6, 1, 7, 8])] + \
           [(2, p, t, -0.5, 0.1, 2.0) for p, t in enumerate([5, 6, 7])]
    df = spark.createDataFrame(rows, ["seq_id", "pos", "token", "logp", "val", "score"])
    out = {(r.seq_id, r.pos): r for r in G.rollout_postprocess(df).collect()}
    assert out[(1, 3)].post_token == 0 and out[(1, 2)].post_token == 1
    assert out[(1, 0)].seq_len == 2 and out[(1, 0)].contains_eos and out[(1, 0)].score_adj == 2.0
    assert out[(2, 0)].seq_len == 2 and not out[(2, 0)].contains_eos and out[(2, 0)].score_adj == 1.0
    assert out[(1, 3)].masked_logp == G.INVALID_LOGPROB and out[(1, 3)].masked_val == 0.1
    assert out[(1, 4)].masked_val == 0.0


def test_gae_matches_recursion(spark):
    rewards = [0.5, -0.2, 0.1, 1.0]
    values = [0.3, 0.1, -0.4, 0.2]
    rows = [(7, p, r, v) for p, (r, v) in enumerate(zip(rewards, values))]
    df = spark.createDataFrame(rows, ["seq_id", "pos", "reward", "val"])
    got = {r.pos: r.advantage for r in G.gae(df, gamma=0.9, lam=0.8).collect()}
    last, want = 0.0, {}
    for t in reversed(range(4)):
        nv = values[t + 1] if t + 1 < 4 else 0.0
        last = rewards[t] + 0.9 * nv - values[t] + 0.9 * 0.8 * last
        want[t] = last
    assert all(abs(got[t] - want[t]) < 1e-12 for t in range(4))


def test_pads_have_no_kl_and_rewards_reach_real_tokens_only(spark):
    # stop at position 1; the two pads have log-probs that must not count
    tok = [(1, p, t, lp, ref, 0.0, 1.5) for p, (t, lp, ref) in enumerate(
        [(5, -0.5, -0.7), (1, -0.2, -0.2), (8, -3.0, -0.1), (9, -2.0, -0.1)])]
    df = spark.createDataFrame(tok, ["seq_id", "pos", "token", "logp", "ref_logp", "val", "score"])
    shaped = G.shaped_rewards(G.rollout_postprocess(df), score="score_adj", kl_coef=0.05)
    rows = {r["pos"]: r for r in shaped.collect()}
    assert [round(rows[i]["reward"], 6) for i in range(4)] == [-0.01, 0.0, 1.5, 0.0]
    k3 = {r["pos"]: r["reward"] for r in G.shaped_rewards(G.rollout_postprocess(df), score="score_adj", estimator="k3").collect()}
    import math
    assert abs(k3[0] + 0.05 * (math.exp(-0.2) - 1 + 0.2)) < 1e-12 and k3[3] == 0.0
    adv = {r["pos"]: r["advantage"] for r in G.gae(shaped, value="masked_val", gamma=1.0, lam=0.95).collect()}
    assert [round(adv[i], 6) for i in range(4)] == [round(-0.01 + 1.5 * 0.95 ** 2, 6), 1.425, 1.5, 0.0]


def test_epoch_metrics_count_eos_tokens(spark):
    tok = [(s, p, t, -0.1, -0.2, 0.0, 1.0) for s in (1, 2) for p, t in enumerate([5, 1, 1])]
    df = spark.createDataFrame(tok, ["seq_id", "pos", "token", "logp", "ref_logp", "val", "score"]).selectExpr("*", "0 as batch_id", "seq_id as minibatch")
    r = G.ppo_epoch_metrics(G.rollout_postprocess(df)).collect()[0]
    assert r["eos_count"] == 4 and abs(r["val_ratio_var"]) < 1e-12
    one = G.ppo_epoch_metrics(G.rollout_postprocess(df.where("seq_id = 1"))).collect()[0]
    assert one["val_ratio_var"] is None


def test_update_metrics_leave_padding_out(spark):
    import math

    # two minibatches; the second has a pad with log-probs and values that must not count
    rows = [(0, 0, -1.0, -1.0, 1.0, 0.5, 0.5, 1.0, 2.0, False, False), (0, 1, -0.5, -1.0, 1.0, 0.5, 0.9, 1.0, 2.0, False, False),
            (0, 1, -9.0, 1.0, 7.0, 8.0, 0.0, 0.0, 4.0, True, True)]
    df = spark.createDataFrame(rows, ["batch_id", "minibatch", "new_logp", "masked_logp", "advantage", "vpred", "masked_val",
                                      "return", "entropy", "padding_mask", "padding_mask_p1"])
    r = G.ppo_update_metrics(df).collect()[0]
    assert abs(r["loss_policy_avg"] - (-1.0 - 1.2) / 2) < 1e-12 and r["policy_clipfrac_avg"] == 0.5
    assert abs(r["policy_approxkl_avg"] - (0.0 + 0.5 * 0.25 / 2) / 2) < 1e-12
    # minibatch 1: value 0.5 against 1.0 is worse than its clipped 0.7
    assert abs(r["loss_value_avg"] - 0.5 * 0.25) < 1e-12 and r["val_clipfrac_avg"] == 0.0
    assert r["policy_entropy_avg"] == 2.5
    means = [1.0, (math.exp(0.5) + 1.0) / 2]
    assert abs(r["val_ratio"] - sum(means) / 2) < 1e-12
    assert abs(r["val_ratio_var"] - (means[1] - means[0]) ** 2 / 2) < 1e-12

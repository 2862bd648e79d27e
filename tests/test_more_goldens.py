"""Goldens for the remaining operators (literal rows, hand-computed)."""

import math

import numpy as np
from pyspark.sql import functions as F
import pandas as pd

from tunelake.operators import losses as R
from tunelake.operators import packing as PK
from tunelake.operators import prompt as P
from tunelake.operators import report as M
from tunelake.operators import rollout as G
from tunelake.operators import tokens as K


def test_assistant_mask_counts(spark):
    df = spark.createDataFrame(
        [([("user", "hi there"), ("assistant", "a b c")],)],
        "messages array<struct<role:string,content:string>>")
    r = K.assistant_mask(df).collect()[0]
    # rendered user message: '<|im_start|>user\nhi there<|im_end|>\n' -> 3 whitespace tokens
    assert len(r.tokens) == 3 + 4 and r.assistant_masks == [0, 0, 0, 1, 1, 1, 1]


def test_pair_boundary_moves_back(spark):
    df = spark.createDataFrame([("Say hi", "!", " ok")], ["prompt", "chosen", "rejected"])
    r = K.pair_boundary_audit(df).collect()[0]
    # 'Say hi!' merges the last prompt word; 'Say hi ok' keeps it
    assert (r.boundary_chosen, r.boundary_rejected, r.violation) == (1, 2, False)


def test_review_table_layout(spark):
    preds = spark.createDataFrame([(i, m, f"q{i}", f"r{i}", f"{m}{i}") for i in range(12) for m in ("a", "b")],
                                  ["row_id", "model", "instruction", "reference", "prediction"])
    out = M.review_table(preds, ("a", "b"), k=5)
    assert out.columns == ["row_id", "instruction", "reference", "a", "a_helpfulness (1-5)",
                           "a_factuality (1-5)", "a_instruction_following (1-5)", "b", "b_helpfulness (1-5)",
                           "b_factuality (1-5)", "b_instruction_following (1-5)"]
    rows = out.collect()
    assert len(rows) == 5 and all(r.a == f"a{r.row_id}" and r["b_factuality (1-5)"] == "" for r in rows)


def test_server_reported_missing_fields(spark):
    df = spark.createDataFrame([("m", '{"eval_count": 10, "eval_duration": 2000000000}', 2.0 * 2 ** 30, 1.0, 3.0),
                                ("m", '{}', 0.0, float(2 ** 30), 1.0)],
                               ["model", "response", "mem_before", "mem_after", "latency_s"])
    r = M.bench_server_reported(df).collect()[0]
    # second request: count 0, duration 1 ns -> throughput 0
    assert math.isclose(r.throughput_tok_s, (5.0 + 0.0) / 2)
    assert math.isclose(r.peak_ram_gb, (2.0 + 1.0) / 2)
    assert r.latency_s == 2.0  # the client's wall time, not the server's counter


def test_grid_names_and_best_run(spark):
    g = M.param_grid(spark, ranks=(8,), alpha_factors=(2,), lrs=(1e-5, 2e-4)).collect()
    assert sorted(r.run for r in g) == ["r8_a16_lr00002", "r8_a16_lr1e05"]
    runs = spark.createDataFrame([("b", "U", 1.0), ("a", "U", 1.0), ("c", "P", 0.5)], ["run", "toolkit", "eval_loss"])
    best = {r.toolkit: r.best_run for r in M.best_run(runs).collect()}
    assert best == {"U": "a", "P": "c"}


def test_reverse_mismatch_and_mix(spark):
    df = spark.createDataFrame([(i, f"c{i}") for i in range(8)], ["row_id", "completion"])
    out = PK.kl_mismatch_pairs(df, batch_size=4, mode="reverse").toPandas()
    for _, b in out.groupby("batch_id"):
        pos = dict(zip(b.batch_pos, b.row_id))
        assert all(pos[3 - p] == k for p, k in zip(b.batch_pos, b.kl_row_id))
    rows = spark.createDataFrame([(0, "ref", "stu", "tea"), (1, "ref", "stu", "tea")],
                                 ["batch_id", "reference", "student", "teacher"])
    got = PK.on_policy_mix(rows, lmbda=0.0, seq_kd=True).collect()
    assert all(r.text == "tea" and r.text_source == "teacher" for r in got)
    got = PK.on_policy_mix(rows, lmbda=1.0).collect()
    assert all(r.text == "stu" for r in got)


def test_weight_bounds_advice(spark):
    df = spark.createDataFrame([(True,)] * 10 + [(False,)] * 2, ["label"])
    r = R.desirable_weight_bounds(df).collect()[0]
    assert (r.des_lower, r.des_upper, r.und_lower, r.und_upper) == (0.2, 0.27, 3.76, 5.0)
    assert r.advise is True


def test_advantage_per_prompt_brute_force(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, int(rnd.integers(0, 3)), i // 10, float(rnd.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, ["event_id", "prompt_id", "batch_id", "reward"])
    got = {r.event_id: r.advantage for r in G.advantage_per_prompt(df, buffer_size=4, min_count=4).collect()}
    pdf = pd.DataFrame(rows, columns=["event_id", "prompt_id", "batch_id", "reward"])
    bufs, want = {}, {}
    for b, part in pdf.groupby("batch_id"):
        gm, gs = part.reward.mean(), part.reward.std(ddof=0)
        stats = {}
        for p, pp in part.groupby("prompt_id"):
            bufs.setdefault(p, []).extend(pp.reward.tolist())
            buf = bufs[p][-4:]
            stats[p] = (len(bufs[p]) >= 4, np.mean(buf), np.std(buf))
        for e, p, r in zip(part.event_id, part.prompt_id, part.reward):
            own, m, s = stats[p]
            want[e] = (r - m) / (s + 1e-6) if own else (r - gm) / (gs + 1e-6)
    assert set(got) == set(want)
    assert all(abs(got[e] - want[e]) < 1e-9 for e in want)


def test_split_last_turn_and_template(spark):
    df = spark.createDataFrame([([("system", "s"), ("user", "u"), ("assistant", "a")],)],
                               "messages array<struct<role:string,content:string>>")
    r = P.split_last_turn(df).collect()[0]
    assert r.prompt_text == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n"
    assert r.completion_text == "<|im_start|>assistant\na<|im_end|>\n" and r.completion_role == "assistant"
    t = P.apply_chat_template(df, add_generation_prompt=True).collect()[0].text
    assert t.endswith("<|im_start|>assistant\n")


def test_ppo_losses_by_hand(spark):
    import math as m

    rows = [(m.log(1.5), 0.0, 1.0, 0.5, 0.3, 1.0), (m.log(0.5), 0.0, -1.0, 0.1, 0.4, 0.0)]
    df = spark.createDataFrame(rows, ["logp", "old_logp", "advantage", "vpred", "val", "return"])
    p = G.ppo_policy_loss(df, cliprange=0.2).collect()[0]
    # row 1: ratio 1.5 -> max(-1.5, -1.2) = -1.2 (clipped); row 2: ratio 0.5 -> max(0.5, 0.8) = 0.8 (clipped)
    assert math.isclose(p.pg_loss, (-1.2 + 0.8) / 2) and p.pg_clipfrac == 1.0
    v = G.ppo_value_loss(df, cliprange_value=0.2).collect()[0]
    # row 1: vpred 0.5 within 0.3 +- 0.2 -> (0.5-1)^2 both; row 2: 0.1 clipped to 0.2 -> max(0.01, 0.04)
    assert math.isclose(v.vf_loss, 0.5 * (0.25 + 0.04) / 2) and v.vf_clipfrac == 0.5
    c = G.clipped_surrogate(df.withColumn("advantage", F.col("advantage") * 10), clip_range=0.1).collect()[0]
    # advantages clamp to +-5; row 1: max(-7.5, -5.5) = -5.5; row 2: max(2.5, 4.5) = 4.5
    assert math.isclose(c.loss, (-5.5 + 4.5) / 2) and c.clipfrac == 1.0


def test_format_profile_precedence(spark):
    df = spark.createDataFrame(
        [("s", [1], [2], None, None, None), ("s", None, [2], "p", "c", None), ("s", None, None, "p", "c", "t"),
         ("s", None, None, None, None, "t"), ("s", None, None, None, None, None)],
        "source string, labels array<int>, input_ids array<int>, prompt string, completion string, text string")
    got = {r.format: r.n for r in P.format_profile(df).collect()}
    assert got == {"labels": 1, "tokenized": 1, "prompt_completion": 1, "language_modeling": 1,
                   "needs_formatter": 1}


def test_bert_score_chunks_equal_single_chunk(spark):
    from tunelake.operators.textmetric import bert_score
    from tunelake.sources.views import Views
    from tests.conftest import SF_CHECK

    e = Views(spark, SF_CHECK).emb_tokens()
    one = {r.example_id: r.bert_f1 for r in bert_score(e, chunk=512).collect()}
    many = {r.example_id: r.bert_f1 for r in bert_score(e, chunk=2).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-12 for k in one)


def test_model_output_of_any_type_joined_back(spark):
    from pyspark.sql import types as T

    from tunelake.operators import apply as A

    df = spark.createDataFrame([(1, "ab cd abc"), (2, ""), (3, None), (None, "x")], "row_id long, text string")
    out = A.with_model_output(df, "m", A.stub_embedder(4), out="e", out_type=T.ArrayType(T.DoubleType()))
    got = {r["row_id"]: r["e"] for r in out.collect()}
    assert got == {1: [0.0, 0.0, 2.0, 1.0], 2: [0.0] * 4, 3: [0.0] * 4, None: None}
    assert A.with_model_output(df.limit(0), "m", A.stub_reward, out_type=T.DoubleType()).count() == 0


def test_models_are_cached_by_name_and_version():
    from tunelake.operators import apply as A

    made = []

    def factory(tag):
        return lambda: made.append(tag) or tag

    assert [A._cached("m", "1", factory("a")), A._cached("m", "1", factory("b")), A._cached("m", "2", factory("c"))] == ["a", "a", "c"]
    assert made == ["a", "c"] and A._MODEL_CACHE["m"] == ("2", "c")

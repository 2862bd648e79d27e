"""Newton logistic regression against an independent optimum; per-row template arguments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunelake.operators import losses as R
from tunelake.operators import prompt as P


def rows(n=300, d=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 3, 0.1, 1, 1, 5][:d]
    y = rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * x[:, 1] + 0.5)))
    return x, y


def test_fit_is_the_optimum(spark):
    x, y = rows()
    w = np.where(y, len(y) / 2 / y.sum(), len(y) / 2 / (~y).sum())
    df = spark.createDataFrame([(i, v.tolist(), bool(c)) for i, (v, c) in enumerate(zip(x, y))] + [(-1, None, True), (-2, [0.0] * 6, None), (-3, [1.0], False)],
                               "i long, embedding array<double>, label boolean").repartition(5)
    weighted = df.withColumn("w", F.when(F.col("label"), float(w[y][0])).otherwise(float(w[~y][0])))
    fit = R.fit_logistic(weighted, "embedding", "label", "w")
    # an independent optimum: plain gradient descent with momentum on the same convex loss, then its gradient must vanish
    one = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(7)
    for _ in range(200):
        p = 1 / (1 + np.exp(-(one @ beta)))
        g = one.T @ (w * (p - y)) + np.r_[0.0, beta[1:]]
        h = (one * (w * p * (1 - p))[:, None]).T @ one + np.diag(np.r_[0.0, np.ones(6)])
        beta = beta - 0.5 * np.linalg.solve(h, g)
    assert np.abs(g).max() < 1e-9
    assert fit.intercept == pytest.approx(beta[0], abs=1e-8) and fit.weights == pytest.approx(beta[1:].tolist(), abs=1e-8)
    assert fit.steps < 15
    got = {r.i: r.p for r in df.where("size(embedding) = 6").select("i", R.logistic_probability(F.col("embedding"), fit).alias("p")).collect()}
    assert all(got[i] == pytest.approx(1 / (1 + np.exp(-one[i] @ beta)), abs=1e-8) for i in range(len(x)))


def test_classes_that_a_line_separates_and_one_class(spark):
    df = spark.createDataFrame([([float(i)], i > 0) for i in range(-20, 21)], "embedding array<float>, label boolean")
    fit, scored, acc = R.desirability_classifier(df)
    assert np.isfinite(fit.weights).all() and {r.label: r.accuracy for r in acc.collect()} == {True: 1.0, False: 1.0}
    fit, _, _ = R.desirability_classifier(df.where("label"), max_iter=20)
    assert np.isfinite([fit.intercept, *fit.weights]).all()


def test_rows_render_with_their_own_arguments_and_tools(spark):
    m = [("user", "hi"), ("assistant", "yo")]
    df = spark.createDataFrame(
        [(1, m, {"day": "Monday"}, ["a", "b"], True), (2, m, {}, [], False), (3, [], None, None, True)],
        "i long, messages array<struct<role string, content string>>, args map<string,string>, tools array<string>, more boolean")
    t = {"head": "{day}! ", "start": "<", "role_sep": ":", "end": ">", "generation_prompt": "<bot:", "tools_start": "T(", "tool_sep": "|", "tools_end": ")"}
    def texts(df):
        got = P.apply_chat_template(df, template=t, add_generation_prompt=F.col("more"), args="args", tools="tools")
        return {r.i: r.text for r in got.collect()}
    want = {1: "Monday! T(a|b)<user:hi><assistant:yo><bot:", 2: "! <user:hi><assistant:yo>", 3: "! <bot:"}
    assert texts(df) == want
    assert texts(df.withColumn("tools", F.to_json("tools"))) == want

"""Text metrics: ROUGE-L against a brute-force dynamic programme, BLEU
boundary goldens, Porter stemmer examples from the 1980 paper."""

import random

import pytest

from tunelake.functions.porter import stem
from tunelake.operators.textmetric import lcs_length, rouge_l, rouge_l_f, rouge_tokens, sentence_bleu


def _lcs_dp(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            dp[i][j] = dp[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(dp[i - 1][j], dp[i][j - 1])
    return dp[-1][-1]


def test_lcs_bit_parallel_equals_dp():
    rnd = random.Random(1)
    for _ in range(300):
        a = [rnd.choice("abcde") for _ in range(rnd.randint(0, 40))]
        b = [rnd.choice("abcde") for _ in range(rnd.randint(0, 40))]
        assert lcs_length(a, b) == _lcs_dp(a, b)


@pytest.mark.parametrize("word,expected", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
    ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"),
    ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("generalization", "gener"),
    ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("adoption", "adopt"),
    ("controll", "control"), ("roll", "roll"), ("probate", "probat")])
def test_porter_examples(word, expected):
    assert stem(word) == expected


def test_rouge_udf_matches_python(spark):
    from tests.conftest import SF_SMALL
    from tunelake.sources.views import Views

    preds = Views(spark, SF_SMALL).preds()
    got = rouge_l(preds, use_stemmer=False).select("reference", "prediction", "rouge_l").collect()
    assert got
    for r in got:
        p, ref = rouge_tokens(r.prediction, False), rouge_tokens(r.reference, False)
        lcs = _lcs_dp(ref, p)
        want = 0.0 if lcs == 0 else 2 * (lcs / len(p)) * (lcs / len(ref)) / (lcs / len(p) + lcs / len(ref))
        assert abs(r.rouge_l - want) < 1e-12
        assert 0.0 <= r.rouge_l <= 1.0


def test_rouge_identical_is_one():
    assert rouge_l_f("The cat sat on the mat", "the cat sat on the mat") == 1.0
    assert rouge_l_f("", "anything") == 0.0


def test_bleu_boundaries(spark):
    rows = [(1, "m", "a b c d e", "a b c d e"), (2, "m", "", "a b c"), (3, "m", "x y z", "a b c"),
            (4, "m", "a b", "a b c d"), (5, "m", None, "a b")]
    df = spark.createDataFrame(rows, "row_id long, model string, prediction string, reference string")
    got = {r.row_id: r.bleu for r in sentence_bleu(df).collect()}
    assert abs(got[1] - 1.0) < 1e-12
    assert got[2] == 0.0 and got[3] == 0.0 and got[5] == 0.0
    # 2 of 4 reference tokens: p1 = p2 = 1, p3 = p4 = 0.1/1 smoothed; brevity exp(1 - 4/2)
    import math
    want = math.exp(1 - 4 / 2) * math.exp((math.log(1) + math.log(1) + 2 * math.log(0.1)) / 4)
    assert abs(got[4] - want) < 1e-12


def test_bert_score_zero_vector_and_one_sided_example(spark):
    from tunelake.operators.textmetric import bert_score

    rows = [(1, "pred", 1, [0.0, 0.0]), (1, "ref", 2, [1.0, 0.0]), (2, "pred", 3, [1.0, 0.0])]
    got = {r["example_id"]: r["bert_f1"] for r in bert_score(spark.createDataFrame(rows, "example_id long, side string, vec_id long, embedding array<double>")).collect()}
    assert got == {1: 0.0, 2: 0.0}


def test_bert_score_in_blocks_equals_plain_numpy(spark):
    import numpy as np

    from tunelake.operators import textmetric as TM

    rng = np.random.default_rng(2)
    rows = [(e, s, i, rng.normal(size=5).tolist()) for e, sizes in ((1, (40, 23)), (2, (1, 1)), (3, (3, 70)))
            for s, n in zip(("pred", "ref"), sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "example_id long, side string, vec_id long, embedding array<double>")
    got = {r.example_id: (r.bert_p, r.bert_r, r.bert_f1) for r in TM.bert_score(df, chunk=16).collect()}
    for e in (1, 2, 3):
        a, b = (TM._unit(np.array([r[3] for r in rows if r[:2] == (e, s)])) for s in ("pred", "ref"))
        c = a @ b.T
        p, r = c.max(1).mean(), c.max(0).mean()
        assert got[e] == pytest.approx((p, r, 2 * p * r / (p + r)), abs=1e-12)
        assert TM.token_match(a, b, step=7) == pytest.approx(got[e], abs=1e-12)


def test_bert_score_of_texts(spark):
    from tunelake.operators import textmetric as TM
    from tunelake.operators.apply import stub_token_vectors

    rows = [(1, "a b c", "a b c"), (2, "", "x"), (3, None, None), (4, "a b a", "a"), (5, "q " * 5000, "q r " * 3000)]
    df = spark.createDataFrame(rows, "row_id long, prediction string, reference string")
    got = {r.row_id: r for r in TM.bert_score_texts(df, stub_token_vectors).collect()}
    assert got[1].bert_f1 == pytest.approx(1.0) and got[2].bert_f1 == got[3].bert_f1 == 0.0
    assert got[4].bert_r == pytest.approx(1.0) and got[4].bert_p < 1 and got[5].bert_p == pytest.approx(1.0) and got[5].bert_r < 1


def test_bert_score_of_a_large_batch_takes_it_apart_in_slices(spark):
    """One batch of 300 rows of 10,000 characters: its tokens don't meet the embedder at once."""
    from tunelake.operators.textmetric import bert_score_texts

    def embed(tokens):
        assert len(tokens) <= 100_000
        return [[1.0, float(len(t))] for t in tokens]

    rows = [(i, " ".join(f"a{i}x{k}" for k in range(700)), " ".join(f"b{i}y{k}" for k in range(700))) for i in range(300)]
    rows += [(300, None, "x"), (301, "", ""), (302, "same text", "same text")]
    df = spark.createDataFrame(rows, "row_id long, prediction string, reference string").coalesce(1)
    got = {r.row_id: r.bert_f1 for r in bert_score_texts(df, embed).collect()}
    assert len(got) == 303 and got[300] == got[301] == 0.0
    assert all(v == pytest.approx(1.0, abs=1e-3) for k, v in got.items() if k not in (300, 301))

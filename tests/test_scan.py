"""Affine scans and GAE against the plain loop: many short groups, one long one, blocks of several sizes."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tunelake.functions import scan
from tunelake.operators import rollout as G


def loop(ds, coef):
    out, last = [0.0] * len(ds), 0.0
    for t in reversed(range(len(ds))):
        out[t] = last = (ds[t] or 0.0) + coef * last
    return out


def check(got, want):
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sizes=st.lists(st.integers(min_value=1, max_value=9), min_size=1, max_size=6), long=st.integers(min_value=0, max_value=300),
       coef=st.sampled_from([0.95, 1.0, -0.7, 0.3, 1e-9, 1e-200, 0.0, 1.01]), block=st.sampled_from([2, 3, 16, 4096]))
def test_scan_equals_the_loop(spark, sizes, long, coef, block):
    rng = random.Random(long)
    groups = {g: [rng.gauss(0, 1) for _ in range(n)] for g, n in enumerate(sizes)}
    groups[None] = [rng.choice([rng.gauss(0, 1), None]) for _ in range(long)]
    rows = [(g, 3 * i, d) for g, ds in groups.items() for i, d in enumerate(ds)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, o long, d double")
    got = scan.affine_scan(df, "o", "d", coef, ["g"], "a", block)
    assert got.columns == ["g", "o", "d", "a"]
    check({(r.g, r.o): r.a for r in got.collect()}, {(g, 3 * i): a for g, ds in groups.items() for i, a in enumerate(loop(ds, coef))})


def test_blocks_keep_their_weights_finite():
    for coef in (1e-139, 1e-9, 0.5, 0.95, 0.9999, 1.0, 1.5, -0.95):
        size = scan._block(coef, scan.BLOCK)
        assert 2 <= size <= scan.BLOCK and math.isfinite(abs(coef) ** -size) and abs(coef) ** size < 1e200


@pytest.mark.parametrize("gamma, lam", [(1.0, 0.95), (0.9, 0.8), (0.99, 0.05), (0.9, 0.0), (0.0, 0.9), (1.0, 1.0)])
def test_gae_equals_the_loop_over_blocks(spark, gamma, lam):
    rng = random.Random(1)
    seqs = {s: [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(n)] for s, n in ((1, 1), (2, 7), (3, 200))}
    seqs[2][3] = (None, 0.5)
    seqs[2][5] = (0.5, None)
    rows = [(s, p, r, v, "x") for s, ts in seqs.items() for p, (r, v) in enumerate(ts)]
    df = spark.createDataFrame(rows, "seq_id long, pos long, reward double, val double, note string")
    got = G.gae(df, gamma=gamma, lam=lam, block=16)
    assert got.columns == df.columns + ["advantage", "return"]
    want = {}
    for s, ts in seqs.items():
        ts = [(r or 0.0, v or 0.0) for r, v in ts] + [(0.0, 0.0)]
        steps = [ts[t][0] + gamma * ts[t + 1][1] - ts[t][1] for t in range(len(ts) - 1)]
        want.update({(s, p): a for p, a in enumerate(loop(steps, gamma * lam))})
    check({(r.seq_id, r.pos): r.advantage for r in got.collect()}, want)

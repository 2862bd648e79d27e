"""op11: product codes against a plain search over all entries."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunelake.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=16, entries=64, rounds=2):
    """(vec_id, label, code, error) rows and codebooks, by measuring every entry."""
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = -(-max((len(v) for _, _, v in kept), default=0) // parts)
    kept = [(i, label, v, [(v + [0] * (parts * d - len(v)))[p * d:(p + 1) * d] for p in range(parts)]) for i, label, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[list(r[3][p]) for r in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for r in kept:
                mine[nearest(p, r[3][p])[1]].append(r[3][p])
            for e, xs in mine.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, label, _, x in kept:
        found = [nearest(p, x[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(f for f, _ in found)))
    return out, books


def vectors(rng, n, width=32):
    return [(i, [rng.gauss(0, 0.3) for _ in range(width)], rng.choice([1, 2, None])) for i in range(n)]


def test_codes_equal_a_plain_search(spark):
    rng = random.Random(3)
    rows = vectors(rng, 150)
    rows += [(200 + i, [0.25] * 32, 1) for i in range(40)] + [(10, rows[10][1], 2), (None, rows[11][1], 2), (None, [0.5] * 32, None)]
    rows += [(300, None, 1), (301, [None] * 32, 1), (302, [0.1] * 31 + [float("nan")], 1), (303, [float("inf")] + [0.0] * 31, 1), (304, [0.5] * 20, 7), (-1, [], 7)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS code", "1 AS k", "2 AS error", "3 AS v")
    want, books = plain(rows)
    per = defaultdict(int)
    for _, label, _, e in want:
        per[label] += e
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    expected = sorted(((i, c, e, per[label], digest) for i, label, c, e in want), key=str)
    got = codes.report(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected


def test_few_rows_wide_rows_and_none(spark):
    rng = random.Random(4)
    few = [(i, [float(np.float32(rng.uniform(-1, 1))) for _ in range(48)], 0) for i in range(5)]
    got = codes.report(spark.createDataFrame(few, SCHEMA)).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == sorted((i, c, e) for i, _, c, e in plain(few)[0])
    for rows in ([], [(1, None, 1)]):
        assert codes.report(spark.createDataFrame(rows, SCHEMA)).collect() == []
    blank = codes.report(spark.createDataFrame([(1, [], 1), (2, [], None)], SCHEMA)).collect()
    assert [(r["code"], r["error"]) for r in blank] == [("00" * 16, 0)] * 2
    with pytest.raises(Exception, match="too large"):
        codes.report(spark.createDataFrame([(1, [1e9] * 16, 1)], SCHEMA)).collect()


def test_masks_hold_all_that_is_within_the_radius():
    rng = np.random.default_rng(5)
    entries, x = rng.integers(-40, 40, (64, 4)), rng.integers(-60, 60, (3000, 4))
    s, seen = codes.Slices(entries), []
    d2 = ((x[:, None] - entries[None]) ** 2).sum(2)
    code, far = s.nearest(x, seen)
    assert (far == d2.min(1)).all() and (code == d2.argmin(1)).all()
    r2 = s.radius2(x)
    inside = (np.abs(x[:, None] - entries[None]).max(2) <= np.ceil(np.sqrt(r2))[:, None])
    mask = (inside * (np.uint64(1) << np.arange(64, dtype=np.uint64))).sum(1, dtype=np.uint64)
    assert (s.candidates(x, r2) == mask).all()
    assert sum(a for a, _ in seen) < 0.35 * sum(b for _, b in seen)


def test_decoding_gives_the_entries_of_the_code(spark):
    rows = vectors(random.Random(6), 90)
    coded, books = codes.compress(spark.createDataFrame(rows, SCHEMA))
    exact = {r[0]: [math.floor(256 * float(np.float32(x))) for x in r[1]] for r in rows}
    for r in coded.select("vec_id", "error", codes.decode_column(books)(F.col("code")).alias("d")).collect():
        assert r["error"] == sum((a - b) ** 2 for a, b in zip(exact[r["vec_id"]], r["d"]))

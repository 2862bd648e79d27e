"""op8 against plain dictionaries."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunelake.llm import eliasfano, lm
from tunelake.llm.base import id_remainder

from .conftest import documents


def words(t):
    return (t or "").encode().lower().split() + ["end"]


def plain(train, texts, min_count, discount=lm.DISCOUNT):
    one, two, start = Counter(), Counter(), 0
    for t in train:
        w = words(t)
        one.update(w)
        two.update(zip(["start"] + w, w))
        start += 1
    n, v = sum(one.values()), len(one)
    two = {k: c for k, c in two.items() if c >= min_count}
    one_or_start = {**one, "start": start}
    used = Counter()
    for (a, _), c in two.items():
        used[a] += (c - discount) / one_or_start[a]
    out = []
    for t in texts:
        w = words(t)
        base = sum(math.log10((one[x] + 1) / (n + 1 * (v + 1))) for x in w)
        score = 0.0
        for a, x in zip(["start"] + w, w):
            share = (two[a, x] - discount) / one_or_start[a] if (a, x) in two else 0.0
            score += math.log10(share + (1 - used[a]) * (one[x] + 1) / (n + 1 * (v + 1)))
        out.append((len(w), sum(one[x] > 0 for x in w), base, score))
    return n, out


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    return [(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(300)], k=rng.randrange(0, 80))), None, None) for i in range(n)]


@pytest.mark.parametrize("min_count,segment_keys", [(1, 100), (2, 1_000_000)])
def test_against_dictionaries(spark, min_count, segment_keys):
    rows = corpus(120) + [(500, None, None, None), (501, "never seen w1 w2 before", None, None), (None, "W1 w2", None, None)]
    docs = documents(spark, rows)
    held = id_remainder(F.col("doc_id"), lm.FOLDS) == lm.HELD_OUT
    train = [r[1] for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2]
    n, want = plain(train, [r[1] for r in rows], min_count)
    got = {r["doc_id"]: r for r in lm.score(docs.select("doc_id", "text"), docs.where(~held), min_count=min_count,
                                            segment_keys=segment_keys).collect()}
    for (d, *_), (n_tokens, n_known, base, score) in zip(rows, want):
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n_tokens, n_known, n)
        assert r["base_score"] == pytest.approx(base, abs=1e-9)
        # a share is rounded down by less than one step of its logarithm
        assert score - lm.STEP * n_tokens - 1e-6 <= r["score"] <= score + 1e-4 * n_tokens


def test_pairs_seen_once_count(spark):
    rows = [(i, " ".join(f"n{i}x{k}" for k in range(30)), None, None) for i in range(20)]
    docs = documents(spark, rows)
    n, want = plain([r[1] for r in rows], [r[1] for r in rows], 1)
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, docs).collect()}
    for (d, *_), (n_tokens, _, base, score) in zip(rows, want):
        assert score - lm.STEP * n_tokens - 1e-6 <= got[d] <= score + 1e-4 * n_tokens
        assert got[d] > 0.6 * base


def test_better_than_the_base_on_held_out_text(spark):
    rng = random.Random(2)
    follows = {i: [rng.randrange(200) for _ in range(3)] for i in range(200)}

    def text():
        at, out = rng.randrange(200), []
        for _ in range(60):
            out.append(f"t{at}")
            at = rng.choice(follows[at])
        return " ".join(out)

    docs = documents(spark, [(i, text(), None, None) for i in range(300)])
    held = id_remainder(F.col("doc_id"), lm.FOLDS) == lm.HELD_OUT
    r = lm.score(docs.where(held), docs.where(~held)).agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.5 * r[1]


def test_the_model_stays_in_the_shared_folder(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("the model passes through the driver")

    monkeypatch.setattr(type(spark.sparkContext), "addFile", refused)
    words_, bigrams, n = lm.fit(documents(spark, corpus(40)))
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    assert n and all(shared.removeprefix("file:").lstrip("/") in f for f in words_ + bigrams)
    assert len(lm.Words(words_).h) == len(lm.mapped_rows(words_)) and len(lm.Trie(lm.mapped_rows(bigrams)).rows)


def test_odd_rows_and_empty(spark, odd, none):
    got = lm.score(odd, odd).collect()
    assert len(got) == odd.count() and all(r["score"] < 0 for r in got)
    assert [r["n_tokens"] for r in got if r["doc_id"] == 3] == [1]
    assert lm.score(none, none).collect() == []
    lone = lm.score(odd.where("doc_id = 1"), none).collect()[0]
    assert (lone["train_tokens"], lone["base_score"], lone["score"], lone["n_known"]) == (0, 0.0, 0.0, 0)


def test_elias_fano():
    rng = np.random.RandomState(4)
    for n, most in ((0, 1), (1, 5), (700, 800), (5000, 10 ** 12), (300, 3 * 10 ** 5)):
        values = np.unique(rng.randint(0, most, n)) if n else np.empty(0, np.int64)
        parts = eliasfano.encode(values)
        s = eliasfano.Sequence(*(np.frombuffer(parts[k], np.uint8) for k in ("head", "high", "ranks", "low")))
        if n:
            assert (s[np.arange(len(values))] == values).all()
            probe = np.concatenate([values, values + 1, [-1, most + 5]])
            place = {int(x): i for i, x in enumerate(values)}
            assert s.find(probe).tolist() == [place.get(int(x), -1) for x in probe]
        else:
            assert s.find(np.array([3])).tolist() == [-1]
    stairs = np.repeat(np.arange(50), 7)
    parts = eliasfano.encode(stairs)
    s = eliasfano.Sequence(*(np.frombuffer(parts[k], np.uint8) for k in ("head", "high", "ranks", "low")))
    assert (s[np.arange(350)] == stairs).all()


def test_packed_keys_round_trip():
    k = np.unique(np.random.RandomState(1).randint(0, 1 << 62, 1000))
    c = np.arange(len(k)) + 1
    a, b = lm.unpacked_keys(lm.packed_keys(k, c))
    assert (a == k).all() and (b == c).all()


def test_token_hashes_follow_the_words():
    import random

    rng = random.Random(8)
    texts = [None, b"", b" \t\n", "é Été ÀB ab AB".encode(), b"x" * 5000 + b" y", b"a\x00b a\x00 \x0bq\x0cr"]
    texts += [b" ".join(bytes(rng.choices(range(33, 256), k=rng.randrange(1, 9))) for _ in range(rng.randrange(30))) for _ in range(400)] + [b"w " * 600_000]
    h, n = lm.tokens(texts)
    words = [(t or b"").lower().split() for t in texts]
    assert n.tolist() == [len(w) + 1 for w in words]
    flat = [x for w in words for x in (*w, None)]
    of = {}
    assert len(h) == len(flat) and all(of.setdefault(w, x) == x for w, x in zip(flat, h.tolist()))
    assert len(set(of.values())) == len(of)


def test_a_batch_of_texts_is_not_held_twice():
    import tracemalloc

    import pyarrow as pa

    column = pa.array([f"{i:05d}" * 200 for i in range(30_000)])  # 30 MB
    tracemalloc.start()
    n = sum(len(t) for texts in lm.texts_of(column) for t in texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 30_000_000 and peak < 15e6


def peak_of(make):
    import tracemalloc

    tracemalloc.start()
    try:
        return make(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_segment_is_laid_out_in_little_memory():
    rng = np.random.default_rng(5)
    v, n = 1_000_000, 500_000
    keys = np.unique(rng.integers(0, v * 50_000, n))
    row, peak = peak_of(lambda: lm.segment(keys, np.ones(len(keys), np.int64), v, lambda ids: np.full(len(ids), 1000)))
    assert peak < 60 * len(keys)
    trie = lm.Trie([{k: np.frombuffer(x, np.uint8) if isinstance(x, bytes) else x for k, x in row.items()}])
    before, word = keys // v, keys % v
    share, left = trie.find(before, word, v)
    assert (share > 0).all() and (share <= 0.25 / 1000 * 1.0001).all() and (left < 1).all()
    assert (trie.find(before, np.where(word + 1 < v, word + 1, 0), v)[0] > 0).sum() == np.isin(before * v + np.where(word + 1 < v, word + 1, 0), keys).sum()


def test_parts_are_merged_range_by_range():
    rng = np.random.default_rng(6)
    parts = [(k, c) for k, c in (np.unique(rng.integers(0, 400_000, 15_000), return_counts=True) for _ in range(40))]
    want = lm.summed(*map(np.concatenate, zip(*parts)))

    def walk():
        sizes, keys, counts, last = [], 0, 0, -1
        for k, c in lm.merged(parts, 50_000):
            assert k[0] > last
            last, keys, counts = k[-1], keys + k.sum(), counts + (k * c).sum()
            sizes.append(len(k))
        return sizes, keys, counts

    (sizes, keys, counts), peak = peak_of(walk)
    assert max(sizes) <= 70_000 and (sum(sizes), keys, counts) == (len(want[0]), want[0].sum(), (want[0] * want[1]).sum())
    assert peak < 8e6  # the parts hold 9.4 MB
    tally = lm.Tally()
    tally.parts = list(parts)
    assert all((a == b).all() for a, b in zip(tally.take(), want)) and len(tally.take()[0]) == 0
    one = (np.arange(9), np.ones(9, np.int64))
    small = list(lm.merged([one, one], 3))
    assert len(small) > 1 and [k for r in small for k in r[0]] == list(range(9)) and all((c == 2).all() for _, c in small)


def test_keys_are_put_in_order_in_place():
    from array import array

    k = np.random.default_rng(7).permutation(200_000) * 3
    keys, counts = array("q", k.tobytes()), array("q", (k + 1).tobytes())
    (a, b), peak = peak_of(lambda: lm.in_order(keys, counts))
    assert (a == np.arange(200_000) * 3).all() and (b == a + 1).all() and peak < 20 * len(k)

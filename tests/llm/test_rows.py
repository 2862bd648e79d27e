"""op1, op3, op6, op7: row operators against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunelake.llm import dedup, mixing, sharding, topk
from tunelake.session import scratch_path

from .conftest import LONG, documents


# -- op6 ----------------------------------------------------------------------------

def check_dedup(rows, got):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    seen = Counter()
    for r in got:
        t = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        ids = [d for d in groups[t] if d is not None]
        assert r["keep_id"] == (max(ids) if ids else None) and r["group_size"] == len(groups[t])
        seen[t] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert len(got) == len(rows) and all(seen[t] == 1 for t in groups)


def test_dedup_decides_as_equality_does(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_dedup(rows, dedup.decide(odd).collect())
    assert dedup.decide(none).collect() == []


def test_dedup_with_ambiguous_identifiers(spark):
    texts = ["abc. " * 700, "abd. " * 700, "abc. " * 700, "abc. " * 350 + "abd. " * 350, "", "x", None, "y"]
    rows = list(enumerate(texts))
    docs = documents(spark, [(d, t, None, None) for d, t in rows])
    weak = lambda c: F.length(c).cast("long")  # noqa: E731  many different chunks share an identifier
    check_dedup(rows, dedup.decide(docs, weak).collect())


def test_chunks_join_to_the_text_and_follow_content(spark):
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdé😀\n. ", k=rng.randrange(1, 9))) for _ in range(6000))
    shifted = "A new first line\n" + text
    a, b, c = (r[0] for r in documents(spark, [(1, text, None, None), (2, shifted, None, None), (3, "z" * 9000, None, None)])
               .orderBy("doc_id").select(dedup.chunks(F.col("text"))).collect())
    assert "".join(a) == text and "".join(b) == shifted and [len(x) for x in c] == [4096, 4096, 808]
    assert len(set(a) & set(b)) > 0.5 * len(a)


def test_deduplicate_keeps_rows_whole(spark, odd, none):
    kept = dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["2", "5", "4", "7", "9", "10", "10"])
    assert dedup.deduplicate(none).collect() == []


# -- op1 ----------------------------------------------------------------------------

def targets(sizes, cap=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1.0 for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level >= cap * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in free}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 60), None, rng.choice(["hot"] * 6 + ["é", "z", "Z", None, "tiny"] + ["b"] * 3)) for i in range(3000)]
    docs = documents(spark, rows)
    got = mixing.plan(docs).collect()
    again = mixing.plan(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    want, taken = targets(sizes), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.15 * want[s] + 60
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_mixing_odd_rows(spark, odd, none):
    got = mixing.plan(odd).collect()
    assert len(got) == odd.count() and mixing.plan(none).collect() == [] and mixing.mix(none).collect() == []
    assert mixing.mix(odd).columns == odd.columns
    word = re.compile(r"[^\x20\x09-\x0D]+")
    assert sum(r["size"] for r in got) == sum(len(word.findall(r["text"] or "")) for r in odd.collect())
    empty = documents(spark, [(1, "", None, "a"), (2, None, None, "b")])
    assert [(r["target"], r["taken"]) for r in mixing.plan(empty).collect()] == [(0.0, 0)] * 2


# -- op3 ----------------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 23, 100])
def test_shards_are_even(spark, n):
    docs = documents(spark, [(i % 7, "t" * (i % 3), None, None) for i in range(n)])
    got = sharding.assign(docs).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == n and (not n or max(counts.values()) - min(counts[s] for s in range(24)) <= 1)
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert all(r["text_crc32"] == zlib.crc32(b"t" * (r["size"] - 8)) for r in got)


def test_shard_order_is_random_and_repeatable(spark):
    docs = documents(spark, [(i, "x", None, None) for i in range(2000)])
    how = dict(min_buckets=5, bucket_bytes=4000)
    first = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign(docs, 4, **how).collect()}
    assert first == {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign(docs, 4, **how).collect()}
    other = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.assign(docs, 4, seed=8, **how).collect()}
    assert sum(first[i] == other[i] for i in first) < 30
    place = np.array([first[i][0] * 500 + first[i][1] for i in range(2000)])
    assert abs(np.corrcoef(place, np.arange(2000))[0, 1]) < 0.1


def test_written_shards(spark, odd):
    path = scratch_path(spark, "shards")
    sharding.write_shards(odd, path, 3)
    back = spark.read.parquet(path)
    assert back.count() == odd.count() and set(odd.columns) <= set(back.columns)
    assert sorted(r[0] for r in back.groupBy("shard").count().select("count").collect()) == [4, 4, 5]
    with pytest.raises(ValueError):
        sharding.write_shards(odd.withColumn("slot", F.lit(1)), path, 3)


# -- op7 ----------------------------------------------------------------------------

def brute_topk(rows, k=5):
    fine = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in fine:
        if i % 50 == 0:
            asked[i] = max(v, asked.get(i, v))
    out = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as v", "1 as score")


def test_topk_against_brute_force(spark):
    rng = np.random.RandomState(6)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)]) for i in range(600)]
    rows += [(600 + i, rows[i % 3][1]) for i in range(40)]  # ties
    rows += [(None, [1.0] * 8), (700, None), (701, [None] * 8), (702, [float("nan")] * 8), (703, [float("inf")] * 8),
             (50, [0.5] * 8), (51, [0.1] * 3), (52, [])]
    df = vectors(spark, rows)
    got = lambda **how: sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, **how).collect())
    want = brute_topk(rows)
    assert got() == want and got(block=37, queries=5, pivots=3) == want


def test_topk_small_and_empty(spark):
    q = F.col("vec_id") % 50 == 0
    assert topk.search(vectors(spark, []), q).collect() == []
    assert topk.search(vectors(spark, [(1, [1.0])]), q).collect() == []
    rows = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [-1.0, 1.0])]
    assert sorted(tuple(r) for r in topk.search(vectors(spark, rows), q).collect()) == brute_topk(rows)


def test_topk_stops_early():
    rng = np.random.RandomState(3)
    v = rng.randint(-256, 256, (4000, 4))
    length2 = float((v ** 2).sum(1).max())
    q, p = v[:5], v[100:116]
    seen = []
    topk.search_block(np.arange(4000), v, topk.pivot_distances(v, p, length2), np.arange(5), q,
                      topk.query_distances(q, p, length2), np.full(5, -np.inf), length2, 5, seen)
    assert max(seen) < 4000

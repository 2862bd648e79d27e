"""op5 against brute force."""

import random

import numpy as np
import pytest

from tunelake.llm import jaccard
from tunelake.llm.components import components

from .conftest import documents


def brute(rows, threshold=90):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset([tuple(w)] if 0 < len(w) < 3 else zip(w, w[1:], w[2:]))

    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted((str(d), len(s), str(ids.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def got(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def family(rng, size, words=120, most=5):
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(size):
        t = list(base)
        for _ in range(rng.randrange(most + 1)):
            t[rng.randrange(words)] = f"m{rng.randrange(60)}"
        out.append(" ".join(t))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    texts = [t for n in (40, 25, 3, 2, 2) for t in family(rng, n)]
    passage = " ".join(f"shared{i}" for i in range(60))
    texts += [" ".join(f"u{rng.randrange(9000)}" for _ in range(rng.randrange(5, 90))) + " " + passage for _ in range(30)]
    texts += ["Short One", "short one", "a", "A", "a b c", "", None, "  "] + texts[:6]
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


def test_against_brute_force(spark, corpus):
    docs = documents(spark, [(d, t, None, None) for d, t in corpus])
    assert got(jaccard.link(docs)) == brute(corpus)


def test_any_order_and_small_blocks_give_the_same(spark, corpus):
    docs = documents(spark, [(d, t, None, None) for d, t in corpus])
    surveyed = jaccard.survey(docs)
    as_set = lambda df: {(bytes(r[0]), bytes(r[1])) for r in df.collect()}

    def found(levels, **how):
        pairs = jaccard.groups(jaccard.beginnings(docs, spark.sparkContext.broadcast(levels)))
        return as_set(components(jaccard.edges(docs, surveyed, pairs, **how)))

    want = found(jaccard.levels(surveyed))
    assert want and want == found(bytes(np.random.RandomState(1).randint(0, 5, 1 << 10, np.uint8)), block_rows=7, block_shingles=2000)


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(jaccard.link(odd)) == brute(rows)
    assert jaccard.link(none).collect() == []


def test_one_per_component_keeps_columns_and_blank_rows(spark, odd, none):
    kept = jaccard.one_per_component(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    # 1, 2 and a null id are copies, 7 repeats, 8 and 9 are copies; blank texts stay
    assert ids == sorted(["1", "3", "4", "5", "None", "7", "8", "10", "10"])
    assert jaccard.one_per_component(none).collect() == []


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, rng.randrange(101, 140)) for _ in range(30)]
    edges = spark.createDataFrame([(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in pairs], "u binary, v binary")
    got_ = {int.from_bytes(r[0], "big"): int.from_bytes(r[1], "big") for r in components(edges).collect()}
    for i in range(60):
        assert got_.get(i, i) == i // 20 * 20
    assert all(got_[b] == 100 for a, b in pairs if a == 100)


def test_star_finds_links_beyond_the_hub():
    n = 40
    hub = np.arange(n, dtype=np.uint64)
    far = np.concatenate([hub[6:], np.arange(1000, 1006, dtype=np.uint64)])
    twin = np.concatenate([far[1:], np.array([2000], np.uint64)])
    rows = [np.sort(x) for x in (hub, far, twin)]
    label = jaccard.star(rows, np.full(3, n), 0, lambda over, a, b: 100 * over >= 90 * (a + b - over))
    assert label[1] == label[2] != label[0]


def test_sketches_bound_the_overlap():
    rng = np.random.RandomState(7)

    def linked(over, a, b):
        return 100 * over >= 80 * (a + b - over)

    for n in (1, 4, 30, 200, 766, 770, 3000):
        sets = []
        for part in (1, 0.97, 0.9, 0.7, 0.4, 0):
            own = rng.randint(-2**63, 2**63 - 1, n, dtype=np.int64).view(np.uint64)
            sets.append(np.unique(np.concatenate([sets[0][:int(part * n)] if sets else own, own[:n - int(part * n) + n // 50]])))
        sizes = np.array([len(v) for v in sets])
        counts = [jaccard.counts_of(jaccard.sketch(v), len(v)) for v in sets]
        for hub, near in ((0, None), (3, None), (0, np.arange(6) == 5)):
            label = jaccard.possible(counts, sizes, hub, linked, 80, near)
            for i in range(6):
                for j in range(i):
                    if linked(len(np.intersect1d(sets[i], sets[j])), sizes[i], sizes[j]) and (near is None or not near[i] & near[j]):
                        assert label[i] == label[j] >= 0
            assert n < 200 or near is not None or label[5] == -1  # unrelated rows go
    flat = np.arange(2000, dtype=np.uint64)  # all in one range
    assert jaccard.counts_of(jaccard.sketch(flat), 2000).max() == 2000


def test_rows_that_share_a_shingle_by_chance_read_no_shingles(spark, monkeypatch):
    """Each of these rows is in a group with others; only the near copies are dealt with their shingles."""
    rng = random.Random(11)
    chance = [" ".join([f"w{rng.randrange(10**6)}" for _ in range(100)] + ["extraordinarily unquestionably incomprehensible" * 2])
              for _ in range(60)]
    rows = list(enumerate(chance + family(rng, 5, words=200, most=2), 1))
    asked = []
    inner = jaccard.vectors

    def vectors(docs, surveyed, wanted, *width):
        asked.append(wanted.count())
        return inner(docs, surveyed, wanted, *width)

    monkeypatch.setattr(jaccard, "vectors", vectors)
    assert got(jaccard.link(documents(spark, [(d, t, None, None) for d, t in rows]))) == brute(rows)
    assert 2 <= sum(asked) <= 5


def test_rows_that_stay_are_not_shuffled(spark, odd):
    """Rows that neither go nor repeat reach the result without a join."""
    def walk(node):
        yield node
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    plan = jaccard.one_per_component(odd)._jdf.queryExecution().optimizedPlan()
    union = next(x for x in walk(plan) if x.nodeName() == "Union")
    assert not {x.nodeName() for x in walk(union.children().apply(0))} & {"Join", "Aggregate", "RepartitionByExpression", "Deduplicate"}


def test_large_tables_of_ids_meet_only_their_texts(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "if_small", lambda df, row_bytes: df)
    docs = documents(spark, [(d, t, None, None) for d, t in corpus])
    assert got(jaccard.link(docs)) == brute(corpus)


def test_tidy_writes_leave_the_session_as_it_was(spark):
    from tunelake.session import TIDY, materialize_tidy

    was = spark.conf.get(TIDY, None)
    df = spark.range(100).repartition(3, "id")
    assert materialize_tidy(df, "tidy").count() == 100 and spark.conf.get(TIDY, None) == was

"""Dictionary-encoded tokenising against plain Python, in chunks of several sizes."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tunelake.operators import tokens as K


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["the", "The", "été", "x1", "字", "a-b", "über"] + [f"w{i}" for i in range(60)]
    out = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 40))), rng.choice(["a", None]), [i]) for i in range(200)]
    return out + [(500, None, "a", None), (501, "", None, []), (None, "!?", "b", None), (503, "the " * 5000, "a", [1]), (503, "the", "a", [1])]


def plain(rows, max_length):
    found = [re.findall(r"[^\W_]+", (t or "").lower()) for _, t, _, _ in rows]
    count = Counter(t for f in found for t in f)
    ids = {t: K.N_SPECIAL + n for n, (t, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0].encode())))}
    return sorted([(i, s, x, [ids[t] for t in f[:max_length]], len(f), min(len(f), max_length), len(f) > max_length)
                   for (i, _, s, x), f in zip(rows, found)], key=str)


@pytest.mark.parametrize("chunk_tokens, max_length", [(1, 5), (100, 512), (1 << 20, 20)])
def test_ids_equal_plain_python(spark, rows, chunk_tokens, max_length):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra array<long>").repartition(3)
    got = K.tokenize_corpus(docs, max_length=max_length, keep=("source", "extra"), chunk_tokens=chunk_tokens)
    assert got.columns == ["doc_id", "source", "extra", "input_ids", "n_tokens", "n_kept", "truncated"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, max_length)


def test_given_vocabulary_and_no_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra array<long>")
    vocab = spark.createDataFrame([("the", 7, 100), ("w3", 2, 101)], "token string, cnt long, id long")
    got = {r.doc_id: r for r in K.tokenize_corpus(docs.where("doc_id < 300"), vocab=vocab).collect()}
    for i, t, _, _ in rows[:200]:
        assert got[i].input_ids == [{"the": 100, "w3": 101}[w] for w in re.findall(r"[^\W_]+", t.lower()) if w in ("the", "w3")]
    assert K.tokenize_corpus(docs.where("false")).collect() == []


def test_only_distinct_tokens_of_a_chunk_are_taken_apart(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra array<long>").coalesce(1)
    (chunk,) = K.dictionary_chunks(docs.select("doc_id", K.word_tokens(F.col("text")).alias("t")), 512).collect()
    assert len(chunk.tokens) == len(set(chunk.tokens)) < 80 < 5000 < sum(chunk.counts)


def test_a_worker_gets_one_chunk_at_a_time(spark):
    docs = spark.createDataFrame([(i, f"w{i % 4} common w{i} common", "s") for i in range(60)], "doc_id long, text string, source string").repartition(3)
    small, large = (K.tokenize_corpus(docs, chunk_tokens=n) for n in (10, 1 << 20))
    assert "FlatMapGroupsInArrow" in small._jdf.queryExecution().executedPlan().toString()
    rows = [sorted((r.doc_id, r.input_ids, r.n_tokens) for r in x.collect()) for x in (small, large)]
    assert rows[0] == rows[1] and len(rows[0]) == 60

"""op2, op4 and the pipeline."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from tunelake.llm import bpe, jaccard, langid, mixing
from tunelake.llm.base import id_remainder

from .conftest import documents
from .test_jaccard import brute as brute_links

SYLLABLES = {"a": "the th ing and er of", "b": "sch ung und ein ch ö", "c": "ció el ña los que do"}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(9)
    rows = [(i, speech(rng, lang, rng.randrange(1, 300)), lang, "s") for i in range(300) for lang in ["abc"[i % 3]]]
    return documents(spark, rows)


def test_language_on_held_out_rows(spark, spoken):
    got = spoken.select("lang", (id_remainder(F.col("doc_id"), 5) == 0).alias("held"), langid.classifier(spoken)("text").alias("p"))
    rows = got.where("held").select("lang", "p.*").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_learns_from_all_of_the_sampled_texts(spark):
    rng = random.Random(6)
    header = speech(rng, "c", 700)
    rows = [(i, " ".join([header if i % 4 < 2 else "12 " * 1000, speech(rng, "ab"[i % 2], 3000), f"end{'xyz'[i % 3] * 3}"]), "ab"[i % 2], "s")
            for i in range(80)]
    model = langid.fit(documents(spark, rows))
    assert len(model) == 2
    for lang in "ab":
        raw = dict(model)[lang]
        assert raw.count(b" ") > 500 and langid.predict(speech(rng, lang, 200), model)[0] == lang
    many = documents(spark, [(i, "word" * 500 + f" {i}", "a", "s") for i in range(400)])
    assert len(langid.fit(many)[0][1]) == langid.SAMPLE_DOCS * (langid.EXCERPT + 1) - 1


def test_language_odd_rows(spark, odd, none, spoken):
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns
    ids = Counter(str(r["doc_id"]) for r in kept.collect())
    assert ids == Counter(["1", "2", "None", "7", "7", "8", "9", "10", "10"])
    assert langid.keep_identified(none).collect() == []
    model = langid.fit(spoken)
    assert [langid.predict(t, model) for t in (None, "", "12 3! ²")] == [("und", 0.0, True)] * 3
    assert langid.predict("x", []) == ("und", 0.0, True) and langid.predict("x", model[:1]) == (model[0][0], 1.0, False)
    assert len(model) == 3 and all(len(d) <= langid.DICT_BYTES for _, d in model)
    mixed = " ".join(x for pair in zip(*(speech(random.Random(i), l, 400).split() for i, l in enumerate("ab"))) for x in pair)
    assert langid.predict(mixed, model)[1] < langid.predict(speech(random.Random(5), "a", 800), model)[1]


@pytest.fixture(scope="module")
def encoder():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.Encoder(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})


def test_bpe_as_the_library(encoder, library):
    rng = random.Random(5)
    letters = "aaaabbtheing  \n\t'sé\x1c\x85\xa0 ½²ǀΩжあ漢😀 ́ſK_12٣<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 24))) for _ in range(4000)]
    for t in texts + ["a" * 30000, " " * 3000 + "x", "the " * 9000, "ab" * 5000]:
        ids = encoder.encode(t)
        assert ids == " ".join(map(str, library.encode_ordinary(t)))
        assert encoder.decode(ids) == t.encode()


def test_prefixes_append_and_replace(encoder):
    rng = random.Random(8)
    v = encoder.vocabulary
    whole = lambda data: bpe.Prefixes(v, data).tokens()
    for _ in range(150):
        data = bytes(rng.choice(b"aabtheingers ") for _ in range(rng.randrange(0, 400)))
        p = bpe.Prefixes(v)
        cut = sorted(rng.randrange(len(data) + 1) for _ in range(3))
        for a, b in zip([0, *cut], [*cut, len(data)]):
            p.append(data[a:b])
        assert p.tokens() == whole(data) and b"".join(v.texts[t] for t in p.tokens()) == data
        a, b = sorted(rng.randrange(len(data) + 1) for _ in range(2))
        new = bytes(rng.choice(b"xyz the") for _ in range(rng.randrange(6)))
        p.replace(a, min(b, a + 5), new)
        assert p.data == data[:a] + new + data[min(b, a + 5):] and p.tokens() == whole(p.data)
    p = bpe.Prefixes(v, b"the quick brown fox " * 500)
    assert p.replace(10, 11, b"k") < 1000  # near the edit only


def test_bpe_columns(spark, odd, none, library):
    got = {(r["doc_id"], r["n_tokens"]): r for r in bpe.digests(odd).collect()}
    assert bpe.digests(odd).count() == odd.count() and bpe.digests(none).collect() == []
    for r in odd.collect():
        ids = library.encode_ordinary(r["text"] or "")
        g = got[r["doc_id"], len(ids)]
        assert g["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        assert g["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    rows = bpe.encode_documents(odd).withColumn("back", bpe.decode_column(spark)("token_ids")).collect()
    assert all(bytes(r["back"]).decode() == (r["text"] or "") for r in rows)


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, speech(rng, "abc"[i % 3], rng.randrange(1, 120)), "abc"[i % 3], f"s{i % 4}") for i in range(150)]
    rows += [(200 + i, rows[i][1], rows[i][2], "s0") for i in range(10)]
    near = [(300 + i, rows[i][1] + " and", rows[i][2], "s1") for i in range(10) if len(rows[i][1].split()) > 60]
    rows += near + [(400, None, "a", "s0"), (401, " ", "a", "s1"), (402, "123 456", "b", None)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = langid.fit(documents(spark, rows))
    stay = [r for r in rows if not langid.predict(r[1], model)[2]]
    last = {}
    for r in stay:
        last[r[1]] = max(r, last.get(r[1], r), key=lambda x: x[0])
    stay = sorted(last.values())
    component = {d: c for d, _, c in brute_links([(r[0], r[1]) for r in stay])}
    stay = [r for r in stay if component[str(r[0])] == str(r[0])]
    copies = {r["doc_id"]: r["copies"] for r in mixing.plan(documents(spark, stay)).collect()}
    want = Counter({r[0]: copies[r[0]] for r in stay if copies[r[0]]})
    assert Counter(r["doc_id"] for r in got) == want
    text = {r[0]: r[1] for r in stay}
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in got)
    assert not {400, 401, 402} & set(want) and near and not {r[0] for r in near} & set(want)


def test_near_stage_takes_five_words_and_four_fifths(spark):
    rng = random.Random(4)
    rows = []

    def add(words):
        rows.append((len(rows) + 1, " ".join(words), "a", "s"))

    for f in range(12):
        base = [f"w{f}x{i}" for i in range(200)]
        add(base)
        add(base + [f"n{f}x{i}" for i in range(rng.choice((10, 30, 45, 55, 70)))])
        add([f"m{f}" if i in rng.sample(range(200), f) else w for i, w in enumerate(base)])
    base = [f"z{i}" for i in range(200)]
    add(base)  # 0.867 on either width
    add(base + [f"y{i}" for i in range(30)])
    add(["few", "words"])
    add(["few", "words", "more"])

    def grams(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = [grams(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    want = sorted(rows[i][0] for i in set(root))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, documents(spark, rows), "").collect()) == want
    assert len(rows) - 3 in want and len(rows) - 2 not in want
    assert len(jaccard.one_per_component(documents(spark, rows)).collect()) > len(want)  # op5's values leave more


def test_stages_keep_the_columns(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").columns[0] == "doc_id"
    assert jaccard.THRESHOLD == 90

"""op12: pieces against the tokenizers library, packing against plain best fit and its invariants."""

import json
import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tunelake.llm import fitting

from .conftest import documents

DEFINITION = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_str(DEFINITION)
    t.encode_special_tokens = True
    return t


def slow(tokenizer, texts):
    return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_those_of_tokenizers_for_every_code_point(tokenizer):
    fast = fitting.encoder(DEFINITION)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{c}1{c} {c}'{c}  " for c in chars[at:at + 500]) for at in range(0, len(chars), 500)]
    for at in range(0, len(texts), 200):
        assert [fast.ids(t) for t in texts[at:at + 200]] == slow(tokenizer, texts[at:at + 200])


def test_ids_of_odd_texts(tokenizer):
    rng = random.Random(1)
    texts = ["", " ", "\n\n", " \xa0 x", "it's we'll 'S", "<|endoftext|> <|endoftext", "é ́", "!\x1c a", "word " * 40_000, " " * 50_000 + "x",
             "".join(rng.choices("abcdefg", k=100_000))]
    texts += ["".join(rng.choices("aé1 \n\t'\xa0\x85😀.,sЖ中", k=rng.randrange(60))) for _ in range(2000)]
    assert [fitting.encoder(DEFINITION).ids(t) for t in texts] == slow(tokenizer, texts)


def test_other_tokenizers_run_by_the_library(tokenizer):
    d = json.loads(DEFINITION)
    assert fitting.ranks(d) is not None
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {**d["pre_tokenizer"], "add_prefix_space": True}}):
        other = {**d, **change}
        assert fitting.ranks(other) is None
        t = Tokenizer.from_str(json.dumps(other))
        assert fitting.Encoder(json.dumps(other)).ids("Some Text HERE") == array("I", t.encode("Some Text HERE").ids).tobytes()
    moved = {**d, "model": {**d["model"], "merges": d["model"]["merges"][::-1]}}
    assert fitting.ranks(moved) is None


def plain(lengths, capacity, most):
    """Bounded-space best fit with plain lists; bins in the order in which they close."""
    bins, closed = [], []
    for i, n in enumerate(lengths):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            best = min(b[0] for b in fits)
            b = [b for b in fits if b[0] == best][-1]
        else:
            if len(bins) == most:
                full = min(bins, key=lambda b: b[0])[0]
                b = [b for b in bins if b[0] == full][-1]
                bins.remove(b)
                closed.append(b[1])
            b = [capacity, []]
        if b in bins:
            bins.remove(b)
        b[0] -= n
        b[1].append(i)
        bins.append(b) if b[0] else closed.append(b[1])
    return closed, sorted(b[1] for b in bins)


def test_best_fit_equals_plain_lists():
    rng = random.Random(2)
    for most in (1, 3, 20):
        lengths = [rng.randrange(1, 40) for _ in range(500)]
        bins, closed = fitting.BestFit(40, most), []
        for i, n in enumerate(lengths):
            closed += bins.put(i, n)
            assert bins.open == sum(1 for _ in bins.rest()) <= most
        assert (closed, sorted(b for _, b in bins.rest())) == plain(lengths, 40, most)


def test_bounds():
    assert fitting.bounds(1, 10) == [0] and fitting.bounds(10, 10) == [0] and fitting.bounds(20, 10) == [0, 10]
    assert fitting.bounds(11, 10) == [0, 1] and fitting.bounds(25, 10) == [0, 5, 15]


def check(tokenizer, rows, got, capacity):
    """Pieces are those of the texts, sequences are gapless and hold at most the capacity."""
    want = []
    for doc_id, text in rows:
        data = slow(tokenizer, [text or ""])[0] + array("I", [2]).tobytes()
        n = len(data) // 4
        cut = [0, *range(n % capacity or capacity, n, capacity), n]
        want += [(doc_id, i, s, e - s, zlib.crc32(data[4 * s:4 * e])) for i, (s, e) in enumerate(zip(cut, cut[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), sum(r["length"] for r in got)


def test_pack_in_several_passes(spark, tokenizer):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["the", "of", "and", "house"], k=rng.choice([3, 20, 40, 150])))) for i in range(1500)]
    got = fitting.pack(documents(spark, [(i, t, None, None) for i, t in rows]), capacity=64, most=16, task_tokens=8 * 16 * 64)
    n, tokens = check(tokenizer, rows, got.collect(), 64)
    lengths = sorted(((len(t.split()) % 64 or 64) + 1 for _, t in rows), reverse=True)
    assert lengths and n <= 1.03 * tokens / 64 + 5
    with pytest.raises(ValueError):
        fitting.pack(documents(spark, []), task_tokens=10)


def test_pack_odd_rows(spark, tokenizer, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = fitting.pack(odd)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    n, tokens = check(tokenizer, rows, got.collect(), 1024)
    assert n == -(-tokens // 1024)
    again = fitting.pack(odd)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    assert fitting.pack(none).collect() == []

"""op13: the audit against plain counting, with good and with colliding digests."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tunelake.llm import divergence

from .conftest import documents

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, min_docs=10, top=10):
    """(lang, source, part, item, value, rank) by counting strings."""
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall(folded(text))
        n[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, c in docs[lang].items() if c >= min_docs)
        sources = sorted(s for g, s in groups if g == lang)

        def shares(count, v=len(kept), kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // (total + 2 * v) for t in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in sources if o != s]
            leads = [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", leads)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(found, 1) if part == "pair" or r <= top]
    return sorted(out)


def corpus(rng, n, words, sources=5):
    out = []
    for _ in range(n):
        source = rng.choice("abcdefghij"[:sources])
        base = rng.choices(words, k=rng.randrange(0, 30)) + rng.choices(words[ord(source) % 7::7], k=5)
        out.append((rng.choice([" ", ", ", "1"]).join(base), rng.choice(["x", "y", None]), source))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdeéßАя字", k=rng.randrange(1, 5))) for _ in range(150)] + ["Ab", "aB", "ÀB", "àb"]
    out = corpus(rng, 500, words)
    out += [(None, "x", "a"), ("", "x", "only"), ("!?1", "z", "a"), ("word", "z", "b"), ("word", "one", None), (None, None, None)] * 3
    return out + [("same text", "x", "a")] * 60


def frame(spark, rows):
    df = documents(spark, [(i, *r) for i, r in enumerate(rows)], extra=True)
    return df.selectExpr("*", "1 AS digest", "2 AS lang_id", "3 AS n", "4 AS value", "5 AS item")


def answer(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def test_audit_equals_plain_counting(spark, rows, none):
    assert answer(divergence.audit(frame(spark, rows))) == plain(rows)
    assert divergence.audit(none).collect() == []


def test_colliding_digests_are_split(spark, rows, monkeypatch):
    def weak(term):
        return len(term) if len(term) < 3 else divergence.digest(term)

    assert answer(divergence.audit(frame(spark, rows), ident=weak)) == plain(rows)
    monkeypatch.setattr(divergence, "MOST_SPLIT", 1)  # too many collisions: all terms carry their string
    assert answer(divergence.audit(frame(spark, rows[:200]), ident=weak, min_docs=3)) == plain(rows[:200], 3)


def test_blocks_of_sources_and_terms():
    """Sums over block pairs and parts of the terms add up to the sums over all."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    s, v = 2 * divergence.SIDE + 3, 40
    p0 = rng.integers(1, 1000, s)
    dense = np.where(rng.random((v, s)) < 0.1, rng.integers(1, 10**9, (v, s)), p0)
    want = {(a, b): int(((dense[:, a] - dense[:, b]) ** 2 // (dense[:, a] + dense[:, b])).sum()) for a in (0, 5, 300) for b in (1, 299, s - 1) if a < b}
    got = dict.fromkeys(want, 0)
    for i in range(3):
        for j in range(i, 3):
            own = [x for x in range(s) if x // divergence.SIDE in (i, j)]
            for part in (range(0, 20), range(20, v)):
                cells = [(t, x) for t in part for x in own if dense[t, x] != p0[x]]
                found = pa.table({"digest": [t // 2 for t, _ in cells], "term": pa.array(["ab"[t % 2] for t, _ in cells]),
                                  "no": [x for _, x in cells], "p": [int(dense[t, x]) for t, x in cells]})
                key = tuple(pa.scalar(k) for k in (1, i, j, 0))
                out = divergence._unit(key, found, pa.table({"no": own[::-1], "p0": p0[own[::-1]]}))
                for r in out.to_pylist():
                    if (r["a"], r["b"]) in got:
                        f0 = (p0[r["a"]] - p0[r["b"]]) ** 2 // (p0[r["a"]] + p0[r["b"]])
                        got[r["a"], r["b"]] += r["total"] + int(f0) * (len(part) - r["met"])
    assert got == want

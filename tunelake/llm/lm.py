"""Language-model scoring with an Elias-Fano n-gram trie.

Model: words of the training documents with their counts (level 1), and all
their bigrams (level 2; ``min_count`` above 1 leaves rare ones out), interpolated:

    P(w | v) = (c(vw) - D) / c(v) + backoff(v) * (c(w) + 1) / (N + V + 1)

where backoff(v) is what the discounted bigrams of v leave of 1, so that
probabilities add up to 1 (the first term, quantised to 8 bits, is rounded
down). Every text starts from a start mark and ends with the end token.

Level 2 is a trie level cut into segments by key range (a hot context spans
several): the contexts and the pointers to their children are monotone
sequences in Elias-Fano form, and so are the children, whose word ids are
added up from context to context; a lookup adds the word to the last value of
the context before and searches that value's successor.

Counting covers all training documents. Workers add up repeats before they
send; bigram keys travel as compressed sorted blocks, dealt by a hash of the
key, so that no context is hot. Level files are written by Spark to the shared
folder; a task per file lays its columns open beside it, and workers memory-map
those: neither heap, driver nor local disk follows the model's size. Only names
of files pass through the driver. From a store that is not mounted, workers
copy the columns to their executor's disk instead.

Results: null counts as the empty text (its only token is the end). With no
training documents every probability is 1. Rows without an id train. Words are
told apart by 64-bit hashes. Repeated rows count and score each; an empty
table gives an empty result; further columns are ignored."""

from __future__ import annotations

import os
import uuid
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import eliasfano
from .base import id_remainder, table
from .words import chunks, split_words

FOLDS, HELD_OUT = 7, 2
MIN_COUNT = 1
DISCOUNT = 0.75
TALLY = 500_000
BUCKET_KEYS = 4_000_000
SEGMENT_KEYS = 2_000_000
#: Keys that are merged at once.
RANGE_KEYS = 1 << 17
#: Quantised log10: value q stands for -q * STEP; 255 is the least.
STEP = 12 / 255

_MODELS: dict = {}


#: Fixed random odd multipliers, one for each place in a word; words of more bytes are hashed one by one.
_MULTIPLIERS = np.random.default_rng(20240817).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: Bytes that are taken apart at once.
PIECE = 1 << 19
END = np.int64(-1)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a lower-cased text and where they start: multilinear, so of whole arrays of bytes."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.flatnonzero(~_SPACE[raw])
    if not len(inside):
        return np.empty(0, np.int64), inside
    first = np.flatnonzero(np.concatenate([[True], np.diff(inside) != 1]))
    size = np.diff(np.append(first, len(inside)))
    place = np.arange(len(inside)) - np.repeat(first, size)
    h = np.add.reduceat((raw[inside].astype(np.uint64) + np.uint64(1)) * _MULTIPLIERS[place & 255], first)
    start = inside[first]
    for w in np.flatnonzero(size > len(_MULTIPLIERS)):
        h[w] = xxhash.xxh3_64_intdigest(text[start[w]:start[w] + size[w]])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(1)).view(np.int64), start


def pieces(texts: list):
    """The texts joined by line ends, lower-cased, in pieces of about PIECE bytes: (bytes, starts of the texts)."""
    held, starts, size = [], [], 0
    for t in texts:
        held.append(t or b"")
        starts.append(size)
        size += len(held[-1]) + 1
        if size >= PIECE:
            yield b"\n".join(held).lower(), np.array(starts)
            held, starts, size = [], [], 0
    if held:
        yield b"\n".join(held).lower(), np.array(starts)


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts (END after the words of each) and tokens per text."""
    out, lengths = [], []
    for joined, starts in pieces(texts):
        h, at = word_hashes(joined)
        n = np.diff(np.append(np.searchsorted(at, starts), len(h)))
        whole = np.full(len(h) + len(starts), END)
        whole[np.arange(len(h)) + np.repeat(np.arange(len(starts)), n)] = h
        out.append(whole)
        lengths.append(n + 1)
    return (np.concatenate(out), np.concatenate(lengths)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


#: Rows of a batch that are turned into Python's texts at once.
ROWS = 512


def texts_of(column):
    return chunks(t for i in range(0, len(column), ROWS) for t in column.slice(i, ROWS).cast(pa.binary()).to_pylist())


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def merged(parts: list, most: int = RANGE_KEYS):
    """Distinct sorted keys and the sums of their counts, out of parts of which each has these, in ranges of about
    ``most`` keys: only one range at a time is joined and sorted."""
    if not parts:
        return
    every = max(1, most // (4 * len(parts)))
    sample = np.sort(np.concatenate([k[::every] for k, _ in parts]))
    step = max(1, most // every)
    bounds = np.unique(sample[step::step])
    edges = [np.concatenate([[0], np.searchsorted(k, bounds), [len(k)]]) for k, _ in parts]
    for r in range(len(bounds) + 1):
        some = [(k[e[r]:e[r + 1]], c[e[r]:e[r + 1]]) for (k, c), e in zip(parts, edges) if e[r] < e[r + 1]]
        if some:
            yield summed(*map(np.concatenate, zip(*some)))


def in_order(keys: array, counts: array) -> tuple[np.ndarray, np.ndarray]:
    """The keys, which are distinct, sorted in place, and the counts in the same order."""
    k, c = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
    c = c[np.argsort(k)]
    k.sort()
    return k, c


class Tally:
    """Counts of keys, handed out when they no longer fit."""

    def __init__(self, most: int = TALLY):
        self.most, self.parts, self.held = most, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> bool:
        """True if the counts should be taken out now."""
        k, c = np.unique(keys, return_counts=True) if counts is None else summed(keys, counts)
        self.parts.append((k, c))
        self.held += len(k)
        if self.held > 2 * self.most:
            k, c = self.take()
            self.parts, self.held = [(k, c)], len(k)
        return self.held > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        ranges = list(merged(self.parts))
        self.parts, self.held = [], 0
        if not ranges:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys, counts = map(np.concatenate, zip(*ranges))
        return keys, counts


def count_words(train: DataFrame) -> DataFrame:
    """(h, c): every training token with its count."""
    def count(batches):
        tally = Tally()
        for b in batches:
            for texts in texts_of(b.column(0)):
                words = Counter()
                for t in texts:
                    words.update(split_words(t))
                distinct = tokens([b" ".join(words)])[0]  # in their order, and one end
                if tally.add(distinct, np.append(np.fromiter(words.values(), np.int64, len(words)), len(texts))):
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, tally.take())), ["h", "c"])
        yield pa.RecordBatch.from_arrays(list(map(pa.array, tally.take())), ["h", "c"])

    return train.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def word_level(words: DataFrame) -> DataFrame:
    """The words in files of sorted hashes, one row a file: first hash, number, sum of counts, hashes, counts."""
    def pack(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            h, c = t["h"].to_numpy().astype(np.int64), t["c"].to_numpy().astype(np.int64)
            row = {"first": int(h[0]), "n": len(h), "total": int(c.sum()), "h": h.tobytes(), "c": c.tobytes()}
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row.values()], list(row))

    return words.repartitionByRange("h").sortWithinPartitions("h").mapInArrow(pack, "first long, n long, total long, h binary, c binary")


def published(level: DataFrame) -> list[str]:
    """Have tasks lay the level's binary columns open beside its files; the files' names."""
    files = sorted(level.inputFiles())

    def lay(batches):
        for b in batches:
            mapped_rows(b.column(0).to_pylist())
            yield b

    rows = level.sparkSession.createDataFrame([(f,) for f in files], "file string")
    rows.repartition(max(1, len(files))).mapInArrow(lay, "file string").write.format("noop").mode("overwrite").save()
    return files


def raw_place(uri: str):
    """(file system, path, beginning of the names of the raw files) of a level file. In a shared folder that is
    mounted they stand beside it; from another store each executor takes its own copy."""
    from pyarrow.fs import FileSystem, LocalFileSystem
    from pyspark import SparkFiles

    store, path = FileSystem.from_uri(uri)
    folder, name = os.path.split(path)
    return store, path, os.path.join(folder if isinstance(store, LocalFileSystem) else SparkFiles.getRootDirectory(), "_" + name)


def mapped_rows(files: list[str]) -> list[dict]:
    """The rows of the level's files; binary columns become read-only memory maps."""
    import pyarrow.parquet as pq

    rows = []
    for uri in files:
        store, path, raw_name = raw_place(uri)
        schema = pq.read_schema(path, filesystem=store)
        wide = [f.name for f in schema if pa.types.is_binary(f.type)]
        small = pq.read_table(path, columns=[c for c in schema.names if c not in wide], filesystem=store).to_pylist()
        for k in wide:
            raws = [f"{raw_name}.{i}.{k}.raw" for i in range(len(small))]
            if not all(map(os.path.exists, raws)):  # of two workers either may be first
                for raw, v in zip(raws, pq.read_table(path, columns=[k], filesystem=store)[k].to_pylist()):
                    with open(own := f"{raw}.{uuid.uuid4().hex}", "wb") as f:
                        f.write(v)
                    os.replace(own, raw)
            for row, raw in zip(small, raws):
                row[k] = np.memmap(raw, np.uint8, "r") if os.path.getsize(raw) else np.empty(0, np.uint8)
        rows += small
    return rows


class Words:
    """Level 1: ids (places in hash order) and counts of words."""

    def __init__(self, names: list[str]):
        rows = sorted(mapped_rows(names), key=lambda r: r["first"])
        self.firsts = np.array([r["first"] for r in rows], np.int64)
        self.h = [r["h"].view(np.int64) for r in rows]
        self.c = [r["c"].view(np.int64) for r in rows]
        self.offsets = np.concatenate([[0], np.cumsum([len(h) for h in self.h])]).astype(np.int64)
        self.n = int(self.offsets[-1])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of sorted distinct hashes; -1 and 0 for unknown ones."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        edges = np.append(np.searchsorted(hashes, self.firsts), len(hashes))
        for p in range(len(self.h)):
            part = slice(edges[p], edges[p + 1])
            at = np.searchsorted(self.h[p], hashes[part])
            known = (at < len(self.h[p])) & (self.h[p][np.minimum(at, len(self.h[p]) - 1)] == hashes[part])
            ids[part] = np.where(known, at + self.offsets[p], -1)
            counts[part] = np.where(known, self.c[p][np.minimum(at, len(self.h[p]) - 1)], 0)
        return ids, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids."""
        out = np.zeros(len(ids), np.int64)
        edges = np.searchsorted(ids, self.offsets)
        for p in range(len(self.h)):
            part = slice(edges[p], edges[p + 1])
            out[part] = self.c[p][ids[part] - self.offsets[p]]
        return out

    def numbered(self, texts: list):
        """(id, count, tokens per text) of all tokens of the texts."""
        h, lengths = tokens(texts)
        distinct, back = np.unique(h, return_inverse=True)
        ids, counts = self.find(distinct)
        return ids[back], counts[back], lengths


def contexts(ids: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """The id before each token; ``start`` at the beginning of a text."""
    out = np.empty(len(ids), np.int64)
    out[1:] = ids[:-1]
    out[np.cumsum(lengths) - lengths] = start
    return out


def mixed(keys: np.ndarray) -> np.ndarray:
    """A hash of integer keys."""
    x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(20)


def packed_keys(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and counts, compressed: differences by planes of bytes."""
    import zstandard

    steps = np.diff(keys, prepend=0)
    planes = np.concatenate([steps.view(np.uint8).reshape(-1, 8).T.ravel(), counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T.ravel()])
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // 16
    two = [np.ascontiguousarray(x.reshape(8, n).T).view(np.int64).ravel() for x in (raw[:8 * n], raw[8 * n:])]
    return np.cumsum(two[0]), two[1]


def count_bigrams(train: DataFrame, names: list[str], n_tokens: int, min_count: int = MIN_COUNT) -> DataFrame:
    """(key, c) of the training bigrams of at least ``min_count``; key = id before * V + id, the start mark has id V."""
    buckets = max(24, -(-n_tokens // BUCKET_KEYS))
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.binary())])

    def send(keys, counts):
        own = (mixed(keys) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(own, kind="stable")
        own, keys, counts = own[order], keys[order], counts[order]
        edges = np.searchsorted(own, np.arange(buckets + 1))
        rows = [(b, packed_keys(keys[i:j], counts[i:j])) for b, (i, j) in enumerate(zip(edges, edges[1:])) if j > i]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

    def count(batches):
        words, tally = Words(names), Tally()
        for b in batches:
            for texts in texts_of(b.column(0)):
                ids, _, lengths = words.numbered(texts)
                if tally.add(contexts(ids, lengths, words.n) * words.n + ids):
                    yield send(*tally.take())
        yield send(*tally.take())

    def merge(batches):
        held, bucket = [], None

        def out():
            for k, c in merged(held):
                kept = c >= min_count
                yield pa.RecordBatch.from_arrays([pa.array(k[kept]), pa.array(c[kept])], ["key", "c"])
            held.clear()

        for batch in batches:
            for b, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != bucket:
                    yield from out()
                bucket = b
                held.append(unpacked_keys(block.as_buffer()))
        yield from out()

    blocks = train.select("text").mapInArrow(count, "bucket int, block binary")
    return blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, "key long, c long")


SEQUENCES = ("contexts", "starts", "children")
SEGMENT = "first long, first_context long, last_context long, sums binary, quantised binary, " + ", ".join(
    f"{s}_{part} binary" for s in SEQUENCES for part in ("head", "high", "ranks", "low"))


def segment(keys: np.ndarray, counts: np.ndarray, v: int, context_counts, discount: float = DISCOUNT) -> dict:
    """One part of level 2 from sorted keys. context_counts: the counts of sorted context ids. Of the keys only their
    shares and children are laid out whole; the rest is made SLICE keys at a time."""
    n = len(keys)
    slices = [slice(a, min(a + eliasfano.SLICE, n)) for a in range(0, n, eliasfano.SLICE)]
    new = np.ones(n, bool)
    for s in slices:
        before = keys[max(0, s.start - 1):s.stop] // v
        new[max(1, s.start):s.stop] = before[1:] != before[:-1]
    first = np.flatnonzero(new)
    del new
    ids = keys[first] // v
    total = context_counts(ids)

    def context_of(s):
        """Which context each key of the slice has."""
        return np.searchsorted(first, np.arange(s.start, s.stop), "right") - 1

    share, quantised = np.empty(n), np.empty(n, np.uint8)
    for s in slices:
        share[s] = (counts[s] - discount) / total[context_of(s)]
        quantised[s] = np.minimum(255, np.ceil(-np.log10(share[s]) / STEP - 1e-9))
    out = {"first": int(keys[0]), "first_context": int(ids[0]), "last_context": int(ids[-1]),
           "sums": np.add.reduceat(share, first).astype(np.float32).tobytes(), "quantised": quantised.tobytes()}
    del share, quantised
    # each context's word ids follow the last value of the context before
    width = keys[np.append(first[1:], n) - 1] % v + 1
    base = np.concatenate([[0], np.cumsum(width)[:-1]])
    children = np.empty(n, np.int64)
    for s in slices:
        children[s] = keys[s] % v + base[context_of(s)]
    for name, values in zip(SEQUENCES, (ids - ids[0], np.append(first, n), children)):
        out |= {f"{name}_{k}": x for k, x in eliasfano.encode(values).items()}
    return out


class Trie:
    """Level 2: shares of bigrams and backoff weights of contexts."""

    def __init__(self, rows: list[dict]):
        self.rows = sorted(rows, key=lambda r: r["first"])
        self.firsts = np.array([r["first"] for r in self.rows], np.int64)
        self.parts = [{s: eliasfano.Sequence(*(np.asarray(r[f"{s}_{p}"]) for p in ("head", "high", "ranks", "low")))
                       for s in SEQUENCES} | {"sums": np.asarray(r["sums"]).view(np.float32), "quantised": np.asarray(r["quantised"])}
                      for r in self.rows]
        #: Contexts at the edge of a segment may go on in the next one.
        self.edge: dict[int, float] = {}
        for r, p in zip(self.rows, self.parts):
            for at, c in {(0, r["first_context"]), (len(p["sums"]) - 1, r["last_context"])}:
                self.edge[c] = self.edge.get(c, 0.0) + float(p["sums"][at])

    def find(self, before: np.ndarray, word: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray]:
        """(share, backoff) for sorted distinct (before, word); unknown ids (-1) have no bigram."""
        share, left = np.zeros(len(before)), np.ones(len(before))
        known = np.flatnonzero((before >= 0) & (word >= 0))
        keys = before[known] * v + word[known]
        edges = np.append(np.searchsorted(keys, self.firsts), len(keys))
        for p, (row, part) in enumerate(zip(self.rows, self.parts)):
            at = known[edges[p]:edges[p + 1]]
            if not len(at):
                continue
            # what depends on the context alone is read once for all its words
            new = np.flatnonzero(np.concatenate([[True], before[at[1:]] != before[at[:-1]]]))
            i = part["contexts"].find(before[at[new]] - row["first_context"])
            there, times = i >= 0, np.diff(np.append(new, len(at)))
            i, at, times = i[there], at[np.repeat(there, times)], times[there]
            if not len(at):
                continue
            start = part["starts"][i]
            base = np.where(start > 0, part["children"][np.maximum(start - 1, 0)] + 1, 0)
            left[at] = np.repeat(1 - part["sums"][i].astype(np.float64), times)
            start, end = np.repeat(start, times), np.repeat(part["starts"][i + 1], times)
            j = part["children"].find(np.repeat(base, times) + word[at])
            hit = (j >= start) & (j < end)
            share[at[hit]] = 10.0 ** (-STEP * part["quantised"][j[hit]].astype(np.float64))
        # backoff needs the context only, so unknown words count too, and all parts of a context
        lone = np.flatnonzero((before >= 0) & (word < 0))
        low = np.searchsorted(before[lone], [r["first_context"] for r in self.rows], "left")
        high = np.searchsorted(before[lone], [r["last_context"] for r in self.rows], "right")
        for row, part, a, b in zip(self.rows, self.parts, low, high):
            if a < b:
                at = lone[a:b]
                i = part["contexts"].find(before[at] - row["first_context"])
                left[at[i >= 0]] = 1 - part["sums"][i[i >= 0]].astype(np.float64)
        for c, total in self.edge.items():
            a, b = np.searchsorted(before, [c, c + 1])
            left[a:b] = 1 - total
        return share, np.maximum(left, 0.0)


class Model:
    def __init__(self, words: list[str], bigrams: list[str], n: int):
        self.words, self.trie, self.n = Words(words), Trie(mapped_rows(bigrams)), n

    def score(self, texts: list) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score, score of each text."""
        ids, counts, lengths = self.words.numbered(texts)
        v = self.words.n
        first = np.cumsum(lengths) - lengths
        unigram = (counts + 1) / (self.n + 1 * (v + 1))
        out = {"n_tokens": lengths, "n_known": np.add.reduceat((counts > 0).astype(np.int64), first),
               "base_score": np.add.reduceat(np.log10(unigram), first)}
        # all bigrams of the texts once, in order; unknown words (-1) come first
        pair = (contexts(ids, lengths, v) + 1) * (v + 1) + ids + 1
        del ids, counts
        distinct, back = np.unique(pair, return_inverse=True)
        del pair
        share, left = self.trie.find(distinct // (v + 1) - 1, distinct % (v + 1) - 1, max(v, 1))
        p = share[back] + left[back] * unigram
        return out | {"score": np.add.reduceat(np.log10(p), first)}


def model(words: list[str], bigrams: list[str], n: int) -> Model:
    """One model per worker process."""
    key = (*words, "", *bigrams)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(words, bigrams, n)
    return _MODELS[key]


def fit(docs: DataFrame, min_count: int = MIN_COUNT, segment_keys: int = SEGMENT_KEYS) -> tuple[list[str], list[str], int]:
    """(files of level 1, files of level 2, tokens): the model of these documents."""
    level = materialize(word_level(count_words(docs)), "lm-words")
    n, v = (int(x or 0) for x in level.agg(F.sum("total"), F.sum("n")).first())
    names = published(level)
    if not n:
        return names, [], 0
    kept = materialize(count_bigrams(docs, names, n, min_count), "lm-bigrams")

    def cut(batches):
        keys, counts = array("q"), array("q")
        for b in batches:  # their memory is not kept
            keys.frombytes(b.column(0).to_numpy().view(np.uint8))
            counts.frombytes(b.column(1).to_numpy().view(np.uint8))
        if keys:
            words = Words(names)
            texts = int(words.find(tokens([None])[0])[1][0])  # every training text has one end

            def context_counts(ids):
                inside = ids[ids < v]
                return np.append(words.counts_of(inside), [texts] * (len(ids) - len(inside)))

            row = segment(*in_order(keys, counts), v, context_counts)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row.values()], list(row))

    parts = max(8, -(-kept.count() // segment_keys))
    trie = kept.repartitionByRange(parts, "key").mapInArrow(cut, SEGMENT)
    return names, published(materialize(trie, "lm-trie")), n


def score(docs: DataFrame, train: DataFrame, keep=("doc_id",), **how) -> DataFrame:
    """The columns ``keep`` of every document, with n_tokens, n_known, train_tokens, base_score and score under the
    model of ``train``."""
    words, bigrams, n = fit(train, **how)
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = docs.select(*keep, F.col("text"))

    def run(batches):
        m = model(words, bigrams, n)
        for b in batches:
            got = [m.score(texts) for texts in texts_of(b.column(len(keep)))]
            if not got:
                continue
            out = {k: np.concatenate([g[k] for g in got]) for k in got[0]}
            out["train_tokens"] = np.full(b.num_rows, n, np.int64)
            yield pa.RecordBatch.from_arrays(b.columns[:len(keep)] + [pa.array(out[k]) for k in added], [*keep, *added])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:len(keep)]]
    return rows.mapInArrow(run, ", ".join(fields + [f"{c} {'double' if 'score' in c else 'long'}" for c in added]))


def op8_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    return score(docs.select("doc_id", held.alias("held_out"), "text"), docs.where(~held), ("doc_id", "held_out"))

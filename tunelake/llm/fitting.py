"""Best-fit packing of documents into sequences with a bounded number of open bins.

A document is its token ids and the end id. Documents longer than a sequence
are cut into full pieces from the end, so that only the first piece may be
shorter; full pieces are sequences of their own. The others are packed online:
a task takes its pieces in a hash order, in runs of half the tokens that its
bins hold, the longest of a run first, and keeps OPEN bins open, in a bitset
keyed by free space, whose lowest set bit from a piece's length on is the best
fit. A piece that fits in no open bin opens one, for which the fullest closes.

A task has at most OPEN bins open when its pieces end; what they hold goes to
the next pass, together with the rest of the other tasks. TASK_TOKENS makes
that a small share, so passes shrink quickly; the last one has at most
TASK_TOKENS tokens, takes its longest pieces first and closes no bin before
the end. Only rows of six numbers move between passes, never texts or ids.

Token ids are those of the tokenizers library for a tokenizer file; strings of
special tokens in a text are ordinary text. For a plain byte-level BPE file
whose merges are numbered in their order, each worker builds the equal tiktoken
encoding from that file, which gives the same ids (a test compares them for
every code point) in a fifth of the time; any other file is run by tokenizers.

Results: null and empty texts are the end id alone; rows without an id and
repeated rows are packed like all others; an empty table gives an empty
result; other columns are ignored. Reruns on the same files agree."""

from __future__ import annotations

import json
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .base import table

CAPACITY = 1024
END = 2
OPEN = 512
TASK_TOKENS = 8192 * CAPACITY
#: Open bins with at most this share of free space close when a task's pieces end.
NEARLY_FULL = 64
BATCH = 20_000


def byte_of_character() -> dict[str, int]:
    """The byte that a character of a byte-level vocabulary stands for: printable ones stand for
    themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def ranks(definition: dict) -> dict[bytes, int] | None:
    """bytes -> id if ids in merge order say all about the tokenizer, else None."""
    model, before = definition["model"], definition["pre_tokenizer"] or {}
    plain = (model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
             and not definition["normalizer"] and not any(model.get(k) for k in (
                 "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")))
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]] if plain else []
    special = {a["content"] for a in definition["added_tokens"] if a["special"]}
    if not plain or len(special) < len(definition["added_tokens"]):
        return None
    if len(merges) + 256 != len(set(model["vocab"]) - special) or any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    byte = byte_of_character()
    return {bytes(byte[c] for c in entry): i for entry, i in model["vocab"].items() if entry not in special}


class Encoder:
    """Text -> token ids as unsigned 32-bit numbers, 4 bytes each."""

    def __init__(self, definition: str):
        numbered = ranks(json.loads(definition))
        if numbered:
            import public_tokenizers
            import tiktoken

            fast = tiktoken.Encoding("numbered", pat_str=public_tokenizers.PATTERN, mergeable_ranks=numbered, special_tokens={})
            self.ids = lambda text: fast.encode_to_numpy(text, disallowed_special=()).tobytes()
        else:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_str(definition)
            slow.encode_special_tokens = True
            self.ids = lambda text: array("I", slow.encode(text, add_special_tokens=False).ids).tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """One encoder per worker process."""
    if definition not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[definition] = Encoder(definition)
    return _ENCODERS[definition]


def bounds(length: int, capacity: int = CAPACITY) -> list[int]:
    """Where the pieces of a document start: all full, but for the first."""
    return [0] + list(range((length - 1) % capacity + 1, length, capacity))


class BestFit:
    """At most ``most`` open bins, in a bitset keyed by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.open = capacity, most, 0
        self.bits, self.bins = 0, [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> list:
        same = self.bins[free]
        found = same.pop()
        if not same:
            self.bits &= ~(1 << free)
        return found

    def put(self, item, length: int) -> list[list]:
        """Place an item; the bins that are closed by it."""
        closed, fits = [], self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            held = self._take(free)
        else:
            if self.open == self.most:  # the fullest closes
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
                self.open -= 1
            free, held = self.capacity, []
            self.open += 1
        held.append(item)
        free -= length
        if free:
            self.bins[free].append(held)
            self.bits |= 1 << free
        else:
            closed.append(held)
            self.open -= 1
        return closed

    def rest(self):
        """(free space, bin) of the open bins."""
        for free, same in enumerate(self.bins):
            for held in same:
                yield free, held


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid long"
PACKED = PIECES + ", sequence_id long, offset long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    types = [pa.int32() if k == "int" else pa.int64() for k in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], list(names))


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece; pid numbers the pieces of all tasks."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary: its size does not grow with the data

    tail = array("I", [end]).tobytes()

    def run(batches):
        from pyspark import TaskContext

        encode, pid, rows = encoder(shared.value), TaskContext.get().partitionId() << 36, []
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                data = (encode.ids(text.as_py()) if text.is_valid else b"") + tail
                starts = bounds(len(data) // 4, capacity)
                for i, (s, e) in enumerate(zip(starts, [*starts[1:], len(data) // 4])):
                    rows.append((doc_id, i, s, e - s, zlib.crc32(memoryview(data)[4 * s:4 * e]), pid))
                    pid += 1
                if len(rows) >= BATCH:
                    yield _batch(rows, PIECES)
                    rows = []
        if rows:
            yield _batch(rows, PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def _longest_first(batches, tokens: int, sorted_: bool):
    """Runs of rows that have ``tokens`` together, the longest first, or all rows as they come."""
    held, total = [], 0
    for b in batches:
        for item in zip(*(c.to_pylist() for c in b.columns)):
            held.append(item)
            total += item[3]
            if total >= tokens:
                yield held if sorted_ else sorted(held, key=lambda r: -r[3])
                held, total = [], 0
    yield held if sorted_ else sorted(held, key=lambda r: -r[3])


def _pass(rows: DataFrame, tasks: int, last: bool, capacity: int, most: int) -> DataFrame:
    """The rows of PIECES with their sequence and place, or null where they wait for the next pass."""
    def run(batches):
        bins, out = BestFit(capacity, 1 << 62 if last else most), []

        def place(held):
            offset = 0
            for item in held:
                out.append((*item, held[0][5], offset))
                offset += item[3]

        for part in _longest_first(batches, most * capacity // 2, last):
            for item in part:
                for held in bins.put(item, item[3]):
                    place(held)
                if len(out) >= BATCH:
                    yield _batch(out, PACKED)
                    out.clear()
        for free, held in bins.rest():
            if last or free * NEARLY_FULL <= capacity:
                place(held)
            else:
                out.extend((*item, None, None) for item in held)
            if len(out) >= BATCH:
                yield _batch(out, PACKED)
                out.clear()
        if out:
            yield _batch(out, PACKED)

    # round robin deals out equal numbers; the hash makes the order inside a task independent of the table's
    order = [F.desc("length"), F.xxhash64("pid"), "pid"] if last else [F.xxhash64("pid"), "pid"]
    return rows.repartition(tasks).sortWithinPartitions(*order).mapInArrow(run, PACKED)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, most: int = OPEN,
         task_tokens: int = TASK_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    if task_tokens < 8 * most * capacity:
        raise ValueError("a task needs at least 8 times the tokens that its open bins hold")
    all_pieces = materialize(pieces(docs, path, capacity, end), "pieces")
    names = [f.split()[0] for f in PACKED.split(", ") if not f.startswith("pid")]
    out = [all_pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.col("pid")).withColumn("offset", F.lit(0).cast("long"))]
    waiting = all_pieces.where(F.col("length") < capacity)
    while True:
        tasks = max(1, -(-(waiting.agg(F.sum("length")).first()[0] or 0) // task_tokens))
        done = materialize(_pass(waiting, tasks, tasks == 1, capacity, most), "packed")
        out.append(done.where(F.col("sequence_id").isNotNull()))
        if tasks == 1:
            break
        waiting = done.where(F.col("sequence_id").isNull()).drop("sequence_id", "offset")
    whole = out[0].select(names)
    for part in out[1:]:
        whole = whole.unionByName(part.select(names))
    return whole


def op12_best_fit(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))

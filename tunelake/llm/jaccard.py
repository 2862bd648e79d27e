"""N-gram Jaccard join by a blocked sparse matrix product.

Documents are rows of a 0/1 matrix over shingles (``WIDTH`` words, as 64-bit
hashes). Two rows link when 100 * overlap >= THRESHOLD * union.

1. Equal shingle sets are one class; everything below runs on classes, and
   copies only come back at the end.
2. Size-derived bound: let all shingles stand in one order. Rows that link
   share one of the first n - ceil(t * n) + 1 shingles of each.
3. The order takes rare shingles first, which keeps candidates few; any order
   finds every link. It starts from the length of a shingle's words (long
   words are rare); then the first shingles of all documents are counted, and
   those that several documents share go last, by their count (kept by cells
   of a hash in a table of fixed size).
4. Each first shingle shared by several classes has a hub, the class with the
   fewest rare shingles. The classes that share such a shingle with a hub make
   its group, so every pair that may link is in some group. Shingles of one
   class only are dropped before the shuffle, by a bit table of fixed size that
   counts all first shingles, packed in 5 bytes each.
5. A group is cut into blocks of bounded size, and each pair of blocks is one
   unit. Units are dealt with sketches first: counts of a row's shingles by
   ranges of hashes, a byte for 3 to 6 shingles. Two rows share at most the
   smaller count of each range, so a pair below the threshold by that bound is
   no link; rows of a unit that no such pair is left of go before any shingles
   are read, and the rest are units by the pairs left. In a group of several
   blocks the rows that link to its hub are found before, each with the hub.
6. The shingles of the rows left are dealt by these units. Overlaps are
   accumulated as products of column blocks of the incidence matrix. Rows that
   link to the hub are in its component and need no product among each other;
   the rest meets the rows whose size allows a link. A unit returns the
   components of its rows as stars, never its pairs.
7. Components of all stars: alternating stars over the class graph.

Shuffle files are removed as each written table is done.

Results: null, empty and blank texts have no shingle and link with nothing;
fewer than ``WIDTH`` words make one shingle; rows without an id take part, but
a component's id is its smallest non-null id (null if there is none); repeated
rows share a component; an empty table gives an empty result; further columns
are ignored by ``link`` and kept by ``one_per_component``."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize_tidy as materialize
from .base import WORD, if_small, packed, table, unpacked
from .components import components
from .words import hashed, split_words

WIDTH = 3
THRESHOLD = 90
CELL_BITS = 24
#: Letters beyond this don't make a word rarer.
LONG_WORD = 40
CLASS_BITS = 48
BLOCK_ROWS = 512
BLOCK_SHINGLES = 1_000_000
COLUMNS = 2048
ROWS = 128
#: A sketch has a cell for at most so many shingles.
CELL_SHINGLES = 6
TABLE_BITS = 27
PART_BITS = 10


def in_order(text: bytes | None, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the text's shingles in the order of the text, and the bytes of the words of each."""
    words = split_words(text)
    if len(words) < width:
        return (np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64),
                np.zeros(min(1, len(words)), np.int64))
    h, last = hashed(words), len(words) - width + 1
    letters = np.minimum(np.fromiter(map(len, words), np.int64, len(words)), LONG_WORD)
    out, length = h[:last].copy(), letters[:last].copy()
    for i in range(1, width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:last + i]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xD6E8FEB86659FD93)
        length += letters[i:last + i]
    return out ^ (out >> np.uint64(32)), length


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(in_order(text, width)[0])


def set_key(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def class_number(key):
    """The first bits of a class key as a non-negative number (Spark column)."""
    return F.conv(F.substring(F.hex(key), 1, CLASS_BITS // 4), 16, 10).cast("long")


def _texts(column):
    return column.cast(pa.binary()).to_pylist()


def prefix_length(n, threshold: int = THRESHOLD):
    return n - (threshold * n + 99) // 100 + 1


def first_shingles(g: np.ndarray, length: np.ndarray, level: np.ndarray | None, threshold: int) -> tuple[np.ndarray, int]:
    """The first of distinct shingles in the common order, and how many of them have level 0."""
    often = np.zeros(len(g), np.uint8) if level is None else level[g & np.uint64(len(level) - 1)]
    order = np.lexsort((g, -length, often))[:prefix_length(len(g), threshold)]
    return g[order], int((often[order] == 0).sum())


def sketch_cells(n: int) -> int:
    return 1 << max(4, (n // CELL_SHINGLES).bit_length())


def sketch(grams: np.ndarray) -> bytes:
    """How many shingles are in each of 2**b equal ranges of hashes, in as few bytes as hold the largest count."""
    cells = sketch_cells(len(grams))
    count = np.bincount((grams >> np.uint64(65 - cells.bit_length())).astype(np.int64), minlength=cells)
    return count.astype(np.min_scalar_type(int(count.max()))).tobytes()


def counts_of(drawn: bytes, n: int) -> np.ndarray:
    return np.frombuffer(drawn, f"u{len(drawn) // sketch_cells(n)}").astype(np.uint32)


def distinct_classes(texts, width: int, most: int = 200_000):
    """(set key, shingles, lengths, new) of each text; new: not met lately, which only saves work on copies."""
    seen: set[bytes] = set()
    for t in texts:
        g, length = in_order(t, width)
        g, at = np.unique(g, return_index=True)
        key = set_key(g) if len(g) else None
        new = key is not None and key not in seen
        if new:
            if len(seen) >= most:
                seen.clear()
            seen.add(key)
        yield key, g, length[at], new


def survey(docs: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, sha (of the text), key and n of its shingle set, and its first shingles by word
    length and its sketch (null where the task has met the set before)."""
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        for b in batches:
            texts, out = _texts(b.column(1)), []
            for t, (key, g, length, new) in zip(texts, distinct_classes(texts, width)):
                first = first_shingles(g, length, None, threshold)[0].view(np.int64) if new else None
                out.append((hashlib.sha256(t or b"").digest(), key, len(g), first, sketch(g) if new else None))
            kinds = pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)],
                                             ["doc_id", "sha", "key", "n", "first", "sketch"])

    return materialize(rows.mapInArrow(scan, f"doc_id {id_type}, sha binary, key binary, n long, first array<bigint>, sketch binary"),
                       "shingle-survey")


def in_parts(rows: DataFrame, bits: int, part_bits: int) -> DataFrame:
    """(part, packed) of the arrays ``first``: for each batch of rows its shingles with equal bits ``bits - part_bits``
    to ``bits``, in 5 bytes each: the bits below, and of those above as many as fit."""
    low = bits - part_bits

    def scan(batches):
        for b in batches:
            g = b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            part = (g >> np.uint64(low) & np.uint64((1 << part_bits) - 1)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            g, part = g[order], part[order]
            value = g & np.uint64((1 << low) - 1) | g >> np.uint64(bits) << np.uint64(low)
            five = value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            at = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
            yield pa.RecordBatch.from_arrays([pa.array(part[at[:-1]], pa.int32()), pa.array(
                [five[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary())], ["part", "packed"])

    return rows.select("first").where("first is not null").mapInArrow(scan, "part int, packed binary")


def unpacked_values(packed_values) -> np.ndarray:
    five = np.frombuffer(b"".join(packed_values), np.uint8).reshape(-1, 5)
    out = np.zeros((len(five), 8), np.uint8)
    out[:, :5] = five
    return out.view("<u8").ravel()


def levels(surveyed: DataFrame, cell_bits: int = CELL_BITS) -> bytes:
    """A byte for each cell of shingles: 0 if none of them is a first shingle of several sets, else the logarithm of
    their count. Its size is fixed."""
    low = min(16, cell_bits)

    def pack(key, f):
        value, count = np.unique(unpacked_values(f["packed"]), return_counts=True)
        total = np.bincount((value & np.uint64((1 << low) - 1)).astype(np.int64), np.where(count > 1, count, 0), 1 << low)
        return pd.DataFrame([{"part": key[0], "levels": np.log2(np.maximum(total, 1)).astype(np.uint8).tobytes()}])

    per = materialize(in_parts(surveyed, cell_bits, cell_bits - low).groupBy("part").applyInPandas(pack, "part int, levels binary"),
                      "levels")
    out = np.zeros(1 << cell_bits, np.uint8)
    for r in per.collect():  # a row for each 2**16 cells, 2**cell_bits bytes together
        out[r["part"] << low:(r["part"] + 1) << low] = np.frombuffer(r["levels"], np.uint8)
    return out.tobytes()


def bit_table(rows: DataFrame, column: str, cells_of) -> bytes:
    """2**TABLE_BITS bits: those of the cells are set that ``cells_of`` returns for the values ``column`` of each part,
    as places in it. Its size is fixed."""
    low = TABLE_BITS - PART_BITS

    def pack(key, f):
        bit = np.zeros(1 << low, np.uint8)
        bit[(cells_of(f[column]) & np.uint64((1 << low) - 1)).astype(np.int64)] = 1
        return pd.DataFrame([{"part": key[0], "bits": np.packbits(bit, bitorder="little").tobytes()}])

    per = materialize(rows.groupBy("part").applyInPandas(pack, "part int, bits binary"), "bit-table")
    size = 1 << low - 3
    out = np.zeros(1 << TABLE_BITS - 3, np.uint8)
    for r in per.collect():  # 2**(TABLE_BITS - 3) bytes together
        out[r["part"] * size:(r["part"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def bits_at(table: bytes, hashes: np.ndarray) -> np.ndarray:
    cell = hashes.view(np.uint64) & np.uint64((1 << TABLE_BITS) - 1)
    return (np.frombuffer(table, np.uint8)[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def shared_table(begun: DataFrame) -> bytes:
    """A bit table: 0 if no shingle of the cell is in two rows of ``first``."""
    def shared(column):
        value, count = np.unique(unpacked_values(column), return_counts=True)
        return value[count > 1]

    return bit_table(in_parts(begun, TABLE_BITS, PART_BITS), "packed", shared)


def in_table(docs: DataFrame, hashes: DataFrame):
    """A function of a column of 64-bit hashes: false only for those that are not among ``hashes`` (column h)."""
    part = F.shiftrightunsigned(F.col("h").bitwiseAND(F.lit((1 << TABLE_BITS) - 1)), TABLE_BITS - PART_BITS).cast("int")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(
        hashes.select("h", part.alias("part")), "h", lambda h: h.to_numpy(np.int64).view(np.uint64)))

    @F.pandas_udf("boolean")
    def found(h: pd.Series) -> pd.Series:
        return pd.Series(bits_at(table.value, h.to_numpy(np.int64)))

    return found


def beginnings(docs: DataFrame, level_bytes, threshold: int = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """(packed, first) of every class (copies may repeat it): number of rare first shingles, then class number."""
    def scan(batches):
        level = np.frombuffer(level_bytes.value, np.uint8)
        for b in batches:
            out = []
            for key, g, length, new in distinct_classes(_texts(b.column(0)), width):
                if new:
                    first, rare = first_shingles(g, length, level, threshold)
                    rare = min(rare, (1 << 63 - CLASS_BITS) - 1)
                    out.append((rare << CLASS_BITS | int.from_bytes(key[:CLASS_BITS // 8], "big"), first.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))],
                                             ["packed", "first"])

    return materialize(docs.select("text").mapInArrow(scan, "packed long, first array<bigint>"), "beginnings")


def groups(begun: DataFrame) -> DataFrame:
    """(hub, k): the class numbers of each hub's group, hub included."""
    number = (1 << CLASS_BITS) - 1
    shared_bytes = begun.sparkSession.sparkContext.broadcast(shared_table(begun))

    def scan(batches):  # most shingles are in one row only and go before the shuffle
        for b in batches:
            first = b.column(1)
            g = first.flatten().to_numpy(zero_copy_only=False)
            use = bits_at(shared_bytes.value, g)
            owner = np.repeat(b.column(0).to_numpy(), first.value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(owner[use]), pa.array(g[use])], ["packed", "gram"])

    entries = materialize(begun.where("first is not null").mapInArrow(scan, "packed long, gram long"), "entries")
    shared = materialize(entries.groupBy("gram").agg(F.min("packed").alias("hub"), F.max("packed").alias("other"))
                         .where(F.col("hub") != F.col("other")).select("gram", F.col("hub").bitwiseAND(F.lit(number)).alias("hub")), "shared")
    pairs = entries.join(if_small(shared, 48), "gram").select("hub", F.col("packed").bitwiseAND(F.lit(number)).alias("k"))
    return materialize(pairs.distinct(), "groups")


def overlaps(rows: list[np.ndarray], left: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Overlap counts of the rows ``left`` with the rows lo..hi, over blocks of shared columns."""
    part = [rows[i] for i in left] + rows[lo:hi]
    lengths = np.array([len(r) for r in part])
    owner = np.repeat(np.arange(len(part)), lengths)
    _, column, count = np.unique(np.concatenate(part), return_inverse=True, return_counts=True)
    use = count[column] > 1  # a column with one entry adds to no overlap
    owner = owner[use]
    _, column = np.unique(column[use], return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), hi - lo), np.float32)
    n_columns = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, n_columns, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        block = np.zeros((len(part), min(COLUMNS, n_columns - start)), np.float32)
        block[owner[a:b], column[a:b] - start] = 1
        out += block[:len(left)] @ block[len(left):].T
    return out.astype(np.int64)


def star(rows: list[np.ndarray], sizes: np.ndarray, hub: int, linked, threshold: int = THRESHOLD) -> np.ndarray:
    """The component of each row of a unit, as the index of one of its rows. sizes: the rows' numbers of shingles;
    linked(overlaps, sizes, sizes): which pairs link."""
    order = np.argsort(sizes, kind="stable")
    rows, sizes, hub = [rows[i] for i in order], sizes[order], int(np.flatnonzero(order == hub)[0])

    def partners(a, b):  # the rows whose size allows a link with sizes a to b
        return int(np.searchsorted(100 * sizes, threshold * a)), int(np.searchsorted(threshold * sizes, 100 * b, "right"))

    lo, hi = partners(sizes[hub], sizes[hub])
    near = np.zeros(len(rows), bool)
    near[lo:hi] = linked(overlaps(rows, np.array([hub]), lo, hi)[0], sizes[hub], sizes[lo:hi])
    label = np.arange(len(rows))
    label[near] = hub
    rest = np.flatnonzero(~near)
    for at in range(0, len(rest), ROWS):
        left = rest[at:at + ROWS]
        lo, hi = partners(sizes[left[0]], sizes[left[-1]])
        fit = (100 * np.minimum(sizes[left][:, None], sizes[lo:hi]) >= threshold * np.maximum(sizes[left][:, None], sizes[lo:hi]))
        hit = fit & linked(overlaps(rows, left, lo, hi), sizes[left][:, None], sizes[lo:hi])
        for i, own in zip(left, hit):
            joined = np.unique(label[np.append(lo + np.flatnonzero(own), i)])
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    out = np.empty(len(rows), np.int64)
    out[order] = order[label]
    return out


def possible(counts: list[np.ndarray], sizes: np.ndarray, hub: int, linked, threshold: int = THRESHOLD,
             near: np.ndarray | None = None) -> np.ndarray:
    """The component of each row of a unit as ``star`` tells it, -1 for a row without a partner, if all pairs linked
    that the sketches allow: two rows share at most the smaller count of each cell. near: rows that are known to link
    to the hub; pairs among them are left out."""
    order = np.argsort(sizes, kind="stable")
    counts, sizes = [counts[i] for i in order], sizes[order]
    cells = np.array([len(c) for c in counts])  # they grow with the sizes
    folded: dict[int, tuple[int, np.ndarray]] = {}
    label, alone = np.arange(len(sizes)), np.ones(len(sizes), bool)

    def partners(x):
        lo = int(np.searchsorted(100 * sizes, threshold * sizes[x]))
        hi = int(np.searchsorted(threshold * sizes, 100 * sizes[x], "right"))
        wide = int(cells[lo])
        if wide not in folded:
            start = int(np.searchsorted(cells, wide))
            folded[wide] = start, np.stack([c.reshape(wide, -1).sum(1) for c in counts[start:]])
        start, part = folded[wide]
        hit = linked(np.minimum(part[x - start], part[lo - start:hi - start]).sum(1, dtype=np.int64), sizes[x], sizes[lo:hi])
        hit[x - lo] = False
        return lo + np.flatnonzero(hit)

    done = np.zeros(len(sizes), bool)
    if near is None:
        at = int(np.flatnonzero(order == hub)[0])
        met = partners(at)
        done[met], done[at] = True, True
        label[met], alone[met], alone[at] = at, False, alone[at] and not len(met)
    else:
        done = near[order]
    for x in np.flatnonzero(~done):
        met = np.append(partners(x), x)
        if len(met) > 1:
            alone[met] = False
            joined = np.unique(label[met])
            label[np.isin(label, joined)] = joined[0]
    out = np.empty(len(sizes), np.int64)
    out[order] = np.where(alone, -1, order[label])
    return out


def in_units(batches, unit_columns: int, solve, columns):
    """Calls ``solve(unit, rows)`` for each run of rows that agree in the first ``unit_columns`` columns, and passes on
    the tuples it returns, as record batches of ``columns`` (name, Arrow type)."""
    def give(out):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, (_, kind) in enumerate(columns)],
                                          [name for name, _ in columns])

    held, now = [], None
    for b in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:unit_columns] != now:
                if held:
                    out += solve(now, held)
                held, now = [], row[:unit_columns]
            held.append(row[unit_columns:])
        yield give(out)
    if held:
        yield give(solve(now, held))


def vectors(docs: DataFrame, surveyed: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, grams): all shingles of the wanted classes, from one document of each."""
    one = (surveyed.where(F.col("key").isNotNull()).join(if_small(wanted, 48), "key", "left_semi")
           .groupBy("key").agg(F.min("doc_id").alias("id")))
    ids = materialize(one, "candidates")

    def scan(batches):
        for b in batches:
            out = []
            for key, t in zip(b.column(0).to_pylist(), _texts(b.column(1))):
                g = shingles(t, width)
                if len(g) and set_key(g) == key:  # an id may stand for several texts
                    out.append((key, g.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["key", "grams"])

    rows = docs.select("doc_id", "text")
    if (few := if_small(ids, 64)) is ids:  # texts that are not asked for go before the shuffle
        rows = rows.where(in_table(docs, ids.select(F.xxhash64("id").alias("h")))(F.xxhash64("doc_id")))
    rows = rows.join(few, F.col("doc_id").eqNullSafe(F.col("id"))).select("key", "text")
    found = materialize(rows.mapInArrow(scan, "key binary, grams binary"), "vectors")
    # a document whose row repeats comes more than once
    return found if found.count() == ids.count() else materialize(found.dropDuplicates(["key"]), "vectors")


def edges(docs: DataFrame, surveyed: DataFrame, pairs: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH,
          block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(u, v): stars of the classes that link within the groups."""
    classes = (surveyed.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("n").alias("n"))
               .withColumn("k", class_number(F.col("key"))))
    # a number may stand for several classes; then all of them come along
    members = materialize(classes.join(if_small(pairs, 48), "k").select("hub", "key", (F.col("k") == F.col("hub")).alias("is_hub"), "n"), "members")
    # rows that link are of one band of sizes or of neighbouring ones; a row without such a partner leaves the group
    members = members.withColumn("band", F.floor(F.log("n") / (math.log(100 / threshold) * (1 + 1e-6)) if threshold < 100 else F.col("n")))
    counts = members.groupBy("hub", "band").count()
    partners = materialize(counts.select("hub", "count", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"))
                           .groupBy("hub", "band").agg(F.sum("count").alias("partners")), "partners")
    members = (members.join(if_small(partners, 64), ["hub", "band"]).where(F.col("is_hub") | (F.col("partners") > 1))
               .drop("band", "partners"))
    sized = members.groupBy("hub").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"))
    # a pair whose sizes rule a link out needs no product
    fits = (F.col("size") > 2) | (F.col("size") == 2) & (100 * F.col("least") >= threshold * F.col("most"))
    sized = materialize(sized.where(fits).select(
        "hub", F.greatest(F.ceil(F.col("size") / block_rows), F.ceil(F.col("total") / block_shingles)).cast("int").alias("blocks")),
        "group-sizes")
    members = materialize(members.join(if_small(sized, 48), "hub"), "members")
    wanted = materialize(members.select("key").distinct(), "wanted")
    sketches = materialize(surveyed.where(F.col("sketch").isNotNull()).select("key", "sketch").join(if_small(wanted, 48), "key", "left_semi")
                           .groupBy("key").agg(F.first("sketch").alias("sketch")), "sketches")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = [("hub", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("key", pa.binary()), ("is_hub", pa.bool_())]

    def linked(over, a, b):
        return 100 * over >= threshold * (a + b - over)

    def dealt(rows):
        return rows.repartition(parts, "hub", "i", "j").sortWithinPartitions("hub", "i", "j")

    def pivot(rows):  # the hub, or if it is not among them any row
        return min(range(len(rows)), key=lambda x: (not rows[x][1], rows[x][0]))

    def sketched(units, solve, name):
        """(hub, i, j, key, is_hub): the rows of units (hub, i, j, key, is_hub, n, near) that ``solve`` returns."""
        rows = sketches.join(if_small(units, 80), "key").select("hub", "i", "j", "key", "is_hub", "n", "near", "sketch")
        return materialize(dealt(rows).mapInArrow(lambda b: in_units(b, 3, solve, kinds), "hub long, i int, j int, key binary, is_hub boolean")
                           .distinct(), name)

    def exact(units, solve):
        """(u, v) from what ``solve`` returns for each unit's rows (key, is_hub, grams)."""
        wanted = materialize(units.select("key").distinct(), "wanted")
        rows = vectors(docs, surveyed, wanted, width).join(if_small(units, 80), "key").select("hub", "i", "j", "key", "is_hub", "grams")
        return dealt(rows).mapInArrow(lambda b: in_units(b, 3, solve, [("hub", pa.int64()), ("u", pa.binary()), ("v", pa.binary())]),
                                      "hub long, u binary, v binary")

    def drawn(rows):
        return [counts_of(r[4], r[2]) for r in rows], np.array([r[2] for r in rows], np.int64)

    def by_hub(unit, rows):  # the hub and the rows that may link to it
        counts, sizes = drawn(rows)
        hub = pivot(rows)
        label = possible(counts, sizes, hub, linked, threshold, np.arange(len(rows)) != hub)
        return [(*unit, rows[x][0], rows[x][1]) for x in np.flatnonzero(label >= 0)]

    def by_all(unit, rows):  # each component is a unit, named by its rows: several groups may hold the same
        near = None if rows[0][3] is None else np.array([r[3] for r in rows])
        label, out = possible(*drawn(rows), pivot(rows), linked, threshold, near), []
        for one in np.unique(label[label >= 0]):
            keys = sorted(rows[x][0] for x in np.flatnonzero(label == one))
            name = xxhash.xxh3_64_intdigest(b"".join(keys)) - (1 << 63)
            out += [(name, 0, 0, k, False) for k in keys]
        return out

    def hub_links(unit, rows):
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        hub = pivot(rows)
        if not rows[hub][1]:
            return []
        sizes = np.array([len(v) for v in sets], np.int64)
        over = overlaps(sets, np.array([hub]), 0, len(sets))[0]
        return [(unit[0], rows[x][0], rows[hub][0]) for x in np.flatnonzero(linked(over, sizes[hub], sizes)) if x != hub]

    def unit_links(unit, rows):
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        label = star(sets, np.array([len(v) for v in sets], np.int64), pivot(rows), linked, threshold)
        return [(unit[0], rows[x][0], rows[y][0]) for x, y in enumerate(label) if x != y]

    members, to_hub = members.withColumn("near", F.lit(None).cast("boolean")), None
    several = members.where(F.col("blocks") > 1)
    if not several.isEmpty():
        # rows of a group of several blocks that link to the hub are found first, each meeting the hub alone
        asked = several.where("not is_hub").withColumn("i", own).unionByName(several.where("is_hub").withColumn("i", every))
        asked = materialize(asked.select("hub", "i", F.lit(0).alias("j"), "key", "is_hub", "n", "near"), "hub-units")
        to_hub = materialize(exact(sketched(asked, by_hub, "hub-rows"), hub_links), "hub-links")
        known = materialize(to_hub.select("hub", F.explode(F.array("u", "v")).alias("key")).distinct().withColumn("found", F.lit(True)), "known")
        members = (members.drop("near").join(if_small(known, 48), ["hub", "key"], "left")
                   .withColumn("near", F.when(F.col("blocks") > 1, F.coalesce("found", F.lit(False)))))
        # where all rows link to the hub, no pair is left
        left = materialize(members.groupBy("hub").agg(F.min(F.coalesce("near", F.lit(False))).alias("all")).where("not all").select("hub"), "left")
        members = materialize(members.join(if_small(left, 16), "hub", "left_semi"), "members")
    units = (members.where("not is_hub").withColumn("own", own).withColumn("other", every)
             .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")))
    # the hub is part of every unit of its group
    everywhere = (members.where("is_hub").withColumn("i", every)
                  .withColumn("j", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1))))
    columns = ["hub", "i", "j", "key", "is_hub", "n", "near"]
    units = materialize(units.select(*columns).unionByName(everywhere.select(*columns)), "units")
    found = exact(sketched(units, by_all, "unit-rows"), unit_links).select("u", "v")
    return found if to_hub is None else found.unionByName(to_hub.select("u", "v"))


def roots(docs: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH, **how) -> DataFrame:
    """doc_id, sha, n, root (null without shingles) of every document; rows with equal root are one component."""
    surveyed = survey(docs, threshold, width)
    level = docs.sparkSession.sparkContext.broadcast(levels(surveyed))  # 2**CELL_BITS bytes
    pairs = groups(beginnings(docs, level, threshold, width))
    found = components(edges(docs, surveyed, pairs, threshold, width, **how), "links")
    rows = surveyed.select("doc_id", "sha", "n", "key")
    # rows without a key stay out of the joins: they would all meet in one task
    return (rows.where(F.col("key").isNotNull()).join(found.withColumnRenamed("u", "key"), "key", "left")
            .select("doc_id", "sha", "n", F.coalesce("root", "key").alias("root"))
            .unionByName(rows.where(F.col("key").isNull()).select("doc_id", "sha", "n", F.col("key").alias("root"))))


def link(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows = materialize(roots(docs, **how), "rooted")
    some = rows.where(F.col("root").isNotNull())
    least = materialize(some.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    alone = rows.where(F.col("root").isNull()).withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    return some.join(least, "root").select(*columns).unionByName(alone.select(*columns))


def one_per_component(docs: DataFrame, **how) -> DataFrame:
    """The documents, with one row of each component: the one with the smallest id (a null id comes last)."""
    def key(doc_id, sha):
        return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.hex(sha))

    rows = materialize(roots(docs, **how).where(F.col("root").isNotNull()).select("doc_id", "sha", "root"), "rooted")
    stay = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sha")).alias("s"))
    each = rows.groupBy("root", "doc_id", "sha").count()
    stays = F.col("doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("sha") == F.col("s.sha"))
    # rows that go, and rows that repeat; all others stay where they are
    special = materialize(each.join(stay, "root").select(key(F.col("doc_id"), F.col("sha")).alias("k"), stays.alias("stays"), "count")
                          .where("not stays or count > 1"), "special")
    found = in_table(docs, special.select(F.xxhash64("k").alias("h")))
    text = F.coalesce("text", F.lit(""))
    all_rows = docs.select(packed(docs), text.rlike(WORD).alias("has_words"),
                           key(F.col("doc_id"), F.unhex(F.sha2(text, 256))).alias("k")).withColumn("asked", found(F.xxhash64("k")))
    kept = (all_rows.where("asked and has_words").join(special.where("not stays").select("k"), "k", "left_anti")
            .dropDuplicates(["k"]).select("d"))
    return unpacked(all_rows.where("not (asked and has_words)").select("d").unionByName(kept), docs)


def op5_ngram_jaccard(spark, sf_dir):
    return link(table(spark, sf_dir, "documents"))

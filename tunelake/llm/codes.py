"""Vector code compression: product codes with exact nearest entries.

Each component becomes the integer floor(256 x); a vector is cut into PARTS
equal consecutive parts (a length that is no multiple of PARTS counts as
filled up with zeros, which changes no distance). Each part position has a
codebook of at most 64 entries, so that a set of entries is one uint64.

Nearest entries are found by slice and intersect. Per dimension the entries'
coordinates are sorted, and place i of the sorted list carries the mask of the
entries before it. The distance to a known entry is the initial radius: it
selects one range of each sorted list, two prefix masks give the range's set,
and the AND of all dimensions holds every entry that can be as near as the
known one. Only these candidates get exact distances; ties go to the lower
index.

The table is quantised and written once. Each round reads it without a
shuffle: a task sums its parts per entry, and only those sums (64 times the
vector's length a task) are grouped. The codebooks, whose size depends on the
vector's length alone, are the only data that reach the driver.

Results: vectors that are null or hold null or non-finite components are
dropped; rows without an id take part and count as the largest ids; rows with
equal ids are ordered by vector; fewer than 64 rows give fewer entries. Errors
of equal labels are summed, null labels together; an empty table gives an
empty result; other columns are ignored. A component beyond +-2**26 / sqrt(length)
after scaling ends the job with an error, since its squared distances might not
be exact."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .base import null_key, table

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Rows that are searched at once, and (row, entry) pairs measured at once.
STEP, PAIRS = 16_384, 1 << 20


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and the integer vector v of the rows that take part."""
    def run(batches):
        for b in batches:
            lists = b.column("embedding")
            sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(), 0)
            x = lists.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy()
            start = np.concatenate([[0], np.cumsum(sizes)])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            keep = (bad[start[1:]] == bad[start[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False)
            if np.abs(scale * x[np.repeat(keep, sizes)]).max(initial=0) * max(1, sizes.max(initial=0)) ** 0.5 > 1 << 26:
                raise ValueError("a component is too large for exact squared distances")
            v = np.floor(scale * np.where(np.repeat(keep, sizes), x, 0)).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(v))
            out = pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), lists], ["vec_id", "label", "v"])
            yield out.filter(pa.array(keep))

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, v array<long>")


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows, missing components 0."""
    sizes = lists.value_lengths().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


class Slices:
    """The entries of one part position, ready to be searched."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, d = entries.shape
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.order, 0)
        self.masks = np.zeros((n + 1, d), np.uint64)  # [i]: the entries before place i
        for i in range(n):
            self.masks[i + 1] = self.masks[i] | np.left_shift(np.uint64(1), self.order[i].astype(np.uint64))

    def radius2(self, x: np.ndarray) -> np.ndarray:
        """The squared distance of a known entry: of those next to x in one dimension, the nearest."""
        least = None
        for j in range(x.shape[1]):
            at = np.minimum(np.searchsorted(self.sorted[:, j], x[:, j]), len(self.entries) - 1)
            d2 = ((x - self.entries[self.order[at, j]]) ** 2).sum(1)
            least = d2 if least is None else np.minimum(least, d2)
        return least

    def candidates(self, x: np.ndarray, radius2: np.ndarray) -> np.ndarray:
        """One mask a row: the entries within the radius in every dimension."""
        r = np.ceil(np.sqrt(radius2)).astype(np.int64)
        found = np.full(len(x), self.masks[-1, 0])
        for j in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, j], x[:, j] - r, "left")
            high = np.searchsorted(self.sorted[:, j], x[:, j] + r, "right")
            found &= self.masks[high, j] ^ self.masks[low, j]
        return found

    def nearest(self, x: np.ndarray, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry and its squared distance for every row."""
        if not x.shape[1]:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        best, d2 = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for at in range(0, len(x), STEP):
            part = x[at:at + STEP]
            found = self.candidates(part, self.radius2(part))
            bits = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
            row, entry = np.nonzero(bits)
            if seen is not None:
                seen.append((len(row), len(part) * len(self.entries)))
            far = ((part[row] - self.entries[entry]) ** 2).sum(1)
            first = np.searchsorted(row, np.arange(len(part)))
            least = np.minimum.reduceat(far, first)
            hit = far == least[row]  # pairs come in the order of (row, entry): the first hit of a row is its lowest index
            rows, place = np.unique(row[hit], return_index=True)
            best[at + rows], d2[at + rows] = entry[hit][place], least
        return best, d2


def searchers(books: np.ndarray) -> list[Slices]:
    return [Slices(b) for b in books]


def split(m: np.ndarray, parts: int) -> np.ndarray:
    """rows x parts x dimensions of a part."""
    return m.reshape(len(m), parts, m.shape[1] // parts)


def sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, pos, total, n: the sums of the parts by nearest entry, one row a task."""
    parts, entries, d = books.shape

    def run(batches):
        total, n, find = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64), searchers(books)
        for b in batches:
            x = split(matrix(b.column("v"), parts * d), parts)
            for p in range(parts):
                code, _ = find[p].nearest(x[:, p])
                np.add.at(total[p], code, x[:, p])
                n[p] += np.bincount(code, minlength=entries)
        p, e, i = (a.ravel() for a in np.indices(books.shape))
        used = n[p, e] > 0
        yield pa.RecordBatch.from_arrays([pa.array(a[used]) for a in (p, e, i, total.ravel(), n[p, e])], ["part", "entry", "pos", "total", "n"])

    each = rows.select("v").mapInArrow(run, "part long, entry long, pos long, total long, n long")
    return each.groupBy("part", "entry", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """parts x entries x dimensions: the codebooks, of a size that only the vector's length decides."""
    if not 1 <= entries <= 64:
        raise ValueError("a codebook has 1 to 64 entries")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    d = -(-width // parts)
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    m = np.zeros((len(start), parts * d), np.int64)
    for i, r in enumerate(start):
        m[i, :len(r["v"])] = r["v"]
    books = split(m, parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if books.size else 0):
        for r in sums(rows, books).collect():  # at most one row a component of the codebooks
            books[r["part"], r["entry"], r["pos"]] = r["total"] // r["n"]
    return books


def book_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of quantised rows."""
    parts, _, d = books.shape

    def run(batches):
        find = searchers(books)
        for b in batches:
            x = split(matrix(b.column("v"), parts * d), parts)
            found = [find[p].nearest(x[:, p]) for p in range(parts)]
            code = np.stack([c for c, _ in found], 1).astype(np.uint8)
            error = sum(e for _, e in found)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes().hex() for r in code], pa.string()),
                                              pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def decode_column(books: np.ndarray):
    """Column function code -> array<long>, the entries that a code names."""
    @F.pandas_udf("array<long>")
    def decode(code):
        at = np.arange(len(books))
        return code.map(lambda c: None if c is None else books[at, np.frombuffer(bytes.fromhex(c), np.uint8)].ravel().tolist())

    return decode


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of every row that takes part, written once; the codebooks)."""
    rows = materialize(quantised(vectors), "quantised")
    books = train(rows, parts, entries, rounds)
    if not books.size:  # no row, or vectors without components
        empty = F.lit("00" * parts), F.lit(0).cast("long")
        return rows.select("vec_id", "label", empty[0].alias("code"), empty[1].alias("error")), books
    return materialize(encode(rows, books), "codes"), books


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    coded, books = compress(vectors)
    # summed before the shuffle and written: Spark broadcasts the sums only if their file is below the session's threshold
    per = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"))
                      .select(null_key(F.col("label")).alias("k"), "label_error"), "label-errors")
    return (coded.withColumn("k", null_key(F.col("label"))).join(per, "k")
            .select("vec_id", "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256")))


def op11_vector_codes(spark, sf_dir):
    return report(table(spark, sf_dir, "embeddings"))


def _rounds_sql() -> str:
    out = """cb0 AS (
  SELECT part, row_number() OVER (PARTITION BY part, pos ORDER BY vec_id NULLS LAST, rid) - 1 AS entry, pos, val
  FROM x WHERE rid IN (SELECT rid FROM kept ORDER BY vec_id NULLS LAST, v LIMIT 64))"""
    for k in range(ROUNDS + 1):
        out += f""",
d{k} AS (
  SELECT x.rid, x.part, c.entry, sum((x.val - c.val) * (x.val - c.val))::BIGINT AS d2
  FROM x JOIN cb{k} c ON x.part = c.part AND x.pos = c.pos GROUP BY ALL),
a{k} AS (SELECT rid, part, min(d2) AS d2, min(d2 * 64 + entry) % 64 AS entry FROM d{k} GROUP BY ALL)"""
        if k < ROUNDS:
            out += f""",
m{k} AS (SELECT x.part, a.entry, x.pos, (floor(sum(x.val)::DOUBLE / count(*)))::BIGINT AS val
  FROM x JOIN a{k} a ON x.rid = a.rid AND x.part = a.part GROUP BY ALL),
cb{k + 1} AS (SELECT c.part, c.entry, c.pos, coalesce(m.val, c.val) AS val
  FROM cb{k} c LEFT JOIN m{k} m ON c.part = m.part AND c.entry = m.entry AND c.pos = m.pos)"""
    return out


OP11_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
flat AS (SELECT rid, vec_id, unnest(v) AS val, generate_subscripts(v, 1) - 1 AS place, len(v) // {PARTS} AS d FROM kept),
x AS (SELECT rid, vec_id, place // d AS part, place % d AS pos, val FROM flat),
{_rounds_sql()},
codes AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d2)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(val::VARCHAR, ',' ORDER BY part, entry, pos)) FROM cb{ROUNDS}) AS codebooks_sha256
FROM codes JOIN kept USING (rid)
"""

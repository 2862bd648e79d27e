"""Source divergence audit with late string materialization.

How far apart are the sources of a language, and by which terms? Counting
needs no strings: each task counts its terms per (language, source) and gives,
per language and 64-bit digest, the documents and the occurrences in each
source, so only numbers are shuffled. Beside them it writes each distinct
string once a task, with its digest. Those strings stay where they were written
until

1. the digests of kept terms are known (a term with few documents is not kept,
   nor is its digest unless it shares it). Where the minimum string of a kept
   digest is not its maximum, terms collide; the digest is split: the texts are
   counted again, and terms of such digests carry their string as a second key;
2. the terms that reach the output are known (at most ten a group and their
   ties): only these get their text back, by a join on the digest.

Pairs of sources are not formed per term: a task holds a dense block of terms
by sources and adds up the divergences of all pairs in it; a language with more
than SIDE sources is cut into blocks of SIDE sources on one side. The leading
terms of a group are found in SALTS parts and then among those, so that a
source that holds most of the data is spread over tasks.

All values are whole numbers: probabilities are billionths, rounded down;
decimals hold products that could pass 64 bits.

Results: null text, lang and source count as ''; a text without a term adds
nothing, but its group is reported; repeated rows count each; a language
without kept terms has value 0 for every pair; the only source of a language
has no pair; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import with_row_number
from ..session import materialize
from .base import if_small, table

MIN_DOCS = 10
TOP = 10
SIDE = 256
SALTS = 32
#: Distinct (lang, source, term) triples, and bytes of text, that a task counts before it gives them away.
HELD, CHUNK = 500_000, 4 << 20
#: Colliding digests that are split by string; beyond, all terms carry their string.
MOST_SPLIT = 100_000
#: Cells of terms by sources that are compared at once.
CELLS = 1 << 18

#: A-Z to a-z; letters and bytes of other characters stay, the rest separates terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

ONE = 1_000_000_000


def digest(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) - (1 << 63)


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


#: One row per (lang, digest) with its occurrences in each source; lang_id null: one row per string met.
COUNTS = "lang_id long, digest long, term string, n long, docs long, sources array<long>, counts array<long>, text string"


class Held:
    """What a task has counted: occurrences by (lang, source), documents by lang."""

    def __init__(self):
        self.n: dict[int, dict[int, Counter]] = {}
        self.docs: dict[int, Counter] = {}
        self.size = 0

    def add(self, lang: int, source: int, texts: list[bytes]) -> None:
        found = [terms(t) for t in texts]
        n = self.n.setdefault(lang, {}).setdefault(source, Counter())
        self.size -= len(n)
        n.update(chain.from_iterable(found))
        self.size += len(n)
        self.docs.setdefault(lang, Counter()).update(chain.from_iterable(map(set, found)))

    def batches(self, ident, split):
        """COUNTS of one lang after the other, then the strings. Terms of one digest may have a row each."""
        of = {t: ident(t) for t in set().union(*self.docs.values())}
        for lang, docs in self.docs.items():
            place = {t: k for k, t in enumerate(docs)}
            at = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in self.n[lang].values()])
            n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in self.n[lang].values()])
            source = np.repeat(np.fromiter(self.n[lang], np.int64), [len(c) for c in self.n[lang].values()])
            order = np.argsort(at, kind="stable")
            starts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(docs)))]).astype(np.int32))
            each = [pa.ListArray.from_arrays(starts, pa.array(x[order])) for x in (source, n)]
            digests = np.fromiter(map(of.__getitem__, docs), np.int64, len(docs))
            term = [t if split is None or of[t] in split else None for t in docs] if split is None or split else [None] * len(docs)
            yield self._batch(np.full(len(docs), lang), digests, _strings(term), np.bincount(at, n, len(docs)).astype(np.int64),
                              np.fromiter(docs.values(), np.int64, len(docs)), *each, pa.nulls(len(docs), pa.string()))
        none = pa.nulls(len(of), pa.int64())
        lists = pa.nulls(len(of), pa.list_(pa.int64()))
        yield self._batch(none, np.fromiter(of.values(), np.int64, len(of)), pa.nulls(len(of), pa.string()), none, none, lists, lists, _strings(list(of)))

    @staticmethod
    def _batch(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns],
                                          [f.split()[0] for f in COUNTS.split(", ")])


def _strings(values) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def partial_counts(rows: DataFrame, ident=digest, split=frozenset()) -> DataFrame:
    """COUNTS of every task; ``split``: the digests whose terms carry their string (None: all)."""
    def run(batches):
        held = Held()
        for b in batches:
            waiting: dict = {}
            for text, lang, source in zip(b.column("text"), b.column("lang_id").to_pylist(), b.column("source_id").to_pylist()):
                texts, size = waiting.setdefault((lang, source), ([], [0]))
                texts.append(memoryview(text.as_buffer()).tobytes())
                size[0] += len(texts[-1])
                if size[0] >= CHUNK:
                    held.add(lang, source, texts)
                    del waiting[lang, source]
            for (lang, source), (texts, _) in waiting.items():
                held.add(lang, source, texts)
            if held.size >= HELD:
                yield from held.batches(ident, split)
                held = Held()
        if held.size:
            yield from held.batches(ident, split)

    return rows.select("lang_id", "source_id", "text").mapInArrow(run, COUNTS)


def group_ids(seed: int):
    """Fixed-width ids of lang and source; equal for equal strings."""
    return F.xxhash64(F.lit(seed), "lang").alias("lang_id"), F.xxhash64(F.lit(seed), "source").alias("source_id")


def as_read(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def numbered_groups(rows: DataFrame) -> tuple[DataFrame, int]:
    """lang, source, lang_id, source_id of every group, and the seed under which no two strings share an id."""
    groups = materialize(rows.select("lang", "source").distinct(), "groups")
    seed = 0
    while True:
        ids = groups.select("lang", "source", *group_ids(seed))
        clash = [ids.groupBy(f"{c}_id").agg(F.min(c).alias("low"), F.max(c).alias("high")).where("low <> high") for c in ("lang", "source")]
        if all(c.isEmpty() for c in clash):
            return ids, seed
        seed += 1


def share(n, total, vocabulary):
    """1 + floor(10**9 (n + 2) / (total + 2 V)), exact."""
    whole, parts = n + F.lit(2), total + F.lit(2) * vocabulary
    wide = F.call_function("div", F.lit(ONE).cast("decimal(10,0)") * whole.cast("decimal(20,0)"), parts.cast("decimal(20,0)"))
    # the product fits 64 bits for all but enormous counts
    return F.lit(1) + F.when(whole < F.lit(9 * ONE), F.call_function("div", F.lit(ONE).cast("long") * whole, parts)).otherwise(wide)


def gap(p, q):
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_terms(ids: DataFrame, ident=digest, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(lang_id, digest, term, source_id, n, lang_n, leads) of the kept terms, ``leads`` on one row a term, and
    (digest, text) of the strings met. term is null but for split digests."""
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split: frozenset | None = frozenset()
    while True:
        counted = materialize(partial_counts(ids, ident, split), "counts")
        of_term = Window.partitionBy("lang_id", "digest", "term")
        first = F.row_number().over(of_term.orderBy("n")) == 1
        # one shuffle of numbers; only kept terms are taken apart by source
        terms_ = (counted.where(F.col("lang_id").isNotNull()).drop("text").repartition(n, "lang_id", "digest")
                  .withColumn("lang_n", F.sum("n").over(of_term)).withColumn("d", F.sum("docs").over(of_term)).withColumn("first", first)
                  .where(F.col("d") >= min_docs))
        each = terms_.select("lang_id", "digest", "term", "lang_n", "first", F.posexplode(F.arrays_zip("sources", "counts")).alias("place", "x"))
        sums = (each.groupBy("lang_id", "digest", "term", "lang_n", F.col("x.sources").alias("source_id"))
                .agg(F.sum("x.counts").alias("n"), F.max(F.col("first") & (F.col("place") == 0)).alias("leads")))
        kept = materialize(sums, "kept-terms")
        strings = counted.where(F.col("lang_id").isNull()).select("digest", "text")
        if split is None:
            return kept, strings
        unsplit = kept.where(F.col("leads") & F.col("term").isNull()).select("digest").distinct()
        ends = (strings.join(if_small(unsplit, 8), "digest", "left_semi")
                .groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high")))
        clash = [r[0] for r in ends.where("low <> high").select("digest").limit(MOST_SPLIT + 1).collect()]
        if not clash:
            return kept, strings
        split = None if len(split) + len(clash) > MOST_SPLIT else split | set(clash)


def leading_terms(valued: DataFrame, strings: DataFrame, top: int = TOP) -> DataFrame:
    """lang_id, source_id, item, value, rank of the ``top`` terms of each group."""
    group = ["lang_id", "source_id"]
    by_value = F.col("value").desc()
    salted = valued.withColumn("salt", F.pmod(F.xxhash64("digest", "term"), F.lit(SALTS)))
    # whatever is among the first of a group, ties included, is so in its part
    near = salted.withColumn("r", F.rank().over(Window.partitionBy(*group, "salt").orderBy(by_value))).where(F.col("r") <= top).drop("r")
    near = materialize(near, "leading")
    above = Window.partitionBy(*group).orderBy(by_value).rowsBetween(Window.unboundedPreceding, -1)
    least = (near.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("c"))
             .withColumn("above", F.coalesce(F.sum("c").over(above), F.lit(0))).where(F.col("above") < top)
             .groupBy(*group).agg(F.min("value").alias("least")))
    out = materialize(near.join(least, group).where(F.col("value") >= F.col("least")).drop("least"), "candidates")
    wanted = materialize(out.where(F.col("term").isNull()).select("digest").distinct(), "wanted")
    texts = (strings.join(if_small(wanted, 8), "digest", "left_semi").groupBy("digest").agg(F.min("text").alias("text")))
    named = out.join(texts, "digest", "left").withColumn("item", F.coalesce("term", "text"))
    for part in ([*group, "salt"], group):
        named = named.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(by_value, "item"))).where(F.col("rank") <= top)
    return named.select(*group, "item", "value", "rank")


PAIR = "lang_id long, a long, b long, total long, met long"
UNIT = ["lang_id", "i", "j", "part"]


def _unit(key, found: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums of the divergences of all pairs of block i and block j over one part of the terms that occur in them."""
    lang, i, j, _ = (k.as_py() for k in key)
    no, p0 = sources["no"].to_numpy(), sources["p0"].to_numpy()
    order = np.argsort(no)
    no, p0 = no[order], p0[order]
    column = np.searchsorted(no, found["no"].to_numpy())
    which = found["term"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    terms_, row = np.unique(np.stack([found["digest"].to_numpy(), which.astype(np.int64)]), axis=1, return_inverse=True)
    p = np.tile(p0, (terms_.shape[1], 1))
    p[row.ravel(), column] = found["p"].to_numpy()
    left, right = np.flatnonzero(no // SIDE == i), np.flatnonzero(no // SIDE == j)
    total = np.zeros((len(left), len(right)), np.int64)
    step = max(1, CELLS // max(1, len(right)))
    for at in range(0, len(p), step):
        q = p[at:at + step][:, right]
        for k, a in enumerate(left):
            x = p[at:at + step, a:a + 1]
            total[k] += ((x - q) ** 2 // (x + q)).sum(0)
    a, b = np.repeat(no[left], len(right)), np.tile(no[right], len(left))
    once = a < b
    columns = [np.full(once.sum(), lang), a[once], b[once], total.ravel()[once], np.full(once.sum(), len(p))]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["lang_id", "a", "b", "total", "met"])


def source_pairs(valued: DataFrame, groups: DataFrame, per_unit: int = 8192) -> DataFrame:
    """lang_id, a, b, value for all pairs a < b of the sources (by number) of each language."""
    def dealt(rows):
        """Each row to all units (i, j) that its source's block takes part in."""
        blocks = F.ceil(F.col("width") / F.lit(SIDE)).cast("long")
        rows = rows.withColumn("block", F.floor(F.col("no") / F.lit(SIDE)).cast("long"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    parts = F.greatest(F.lit(1), F.ceil(F.col("v") / F.lit(per_unit))).cast("long")
    found = (dealt(valued.select("lang_id", "digest", "term", "no", "p", "width", "v"))
             .select("lang_id", "i", "j", F.pmod(F.xxhash64("digest", "term"), parts).alias("part"), "digest", "term", "no", "p"))
    own = groups.select(*[F.col(c).alias(c) for c in groups.columns])  # columns of its own: the other side holds these as well
    sources = (dealt(own).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
               .select(*UNIT, "no", "p0"))
    sums = (found.groupBy(*UNIT).cogroup(sources.groupBy(*UNIT)).applyInArrow(_unit, PAIR)
            .groupBy("lang_id", "a", "b").agg(F.sum("total").alias("total"), F.sum("met").alias("met")))
    a = groups.select("lang_id", F.col("no").alias("a"), F.col("p0").alias("pa"), "v")
    b = groups.select("lang_id", F.col("no").alias("b"), F.col("p0").alias("pb"))
    # terms that neither block has: all alike
    return (sums.join(a, ["lang_id", "a"]).join(b, ["lang_id", "b"])
            .select("lang_id", "a", "b", (F.col("total") + F.when(F.col("v") > 0, (F.col("v") - F.col("met")) * gap(F.col("pa"), F.col("pb")))
                                          .otherwise(0)).alias("value")))


def audit(docs: DataFrame, ident=digest, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    rows = as_read(docs)
    groups, seed = numbered_groups(rows)
    kept, strings = kept_terms(rows.select("text", *group_ids(seed)), ident, min_docs)
    keys = ["lang_id", "source_id"]
    totals = kept.groupBy(*keys).agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang_id").agg(F.sum(F.col("leads").cast("long")).alias("v"), F.sum("n").alias("lang_total"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "v", "lang_total")]
    known = groups.join(totals, keys, "left").join(langs, "lang_id", "left").select("lang", "source", *keys, *zero)
    known = with_row_number(known, ["source"], ["lang_id"], out="no", total_col="width")
    p0 = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"))).otherwise(1).cast("long")
    known = materialize(known.withColumn("p0", p0), "group-totals")

    numbers = known.drop("lang", "source")  # eight numbers a group
    valued = (kept.join(if_small(numbers, 64), keys)
              .withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
              .withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("v"))))
    over = valued.where(F.col("p") > F.col("q")).select(*keys, "digest", "term", gap(F.col("p"), F.col("q")).alias("value"))
    names = known.select(*keys, "lang", "source")
    term_part = (leading_terms(over, strings, top).join(names, keys)
                 .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))

    a = known.select("lang_id", F.col("no").alias("a"), "lang", F.col("source").alias("source_a"))
    b = known.select("lang_id", F.col("no").alias("b"), F.col("source").alias("source_b"))
    both = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")),
                             F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair_part = (source_pairs(valued, numbers).join(a, ["lang_id", "a"]).join(b, ["lang_id", "b"])
                 .select("lang", both.alias("s"), "value")
                 .select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
                 .withColumn("rank", F.row_number().over(by_value)))
    return pair_part.unionByName(term_part)


def op13_source_divergence(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d),
f AS (
  SELECT rid, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM w),
kept AS (
  SELECT lang, term, count(*) AS lang_n FROM f GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT f.lang, f.source, f.term, count(*) AS n FROM f JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.total + 2 * l.v))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (l.lang_total + 2 * l.v))::BIGINT AS q
  FROM totals s JOIN langs l ON s.lang = l.lang JOIN kept k ON s.lang = k.lang
  LEFT JOIN counts c ON s.lang = c.lang AND s.source = c.source AND k.term = c.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
tops AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM tops) WHERE rank <= 10
"""

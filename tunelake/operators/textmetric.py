"""Text metrics against references (M1-M4).

The metrics of two texts of a row are computed inside the row, by
Arrow-batched functions over whole texts: BLEU intersects multisets of
n-grams, ROUGE-L takes a bit-parallel longest common subsequence, BERTScore
the best cosines of token vectors. ``bert_score`` is the form for vectors that
come as rows: a per-example match in blocks."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import strip_ws

MAX_N = 4
SMOOTH_EPSILON = 0.1  # fixed value: smoothing "method 1" epsilon


def whitespace_tokens(c):
    """str.split(): whitespace tokens, none for null or blank text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(strip_ws(F.coalesce(c, F.lit(""))), r"\s+"), lambda t: t != "")


def words(text: str | None) -> list[str]:
    """The same tokens in Python: only ASCII white space separates."""
    return re.findall(r"\S+", text or "", re.ASCII)


def bleu(prediction: str | None, reference: str | None) -> float:
    p, r = words(prediction), words(reference)
    logs = 0.0
    for n in range(1, MAX_N + 1):
        had = Counter(zip(*(r[k:] for k in range(n))))
        hits = sum(min(c, had[g]) for g, c in Counter(zip(*(p[k:] for k in range(n)))).items())
        if n == 1 and not hits:
            return 0.0
        logs += math.log((hits or SMOOTH_EPSILON) / max(1, len(p) - n + 1))
    brevity = 1.0 if len(p) > len(r) else math.exp(1 - len(r) / len(p))
    return brevity * math.exp(logs / MAX_N)


def sentence_bleu(df: DataFrame, keys=("row_id", "model"), prediction="prediction",
                  reference="reference", out="bleu") -> DataFrame:
    """Sentence BLEU, one reference, uniform weights up to 4-grams, clipped
    counts, brevity penalty, smoothing method 1; 0 when no unigram matches.

    A row's n-grams meet as multisets inside the row (an Arrow-batched
    function), so there is no explode and no shuffle; ``keys`` are kept for
    callers that name them and play no part."""
    from ..session import ship_package

    ship_package(df.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def score(pred: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series([bleu(p, r) for p, r in zip(pred, ref)], dtype="float64")

    return df.withColumn(out, score(F.col(prediction), F.col(reference)))


# -- ROUGE-L ------------------------------------------------------------------

def rouge_tokens(text: str | None, use_stemmer: bool) -> list[str]:
    from ..functions.porter import stem

    toks = re.findall(r"[a-z0-9]+", (text or "").lower())
    if use_stemmer:
        toks = [stem(t) if len(t) > 3 else t for t in toks]
    return toks


def lcs_length(a: list[str], b: list[str]) -> int:
    """Bit-parallel LCS (Allison-Dix / Hyyro): O(len(a) * len(b) / word)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for j, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for tok in a:
        m = masks.get(tok)
        if m is None:
            continue
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


def rouge_l_f(pred: str | None, ref: str | None, use_stemmer: bool = True) -> float:
    p, r = rouge_tokens(pred, use_stemmer), rouge_tokens(ref, use_stemmer)
    lcs = lcs_length(r, p)
    if lcs == 0:
        return 0.0
    prec, rec = lcs / len(p), lcs / len(r)
    return 2 * prec * rec / (prec + rec)


def _rouge_udf(use_stemmer: bool):
    @F.pandas_udf(T.DoubleType())
    def rouge_l_udf(pred: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series([rouge_l_f(p, r, use_stemmer) for p, r in zip(pred, ref)], dtype="float64")

    return rouge_l_udf


def rouge_l(df: DataFrame, prediction="prediction", reference="reference", out="rouge_l",
            use_stemmer: bool = True) -> DataFrame:
    from ..session import ship_package

    ship_package(df.sparkSession)
    return df.withColumn(out, _rouge_udf(use_stemmer)(F.col(prediction), F.col(reference)))


# -- BERTScore (greedy matching over given token embeddings) -------------------

#: Vectors of one side of an example that travel and are compared together.
BERT_CHUNK = 512


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero vector, or one with a missing component, matches nothing."""
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    with np.errstate(divide="ignore", invalid="ignore"):
        unit = m / norm
    return np.where(np.isfinite(unit).all(1, keepdims=True), unit, 0.0)


def _best_in_blocks(batches):
    """The best cosine of every row of either matrix of a pair of blocks."""
    for b in batches:
        rows = []
        for n, dim, ma, mb in zip(b.column("n").to_pylist(), b.column("dim").to_pylist(), b.column("ma"), b.column("mb")):
            x, y = (_unit(v.values.to_numpy(zero_copy_only=False).reshape(k, dim)) for v, k in zip((ma, mb), (n["a"], n["b"])))
            product = x @ y.T
            rows.append((product.max(1).tolist(), product.max(0).tolist()))
        best = [pa.array([r[k] for r in rows], pa.list_(pa.float64())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("example", "ca", "cb")), *best], ["example", "ca", "cb", "best_a", "best_b"])


def bert_score(tokens: DataFrame, example="example_id", side="side", emb="embedding",
               pred_side="pred", ref_side="ref", token="vec_id", chunk: int = BERT_CHUNK) -> DataFrame:
    """(example, P, R, F1): P = mean over prediction tokens of the best cosine
    to any reference token, R likewise the other way, F1 harmonic mean.

    Either side of an example is packed into matrices of at most ``chunk``
    vectors (row numbers per example and side), so no array grows with the
    example; pairs of matrices meet in an equi-join on (example, chunk), which
    spreads a hot example over many tasks, and one product serves both
    directions. The best match is a max over the chunks."""
    from ..functions.order import with_row_number
    from ..session import ship_package

    ship_package(tokens.sparkSession)
    t = tokens.select(F.col(example).alias("example"), F.col(side).alias("side"), F.col(token).alias("token"),
                      F.col(emb).cast("array<double>").alias("e"))
    t = with_row_number(t, ["token"], ["example", "side"], out="_k").withColumn("_c", F.floor(F.col("_k") / chunk).cast("bigint"))
    packs = t.groupBy("example", "side", "_c").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_k", "e"))), lambda s: s["e"])).alias("m"),
        F.count(F.lit(1)).alias("n"), F.max(F.size("e")).alias("dim"))
    a, b = (packs.where(F.col("side") == s) for s in (pred_side, ref_side))
    n_b = b.groupBy("example").agg((F.max("_c") + 1).alias("_nb"))
    a = a.join(n_b, "example").select("example", F.col("_c").alias("ca"), F.col("m").alias("ma"), F.col("n").alias("na"), "dim",
                                      F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nb") - 1)).alias("cb"))
    b = b.select("example", F.col("_c").alias("cb"), F.col("m").alias("mb"), F.col("n").alias("nb"))
    pairs = a.join(b, ["example", "cb"]).select("example", "ca", "cb", F.struct(F.col("na").alias("a"), F.col("nb").alias("b")).alias("n"), "dim", "ma", "mb")
    schema = pairs.select("example", "ca", "cb").schema
    for name in ("best_a", "best_b"):
        schema = schema.add(name, T.ArrayType(T.DoubleType()))
    best = pairs.mapInArrow(_best_in_blocks, schema).select("example", F.explode(F.array(
        F.struct(F.lit("p").alias("s"), F.col("ca").alias("c"), F.col("best_a").alias("best")),
        F.struct(F.lit("r").alias("s"), F.col("cb").alias("c"), F.col("best_b").alias("best")))).alias("x"))
    per_token = (best.select("example", "x.s", "x.c", F.posexplode("x.best").alias("pos", "b"))
                 .groupBy("example", "s", "c", "pos").agg(F.max("b").alias("b")))
    both = per_token.groupBy("example").agg(F.avg(F.when(F.col("s") == "p", F.col("b"))).alias("bert_p"),
                                            F.avg(F.when(F.col("s") == "r", F.col("b"))).alias("bert_r"))
    # an example without tokens on one side scores 0
    both = tokens.select(F.col(example).alias("example")).distinct().join(both, "example", "left").fillna(0.0, ["bert_p", "bert_r"])
    return both.select(F.col("example").alias(example), "bert_p", "bert_r", F.coalesce(F.try_divide(
        2 * F.col("bert_p") * F.col("bert_r"), F.col("bert_p") + F.col("bert_r")), F.lit(0.0)).alias("bert_f1"))


def token_match(p: np.ndarray, r: np.ndarray, step: int = 1024) -> tuple[float, float, float]:
    """BERTScore of two matrices of unit rows, in blocks."""
    if not len(p) or not len(r):
        return 0.0, 0.0, 0.0
    best_p, best_r = np.full(len(p), -np.inf), np.full(len(r), -np.inf)
    for i in range(0, len(p), step):
        for j in range(0, len(r), step):
            product = p[i:i + step] @ r[j:j + step].T
            best_p[i:i + step] = np.maximum(best_p[i:i + step], product.max(1))
            best_r[j:j + step] = np.maximum(best_r[j:j + step], product.max(0))
    a, b = best_p.mean(), best_r.mean()
    return a, b, 2 * a * b / (a + b) if a + b else 0.0


#: Characters of texts that are taken apart at once.
SLICE_CHARS = 1 << 19


def _row_slices(*texts: pd.Series):
    """(from, to) of runs of rows of about SLICE_CHARS characters, at least one row each."""
    ends = np.cumsum(sum(t.str.len().fillna(0).to_numpy(np.int64) for t in texts))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_CHARS, "right")))
        yield at, to
        at = to


def bert_score_texts(df: DataFrame, embed, prediction="prediction", reference="reference") -> DataFrame:
    """``df`` plus ``bert_p``, ``bert_r``, ``bert_f1`` of two text columns.
    ``embed``: a function from a list of tokens to one vector each (a matrix);
    a run of rows of a batch calls it once, for its distinct tokens, so that
    tokens and vectors held at once don't grow with the batch. The texts of a
    row meet inside the row, so nothing is shuffled; 0 where either has no token."""
    from ..session import ship_package

    ship_package(df.sparkSession)

    @F.pandas_udf("bert_p double, bert_r double, bert_f1 double")
    def score(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
        got = np.empty((len(pred), 3))
        for i, j in _row_slices(pred, ref):
            sides = [[words(t) for t in s.iloc[i:j]] for s in (pred, ref)]
            number = {t: k for k, t in enumerate(dict.fromkeys(t for side in sides for row in side for t in row))}
            vectors = _unit(np.asarray(embed(list(number)), np.float64)) if number else np.empty((0, 1))
            for k, rows in enumerate(zip(*sides)):
                got[i + k] = token_match(*(vectors[np.array([number[t] for t in row], np.int64)] for row in rows))
        return pd.DataFrame(got, columns=names)

    names = ["bert_p", "bert_r", "bert_f1"]
    scored = df.withColumn("_bert", score(F.col(prediction), F.col(reference)))
    return scored.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], *[F.col("_bert")[c].alias(c) for c in names])


def model_report(scored: DataFrame, model="model", metrics=("bleu", "rouge_l", "bert_f1")) -> DataFrame:
    """Mean of each metric per model (long input: one plan serves all models)."""
    return scored.groupBy(model).agg(*[F.avg(m).alias(m) for m in metrics],
                                     F.count(F.lit(1)).alias("n"))

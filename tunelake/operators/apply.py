"""Batch model application (U3).

A model enters as a user-supplied *factory* returning a batch function
``fn(pandas.DataFrame) -> one value per row`` (text, a number, an array). The
factory runs once per Python worker (cached by the model's name and version),
the batch function once per Arrow batch inside ``mapInPandas``; the measured
time per row is recorded next to the row id. ``with_model_output`` writes the
result to Parquet and joins it back on ``row_id``, so a model is never run
twice for the same rows."""

from __future__ import annotations

import hashlib
import re
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

_MODEL_CACHE: dict = {}


def _cached(name, version, factory):
    """The model of this name and version; an older version of the name is let go."""
    held = _MODEL_CACHE.get(name)
    if held is None or held[0] != version:
        _MODEL_CACHE[name] = held = (version, factory())
    return held[1]


def batch_apply_model(df: DataFrame, models: dict, id_col="row_id", input_cols=("prompt",),
                      out="generated", out_type=T.StringType(), version: str | None = None) -> DataFrame:
    """Long output ``(id_col, model, out, latency_s)`` for every model in
    ``models`` (name -> factory). Rows are copied once per model by an
    explode of the model names (no join) and each task applies the model
    of its rows. ``version`` names the models' state: calls that give the same
    one share a worker's models, without one each call builds its own."""
    from ..session import ship_package

    ship_package(df.sparkSession)
    names = list(models)
    cols = [id_col, *input_cols]
    long = df.select(*cols).withColumn(
        "model", F.explode(F.array(*[F.lit(n) for n in names])))
    schema = T.StructType([df.schema[id_col], T.StructField("model", T.StringType()),
                           T.StructField(out, out_type), T.StructField("latency_s", T.DoubleType())])
    factories = dict(models)
    version = version or uuid.uuid4().hex

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for name, part in pdf.groupby("model", sort=False):
                fn = _cached(name, version, factories[name])
                t0 = time.perf_counter()
                vals = fn(part.reset_index(drop=True))
                dt = time.perf_counter() - t0
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "model": name,
                                    out: list(vals), "latency_s": dt / max(len(part), 1)})

    return long.mapInPandas(run, schema)


def with_model_output(df: DataFrame, name: str, factory, id_col="row_id", input_cols=("text",), out="output",
                      out_type=T.StringType(), version: str | None = None) -> DataFrame:
    """``df`` with the output column of one model. The outputs are written
    once to the shared folder and meet the rows on ``id_col``, which must be
    unique; a row without an id gets no output."""
    made = batch_apply_model(df.where(F.col(id_col).isNotNull()), {name: factory}, id_col, input_cols, out, out_type, version)
    made = materialize(made.select(F.col(id_col).alias("_mid"), F.col(out).alias(out)), f"model-{name}")
    return df.join(made, F.col(id_col) == F.col("_mid"), "left").drop("_mid")


# -- deterministic stub models for tests and the fixture queries ------------------
# They see the prompt and the reference answer and "generate" prompt + text,
# as a decoder does; no network, no randomness.

def stub_half():
    def gen(pdf):
        resp = pdf["response"].fillna("")
        return pdf["prompt"] + resp.map(lambda r: r[: len(r) // 2])
    return gen


def stub_echo():
    def gen(pdf):
        return pdf["prompt"] + pdf["instruction"].fillna("")
    return gen


def stub_mix():
    def gen(pdf):
        return pdf["prompt"] + pdf["response"].fillna("").str[:60] + " " + pdf["instruction"].fillna("")
    return gen


STUB_MODELS = {"half": stub_half, "echo": stub_echo, "mix": stub_mix}


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stub_embedder(dim: int = 8):
    """Counts of a text's words by their length modulo ``dim``."""
    def factory():
        def emb(pdf):
            out = []
            for text in pdf["text"].fillna(""):
                v = [0.0] * dim
                for w in _WORD.findall(text):
                    v[len(w) % dim] += 1.0
                out.append(v)
            return out
        return emb
    return factory


def stub_reward():
    """A score per text: the mean length of its words, 0 without words."""
    def score(pdf):
        words = pdf["text"].fillna("").map(_WORD.findall)
        return words.map(lambda w: sum(map(len, w)) / len(w) if w else 0.0)
    return score


def stub_token_vectors(tokens: list[str], dim: int = 8) -> list[list[float]]:
    """A vector for each token from the hex digits of its md5."""
    out = []
    for t in tokens:
        h = hashlib.md5(t.encode()).hexdigest()
        out.append([int(h[4 * k:4 * k + 4], 16) / 65535.0 - 0.5 for k in range(dim)])
    return out

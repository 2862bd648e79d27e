"""Language identification by compression.

Per language a zstandard raw-content dictionary is made of a bounded sample of
labelled texts (``sample_docs`` texts a language, ``excerpt`` bytes of each
from a place in its whole letters that a hash chooses; ``dict_bytes`` at most,
which by default holds them all). A text, reduced to its lower-case letters, is cut
into blocks of ``BLOCK`` bytes (so that a long text is judged by the
dictionaries throughout, not by its own beginning) and each block is
compressed with every dictionary; the language with the fewest bytes over the
whole text wins. score is the margin 1 - best / second best. ``rejected`` marks
texts without a letter, and texts of at least MIN_BYTES letters whose margin
is below MIN_MARGIN; in shorter ones a byte more or less says nothing, so they
keep their best guess.

Only the fit samples: rows are counted per language over all documents (text
is not read for that), and rows below a hash threshold are fetched, about
twice ``sample_docs`` a language. Prediction runs over every whole text and
sees nothing but the text.

Results: null text or text without a letter: ``und``, score 0, rejected. Ties
go to the language with more training rows, then by name. Null labels and
labels whose texts hold no letter teach nothing; with no learned language all
is ``und``, with one language the score is 1. A null id counts as held out.
Repeated rows and empty tables need nothing special; further columns are kept
by ``with_language`` and ``keep_identified``."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_hash, id_remainder, packed, table, uniform, unpacked

BLOCK = 2048
LEVEL = 6
MIN_MARGIN = 0.005
MIN_BYTES = 200
SAMPLE_DOCS = 128
EXCERPT = 500
DICT_BYTES = SAMPLE_DOCS * (EXCERPT + 1)
FOLDS = 5

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MODELS: dict = {}


def letters(text: str) -> str:
    """Lower-case letters with single spaces; empty if the text has no letter."""
    out = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return out if any(map(str.isalpha, out)) else ""


def excerpt_at(text: str | None, h: str, excerpt: int) -> bytes:
    """``excerpt`` bytes of the text's letters, from a place chosen by the end of a hash (its beginning chose the row)."""
    data = letters(text or "").encode()
    start = int(h[16:], 16) % (max(0, len(data) - excerpt) + 1)
    return data[start:start + excerpt]


def fit(docs: DataFrame, folds: int = FOLDS, sample_docs: int = SAMPLE_DOCS, excerpt: int = EXCERPT,
        dict_bytes: int = DICT_BYTES) -> list[tuple[str, bytes]]:
    """(language, dictionary) from rows whose id remainder is not 0, best represented language first."""
    train = docs.where(F.col("lang").isNotNull() & (id_remainder(F.col("doc_id"), folds) != 0))
    # one row per language: the model itself holds one dictionary for each
    counts = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}
    if not counts:
        return []
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * sample_docs / n))])

    @F.pandas_udf("binary")
    def excerpts(text: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([excerpt_at(t, x, excerpt) for t, x in zip(text, h)], dtype=object)

    sample = (train.select("lang", "text", id_hash(F.col("doc_id"), F.col("text"), "langid").alias("h"))
              .where(uniform(F.col("h")) < F.element_at(rate, F.col("lang")))
              .select("lang", "h", excerpts("text", "h").alias("part")).collect())
    texts: dict[str, list] = {}
    for r in sample:
        if r["part"]:
            texts.setdefault(r["lang"], []).append((r["h"], bytes(r["part"])))
    model = [(lang, b" ".join(t for _, t in sorted(rows)[:sample_docs])[:dict_bytes]) for lang, rows in texts.items()]
    return sorted(model, key=lambda m: (-counts[m[0]], m[0]))


def compressors(model) -> list:
    """(language, compressor); built once per worker process for a model."""
    import zstandard

    if model is None or not model:
        return []
    key = hash(tuple(model))
    if key not in _MODELS:
        _MODELS.clear()
        out = []
        for lang, raw in model:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False,
                                                       write_checksum=False, write_dict_id=False)))
        _MODELS[key] = out
    return _MODELS[key]


def predict(text, model) -> tuple[str, float, bool]:
    """(language, score, rejected) of one whole text."""
    kept = letters(text) if text else ""
    by = compressors(model)
    if not kept or not by:
        return "und", 0.0, True
    if len(by) == 1:
        return by[0][0], 1.0, False
    data = kept.encode()
    blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
    sizes = [sum(len(c.compress(b)) for b in blocks) for _, c in by]
    first = min(range(len(by)), key=lambda i: sizes[i])  # the earlier language wins a tie
    second = min(s for i, s in enumerate(sizes) if i != first)
    score = 1.0 - sizes[first] / second
    return by[first][0], score, len(data) >= MIN_BYTES and score < MIN_MARGIN


def classifier(docs: DataFrame, **how):
    """A column function text -> struct(lang_pred, score, rejected), fitted on ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, **how))  # one dictionary a language

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def classify(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict(t, model.value) for t in text], columns=["lang_pred", "score", "rejected"])

    return classify


def with_language(docs: DataFrame, **how) -> DataFrame:
    """One row per document: its columns as struct ``d``, and the prediction ``p``."""
    return docs.select(packed(docs), "text").withColumn("p", classifier(docs, **how)("text")).select("d", "p")


def keep_identified(docs: DataFrame, **how) -> DataFrame:
    """The documents that the classifier does not reject."""
    return unpacked(with_language(docs, **how).where(~F.col("p.rejected")), docs)


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return (docs.select("doc_id", (id_remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
                        classifier(docs)("text").alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected"))

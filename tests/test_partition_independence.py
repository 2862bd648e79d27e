"""SURVEY section 5.4: the same result with 1 and many shuffle partitions,
and with every order helper forced onto its distributed two-pass path."""

import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

NAMES = ["ratio_split_exact", "shuffled_full_batches", "epoch_batch_plan", "kl_mismatch_pairs", "pack_wrapped",
         "sequence_logps", "bco_loss", "advantage_per_prompt", "tokenize_corpus", "sentence_bleu", "gae",
         "extract_prompt", "unpair_preferences"]


def _rows(df):
    def norm(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        return v
    return sorted((tuple(norm(x) for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_same_result_across_partitionings(spark, name):
    fn = E.queries()[name]
    base = _rows(fn(spark, SF_SMALL))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = _rows(fn(spark, SF_SMALL))
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        dist = _rows(fn(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert base == one == dist

"""Queries for token and sequence jobs (K1-K14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.order import hash_rank
from ..operators import prompt as P
from ..operators import tokens as K
from ..sources.views import Views, table
from .catalog import register
from .q_data import sql_head, sql_md5, sql_strip

# -- SQL helpers mirroring the default tokenisers ------------------------------


def sql_ws(x: str) -> str:
    return f"list_filter(string_split_regex({sql_strip(f'coalesce({x}, {chr(39)}{chr(39)})')}, '\\s+'), lambda t: t <> '')"


def sql_hashed(toks: str) -> str:
    return f"list_transform({toks}, lambda t: ('0x' || substr(md5(t), 1, 13))::BIGINT + 3)"


def token_arrays(seq):
    """(seq_id, ids) with ids = token_id % 10 in position order (token 0 =
    pad, 1 = stop). One array per sequence: bounded by the sequence."""
    return seq.groupBy("seq_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("token_id") % 10).alias("t")))),
                    lambda s: s["t"]).alias("input_ids"))


SQL_TOKEN_ARRAYS = "SELECT seq_id, list(token_id % 10 ORDER BY pos) AS input_ids FROM seq GROUP BY seq_id"


# -- K1 -----------------------------------------------------------------------------

@register("tokenize_corpus", """
WITH l AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS l FROM documents),
toks AS (SELECT doc_id, unnest(l) AS token, unnest(range(len(l))) AS pos FROM l),
vocab AS (SELECT token, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, token) - 1 + 3 AS id FROM toks GROUP BY token),
per AS (SELECT t.doc_id, COUNT(*) AS n_tokens,
               SUM(CASE WHEN t.pos < 512 THEN v.id END) AS id_sum,
               SUM(CASE WHEN t.pos < 512 THEN v.id * (t.pos + 1) END) AS id_pos_sum
        FROM toks t JOIN vocab v USING (token) GROUP BY t.doc_id)
SELECT l.doc_id, l.source, CAST(COALESCE(n_tokens, 0) AS BIGINT) AS n_tokens,
       CAST(LEAST(COALESCE(n_tokens, 0), 512) AS BIGINT) AS n_kept, COALESCE(n_tokens, 0) > 512 AS truncated,
       CAST(COALESCE(id_sum, 0) AS BIGINT) AS id_sum, CAST(COALESCE(id_pos_sum, 0) AS BIGINT) AS id_pos_sum
FROM l LEFT JOIN per USING (doc_id)""")
def q_tokenize_corpus(spark, sf_dir):
    tok = K.tokenize_corpus(table(spark, sf_dir, "documents"), max_length=512)
    return tok.select(
        "doc_id", "source", "n_tokens", "n_kept", "truncated",
        F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"),
        F.aggregate(F.transform("input_ids", lambda x, i: x * (i + 1)), F.lit(0).cast("bigint"),
                    lambda a, x: a + x).alias("id_pos_sum"))


@register("tokenize_summary", """
WITH l AS (SELECT source, len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS n FROM documents)
SELECT source, COUNT(*) AS n_rows, CAST(SUM(n) AS BIGINT) AS n_tokens, CAST(SUM(LEAST(n, 512)) AS BIGINT) AS n_kept,
       COUNT_IF(n > 512) AS n_truncated FROM l GROUP BY source""")
def q_tokenize_summary(spark, sf_dir):
    return K.tokenize_summary(table(spark, sf_dir, "documents"))


# -- K2 -----------------------------------------------------------------------------

@register("padding_waste_report", f"""
WITH len AS (SELECT seq_id, COUNT(*) AS length FROM seq GROUP BY seq_id),
b AS (SELECT seq_id, length, (ROW_NUMBER() OVER (ORDER BY {sql_md5(42, 'seq_id')}, seq_id) - 1) // 8 AS batch_id FROM len),
pb AS (SELECT batch_id, COUNT(*) AS n, SUM(LEAST(length, 4)) AS real, MAX(LEAST(length, 4)) AS mx,
              SUM(GREATEST(length - 4, 0)) AS cut, SUM(length) AS raw FROM b GROUP BY batch_id)
SELECT CAST(SUM(real) AS BIGINT) AS real_tokens, CAST(SUM(n * 4) AS BIGINT) AS padded_max_length,
       CAST(SUM(n * mx) AS BIGINT) AS padded_batch_max, CAST(SUM(n * CEIL(mx / 8) * 8) AS BIGINT) AS padded_multiple,
       CAST(SUM(CEIL(real / 4) * 4) AS BIGINT) AS packed_tokens, CAST(SUM(real) AS BIGINT) AS flattened_tokens,
       SUM(cut) / SUM(raw) AS truncated_share
FROM pb""", ["seq"])
def q_padding_waste_report(spark, sf_dir):
    seq = Views(spark, sf_dir).seq()
    lengths = seq.groupBy("seq_id").agg(F.count(F.lit(1)).alias("length"))
    b = hash_rank(lengths, "seq_id", rank_col="_r").withColumn("batch_id", F.floor(F.col("_r") / 8))
    return K.padding_waste_report(b, max_length=4, multiple=8)


# -- K5 -----------------------------------------------------------------------------

@register("supervision_labels", f"""
WITH a AS ({SQL_TOKEN_ARRAYS}),
b AS (SELECT seq_id, input_ids, LEAST(len(input_ids), 8) AS nr, len(input_ids) // 2 AS pl FROM a)
SELECT seq_id % 4 AS source, COUNT(*) AS n_seqs, CAST(SUM(8) AS BIGINT) AS full_supervised,
       CAST(SUM(nr) AS BIGINT) AS mask_pad_supervised, CAST(SUM(GREATEST(nr - pl, 0)) AS BIGINT) AS completion_supervised,
       CAST(SUM(COALESCE(list_sum(list_slice(input_ids, pl + 1, nr)), 0)) AS BIGINT) AS completion_label_sum
FROM b GROUP BY 1""", ["seq"])
def q_supervision_labels(spark, sf_dir):
    arr = token_arrays(Views(spark, sf_dir).seq()).withColumn(
        "prompt_len", F.floor(F.size("input_ids") / 2).cast("int"))
    out = arr
    for mode in ("full", "mask_pad", "completion"):
        out = K.supervision_labels(out, mode=mode, max_length=8).withColumnRenamed("labels", f"labels_{mode}")
    lab = F.col("labels_completion")
    return out.groupBy((F.col("seq_id") % 4).alias("source")).agg(
        F.count(F.lit(1)).alias("n_seqs"),
        F.sum(K.supervised_count(F.col("labels_full"))).cast("bigint").alias("full_supervised"),
        F.sum(K.supervised_count(F.col("labels_mask_pad"))).cast("bigint").alias("mask_pad_supervised"),
        F.sum(K.supervised_count(lab)).cast("bigint").alias("completion_supervised"),
        F.sum(F.aggregate(F.filter(lab, lambda x: x != -100), F.lit(0).cast("bigint"),
                          lambda a, x: a + x)).cast("bigint").alias("completion_label_sum"))


# -- K6 -----------------------------------------------------------------------------

@register("prompt_completion_mask", f"""
WITH t AS (SELECT row_id, {sql_hashed(sql_ws(sql_head()))} AS p, {sql_hashed(sql_ws('response'))} AS c FROM instr),
n AS (SELECT row_id, p, c, LEAST(len(p) + len(c), 64) AS n FROM t)
SELECT row_id, CAST(n AS INT) AS n_ids, CAST(COALESCE(list_sum(list_slice(list_concat(p, c), 1, 64)), 0) AS BIGINT) AS ids_sum,
       repeat('0', LEAST(len(p), n)) || repeat('1', n - LEAST(len(p), n)) AS mask_text
FROM n""", ["instr"])
def q_prompt_completion_mask(spark, sf_dir):
    i = P.format_infer_prompt(Views(spark, sf_dir).instr())
    t = i.select("row_id", K.hashed_ids(K.ws_tokens(F.col("prompt"))).alias("prompt_ids"),
                 K.hashed_ids(K.ws_tokens(F.col("response"))).alias("completion_ids"))
    out = K.prompt_completion_mask(t, max_length=64, token_type_ids=True)
    return out.select("row_id", F.size("input_ids").alias("n_ids"),
                      F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ids_sum"),
                      F.array_join("completion_mask", "").alias("mask_text"))


# -- K7 -----------------------------------------------------------------------------

_RENDER_ONE = "'<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)"


@register("assistant_mask", f"""
SELECT conv_id,
  CAST(list_sum(list_transform(messages, lambda m: len({sql_ws(_RENDER_ONE)}))) AS INT) AS n_tokens,
  CAST(list_sum(list_transform(messages, lambda m: CASE WHEN m.role = 'assistant'
       THEN len({sql_ws(_RENDER_ONE)}) ELSE 0 END)) AS BIGINT) AS n_assistant_tokens
FROM conv_msgs""", ["conv_msgs"])
def q_assistant_mask(spark, sf_dir):
    m = P.messages_from_turns(table(spark, sf_dir, "conversations"))
    out = K.assistant_mask(m)
    return out.select("conv_id", F.size("tokens").alias("n_tokens"),
                      F.aggregate("assistant_masks", F.lit(0).cast("bigint"),
                                  lambda a, x: a + x).alias("n_assistant_tokens"))


# -- K8 -----------------------------------------------------------------------------

@register("pair_boundary_audit", f"""
WITH t AS (SELECT row_id, {sql_ws('prompt')} AS pt, {sql_ws('prompt || chosen')} AS ct,
                  {sql_ws('prompt || rejected')} AS rt FROM pref),
b AS (SELECT row_id, pt, ct, rt,
             CASE WHEN list_slice(ct, 1, len(pt)) = pt THEN len(pt) ELSE len(pt) - 1 END AS bc,
             CASE WHEN list_slice(rt, 1, len(pt)) = pt THEN len(pt) ELSE len(pt) - 1 END AS br FROM t),
d AS (SELECT row_id, bc, br, list_slice(ct, 1, bc) AS cp, list_slice(rt, 1, br) AS rp FROM b)
SELECT row_id, CAST(bc AS INT) AS boundary_chosen, CAST(br AS INT) AS boundary_rejected,
       CAST(len(list_filter(range(1, GREATEST(len(cp), len(rp)) + 1), lambda i: COALESCE(cp[i] <> rp[i], true))) AS INT)
         AS prompt_token_diff,
       ABS(bc - br) > 1 OR len(list_filter(range(1, GREATEST(len(cp), len(rp)) + 1),
                                           lambda i: COALESCE(cp[i] <> rp[i], true))) > 1 AS violation
FROM d""", ["pref"])
def q_pair_boundary_audit(spark, sf_dir):
    return K.pair_boundary_audit(Views(spark, sf_dir).pref()).select(
        "row_id", "boundary_chosen", "boundary_rejected", "prompt_token_diff", "violation")


# -- K10 ----------------------------------------------------------------------------

def _pref_ids(spark, sf_dir):
    p = Views(spark, sf_dir).pref()
    return p.select("row_id", K.hashed_ids(K.ws_tokens(F.col("prompt"))).alias("prompt_ids"),
                    K.hashed_ids(K.ws_tokens(F.col("chosen"))).alias("chosen_ids"),
                    K.hashed_ids(K.ws_tokens(F.col("rejected"))).alias("rejected_ids"))


_PREF_IDS_SQL = (f"SELECT row_id, {sql_hashed(sql_ws('prompt'))} AS p, {sql_hashed(sql_ws('chosen'))} AS c, "
                 f"{sql_hashed(sql_ws('rejected'))} AS r FROM pref")


@register("truncate_pair", f"""
WITH t AS ({_PREF_IDS_SQL}),
a AS (SELECT row_id, p, len(p) AS lp, len(c) AS lc, len(r) AS lr,
             len(p) + GREATEST(len(c), len(r)) > 64 AS over FROM t),
b AS (SELECT *, CASE WHEN over THEN LEAST(lp, 24) ELSE lp END AS lp2 FROM a),
c AS (SELECT *, lp2 + GREATEST(lc, lr) > 64 AS still FROM b),
d AS (SELECT *, CASE WHEN still THEN LEAST(lc, 40) ELSE lc END AS lc2,
             CASE WHEN still THEN LEAST(lr, 40) ELSE lr END AS lr2 FROM c)
SELECT row_id, CAST(lp2 AS INT) AS n_prompt, CAST(lc2 AS INT) AS n_chosen, CAST(lr2 AS INT) AS n_rejected,
       CAST(lp - lp2 + lc - lc2 + lr - lr2 AS BIGINT) AS tokens_lost,
       CAST(COALESCE(list_sum(list_slice(p, lp - lp2 + 1, lp)), 0) AS BIGINT) AS prompt_sum
FROM d""", ["pref"])
def q_truncate_pair(spark, sf_dir):
    out = K.truncate_pair(_pref_ids(spark, sf_dir), max_length=64, max_prompt_length=24, mode="keep_end")
    return out.select("row_id", F.size("prompt_ids").alias("n_prompt"), F.size("chosen_ids").alias("n_chosen"),
                      F.size("rejected_ids").alias("n_rejected"), "tokens_lost",
                      F.aggregate("prompt_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("prompt_sum"))


# -- K13 ----------------------------------------------------------------------------

def _stepwise(spark, sf_dir):
    v = Views(spark, sf_dir)
    steps = v.steps().groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("step", "completion", "label"))).alias("_s"))
    first_user = (v.t("conversations").where(F.col("role") == "user").groupBy("conv_id")
                  .agg(F.min_by("text", "turn").alias("prompt")))
    return first_user.join(steps, "conv_id").select(
        "conv_id", K.hashed_ids(K.ws_tokens(F.col("prompt"))).alias("prompt_ids"),
        F.transform("_s", lambda s: K.hashed_ids(K.ws_tokens(s["completion"]))).alias("steps_ids"),
        F.transform("_s", lambda s: s["label"] == 1).alias("labels"))


@register("prm_step_labels", f"""
WITH s AS (SELECT conv_id, list({sql_hashed(sql_ws('completion'))} ORDER BY step) AS sid,
                  list(label ORDER BY step) AS lab FROM steps GROUP BY conv_id),
u AS (SELECT conv_id, {sql_hashed(sql_ws('arg_min(text, turn)'))} AS p FROM conversations WHERE role = 'user' GROUP BY conv_id),
j AS (SELECT s.conv_id, list_concat([2], u.p) AS p0,
             flatten(list_transform(sid, lambda x: list_concat(x, [1]))) AS c,
             flatten(list_transform(range(1, len(sid) + 1), lambda i: list_concat(
                 list_resize([]::BIGINT[], len(sid[i]), -100), [CAST(lab[i] AS BIGINT)]))) AS l
      FROM s JOIN u USING (conv_id)),
k AS (SELECT conv_id, list_slice(p0, len(p0) - LEAST(len(p0), 16) + 1, len(p0)) AS p,
             list_slice(c, 1, 64) AS c, list_slice(l, 1, 64) AS l FROM j),
m AS (SELECT conv_id, list_slice(list_concat(p, c), 1, 72) AS ids,
             list_slice(list_concat(list_resize([]::BIGINT[], len(p), -100), l), 1, 72) AS lab FROM k)
SELECT conv_id, CAST(len(ids) AS INT) AS n_ids, CAST(list_sum(ids) AS BIGINT) AS ids_sum,
       CAST(len(list_filter(lab, lambda x: x <> -100)) AS INT) AS n_supervised,
       CAST(COALESCE(list_sum(list_filter(lab, lambda x: x <> -100)), 0) AS BIGINT) AS label_sum
FROM m""", ["steps"])
def q_prm_step_labels(spark, sf_dir):
    out = K.prm_step_labels(_stepwise(spark, sf_dir), max_prompt_length=16, max_completion_length=64,
                            max_length=72)
    kept = F.filter("step_labels", lambda x: x != -100)
    return out.select("conv_id", F.size("input_ids").alias("n_ids"),
                      F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ids_sum"),
                      F.size(kept).alias("n_supervised"),
                      F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("label_sum"))


# -- K14 ----------------------------------------------------------------------------

@register("length_filter_pairs", f"""
WITH t AS (SELECT row_id, {sql_hashed(sql_ws("prompt || ' ' || chosen"))} AS c,
                  {sql_hashed(sql_ws("prompt || ' ' || rejected"))} AS r FROM pref)
SELECT row_id, CAST(len(c) AS INT) AS len_chosen, CAST(len(r) AS INT) AS len_rejected
FROM t WHERE len(c) <= 96 AND len(r) <= 96""", ["pref"])
def q_length_filter_pairs(spark, sf_dir):
    p = Views(spark, sf_dir).pref()
    t = p.select("row_id",
                 K.hashed_ids(K.ws_tokens(F.concat_ws(" ", "prompt", "chosen"))).alias("chosen_ids"),
                 K.hashed_ids(K.ws_tokens(F.concat_ws(" ", "prompt", "rejected"))).alias("rejected_ids"))
    return K.length_filter_pairs(t, max_length=96).select(
        "row_id", F.size("chosen_ids").alias("len_chosen"), F.size("rejected_ids").alias("len_rejected"))


@register("length_filter_report", f"""
WITH t AS (SELECT row_id, {sql_hashed(sql_ws("prompt || ' ' || chosen"))} AS c,
                  {sql_hashed(sql_ws("prompt || ' ' || rejected"))} AS r FROM pref)
SELECT COUNT_IF(len(c) <= 96 AND len(r) <= 96) AS n_kept, COUNT_IF(NOT (len(c) <= 96 AND len(r) <= 96)) AS n_dropped
FROM t""", ["pref"])
def q_length_filter_report(spark, sf_dir):
    p = Views(spark, sf_dir).pref()
    t = p.select(K.hashed_ids(K.ws_tokens(F.concat_ws(" ", "prompt", "chosen"))).alias("chosen_ids"),
                 K.hashed_ids(K.ws_tokens(F.concat_ws(" ", "prompt", "rejected"))).alias("rejected_ids"))
    return K.length_filter_report(t, max_length=96)

"""Queries for scans/sinks (S*), splits and sampling (T*) and prompt
preparation (P*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import clean_text
from ..operators import prompt as P
from ..operators import split as S
from ..session import scratch_path
from ..sources import io
from ..sources.views import Views, table
from .catalog import register

NL = "chr(10)"


def sql_strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def sql_clean(x: str) -> str:
    return sql_strip(f"translate(coalesce({x}, ''), chr(10) || chr(13), '  ')")


def sql_md5(seed, *cols) -> str:
    parts = " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"md5('{seed}:' || {parts})"


def sql_hex8(h: str) -> str:
    return f"('0x' || substr({h}, 1, 8))::BIGINT"


def sql_head(i="instruction", c="context") -> str:
    blank = f"{sql_strip(f'coalesce({c}, {chr(39)}{chr(39)})')} = ''"
    return (f"CASE WHEN {blank} THEN '### Instruction:' || {NL} || {i} || {NL} || {NL} || '### Response:' || {NL} "
            f"ELSE '### Instruction:' || {NL} || {i} || {NL} || {NL} || '### Context:' || {NL} || {c} || {NL} || {NL} "
            f"|| '### Response:' || {NL} END")


def sql_split_exact(src: str, id_col: str, seed=42) -> str:
    """Oracle of ratio_split_exact as a sub-select of (id, split)."""
    return f"""(SELECT {id_col}, CASE WHEN rk < n - held THEN 'train' WHEN rk < n - test THEN 'dev' ELSE 'test' END AS split
   FROM (SELECT {id_col}, rk, n, held, CAST(CEIL(held * 0.5::DOUBLE) AS BIGINT) AS test
         FROM (SELECT {id_col}, rk, n, CAST(CEIL(n * 0.2::DOUBLE) AS BIGINT) AS held
               FROM (SELECT {id_col}, ROW_NUMBER() OVER (ORDER BY {sql_md5(seed, id_col)}, {id_col}) - 1 AS rk,
                            COUNT(*) OVER () AS n FROM {src}) a) b) c)"""


# -- S: sources and sinks -------------------------------------------------------

@register("read_dataset", "SELECT conv_id, turn, role, text FROM conversations")
def q_read_dataset(spark, sf_dir):
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return io.read_dataset(spark, f"{sf_dir}/conversations.parquet", schema=schema)


_PROFILE_SQL = """
SELECT COUNT(*) AS n_rows,
  COUNT_IF(doc_id IS NULL) AS doc_id_nulls,
  COUNT_IF(text IS NULL) AS text_nulls, COUNT_IF(text IS NOT NULL AND {blank_text}) AS text_blank,
  MIN(LENGTH(text)) AS text_min_len, MAX(LENGTH(text)) AS text_max_len, AVG(LENGTH(text)) AS text_avg_len,
  COUNT_IF(lang IS NULL) AS lang_nulls, COUNT_IF(lang IS NOT NULL AND {blank_lang}) AS lang_blank,
  MIN(LENGTH(lang)) AS lang_min_len, MAX(LENGTH(lang)) AS lang_max_len, AVG(LENGTH(lang)) AS lang_avg_len,
  COUNT_IF(source IS NULL) AS source_nulls, COUNT_IF(source IS NOT NULL AND {blank_source}) AS source_blank,
  MIN(LENGTH(source)) AS source_min_len, MAX(LENGTH(source)) AS source_max_len, AVG(LENGTH(source)) AS source_avg_len,
  COUNT_IF(n_chars IS NULL) AS n_chars_nulls
FROM documents""".format(blank_text=sql_strip("text") + " = ''", blank_lang=sql_strip("lang") + " = ''",
                          blank_source=sql_strip("source") + " = ''")


@register("profile_dataset", _PROFILE_SQL)
def q_profile_dataset(spark, sf_dir):
    return io.profile_dataset(table(spark, sf_dir, "documents"))


@register("write_splits", f"""
SELECT d.doc_id, d.lang, d.source, d.n_chars, s.split
FROM documents d JOIN {sql_split_exact('documents', 'doc_id')} s USING (doc_id) WHERE s.split = 'dev'""")
def q_write_splits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    path = io.write_splits(S.ratio_split_exact(docs, "doc_id"), scratch_path(spark, "splits"))
    return io.read_split(spark, path, "dev").select("doc_id", "lang", "source", "n_chars", "split")


@register("csv_exchange", "SELECT row_id, model, instruction, reference, prediction FROM preds", ["preds"])
def q_csv_exchange(spark, sf_dir):
    preds = Views(spark, sf_dir).preds()
    path = io.write_csv_table(preds, scratch_path(spark, "preds-csv"))
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("model", T.StringType()),
                           T.StructField("instruction", T.StringType()),
                           T.StructField("reference", T.StringType()),
                           T.StructField("prediction", T.StringType())])
    return io.read_csv_table(spark, path, schema)


@register("named_eval_sets", f"""
SELECT s.split AS eval_name, i.row_id, {sql_head()} AS prompt
FROM instr i JOIN {sql_split_exact('instr', 'row_id')} s USING (row_id) WHERE s.split IN ('dev', 'test')""",
          ["instr"])
def q_named_eval_sets(spark, sf_dir):
    split = S.ratio_split_exact(Views(spark, sf_dir).instr(), "row_id")
    sets = {k: split.where(F.col("split") == k) for k in ("dev", "test")}
    out = io.named_eval_sets(sets, prep=lambda d: P.format_infer_prompt(d))
    return out.select("eval_name", "row_id", "prompt")


@register("sample_table_sink", f"""
SELECT instruction AS "Prompt", prediction AS "Policy", model FROM preds
ORDER BY {sql_md5(42, 'row_id', 'model')}, row_id, model LIMIT 10""", ["preds"])
def q_sample_table_sink(spark, sf_dir):
    preds = Views(spark, sf_dir).preds().withColumn(
        "_k", F.concat_ws(":", F.col("row_id").cast("string"), "model"))
    return (S.seeded_sample_n(preds, 10, id_col="_k")
            .select(F.col("instruction").alias("Prompt"), F.col("prediction").alias("Policy"), "model"))


# -- T: splits, sampling, batching ---------------------------------------------

@register("ratio_split_exact", f"SELECT doc_id, split FROM {sql_split_exact('documents', 'doc_id')} s")
def q_ratio_split_exact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return S.ratio_split_exact(docs, "doc_id").select("doc_id", "split")


@register("ratio_split_counts", f"""
SELECT split, COUNT(*) AS n FROM {sql_split_exact('documents', 'doc_id')} s GROUP BY split""")
def q_ratio_split_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return S.split_counts(S.ratio_split_exact(docs, "doc_id"))


@register("ratio_split_hash", f"""
SELECT doc_id, bucket, CASE WHEN bucket < 800 THEN 'train' WHEN bucket < 900 THEN 'dev' ELSE 'test' END AS split
FROM (SELECT doc_id, {sql_hex8(sql_md5(42, 'doc_id'))} % 1000 AS bucket FROM documents) t""")
def q_ratio_split_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return S.ratio_split_hash(docs, "doc_id").select("doc_id", "bucket", "split")


@register("seeded_sample_n", f"""
SELECT row_id, instruction FROM instr ORDER BY {sql_md5(42, 'row_id')}, row_id LIMIT 50""", ["instr"])
def q_seeded_sample_n(spark, sf_dir):
    return S.seeded_sample_n(Views(spark, sf_dir).instr(), 50).select("row_id", "instruction")


@register("sample_with_replacement_n", f"""
WITH r AS (SELECT vec_id, label, ROW_NUMBER() OVER (ORDER BY {sql_md5(42, 'vec_id')}, vec_id) - 1 AS idx,
                  COUNT(*) OVER () AS n FROM embeddings),
     t AS (SELECT DISTINCT n FROM r),
     d AS (SELECT range AS draw FROM range(1024))
SELECT d.draw, r.vec_id, r.label
FROM d JOIN t ON d.draw < t.n
JOIN r ON r.idx = {sql_hex8("md5('42:draw:' || CAST(d.draw AS VARCHAR))")} % t.n""")
def q_sample_with_replacement_n(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return S.sample_with_replacement_n(spark, emb, 1024, id_col="vec_id").select("draw", "vec_id", "label")


_PAIR_KEY = "CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) || ':' || CAST(l_suppkey AS VARCHAR)"


def _pair_key(df):
    return df.withColumn("pair_key", F.concat_ws(":", *[F.col(c).cast("string") for c in
                                                      ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]))


@register("shuffled_full_batches", f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
                  ROW_NUMBER() OVER (ORDER BY md5('42:' || {_PAIR_KEY}), {_PAIR_KEY}) - 1 AS rk,
                  COUNT(*) OVER () AS n FROM pair_logp)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(FLOOR(rk / 64) AS BIGINT) AS batch_id,
       CAST(rk % 64 AS BIGINT) AS batch_pos
FROM r WHERE rk < (n // 64) * 64""", ["pair_logp"])
def q_shuffled_full_batches(spark, sf_dir):
    df = _pair_key(Views(spark, sf_dir).pair_logp())
    return S.shuffled_full_batches(df, 64, id_col="pair_key").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "batch_id", "batch_pos")


@register("epoch_batch_plan", f"""
WITH e AS (SELECT p.*, ep.range AS epoch, CAST(ep.range AS VARCHAR) || ':' || {_PAIR_KEY} AS k
           FROM pair_logp p CROSS JOIN range(2) ep),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch,
             ROW_NUMBER() OVER (PARTITION BY epoch ORDER BY md5('42:' || k), k) - 1 AS rk FROM e)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch, rk AS order_in_epoch,
       CAST(FLOOR(rk / 512) AS BIGINT) AS batch_id, CAST(FLOOR((rk % 512) / 128) AS BIGINT) AS mini_batch_id,
       CAST(FLOOR((rk % 128) / 32) AS BIGINT) AS micro_batch_id
FROM r""", ["pair_logp"])
def q_epoch_batch_plan(spark, sf_dir):
    df = _pair_key(Views(spark, sf_dir).pair_logp()).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "pair_key")
    out = S.epoch_batch_plan(spark, df, 2, 512, 128, 32, id_col="pair_key")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      F.col("epoch").cast("bigint").alias("epoch"), "order_in_epoch",
                      "batch_id", "mini_batch_id", "micro_batch_id")


# -- P: prompts and text ---------------------------------------------------------

@register("format_train_prompt", f"SELECT row_id, {sql_head()} || response AS text FROM instr", ["instr"])
def q_format_train_prompt(spark, sf_dir):
    return P.format_train_prompt(Views(spark, sf_dir).instr()).select("row_id", "text")


@register("format_infer_prompt", f"SELECT row_id, {sql_head()} AS prompt FROM instr", ["instr"])
def q_format_infer_prompt(spark, sf_dir):
    return P.format_infer_prompt(Views(spark, sf_dir).instr()).select("row_id", "prompt")


@register("clean_text", f"SELECT conv_id, turn, {sql_clean('text')} AS text FROM conversations")
def q_clean_text(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    return conv.select("conv_id", "turn", clean_text("text").alias("text"))


_RENDER = ("array_to_string(list_transform({m}, lambda x: '<|im_start|>' || x.role || chr(10) || x.content "
           "|| '<|im_end|>' || chr(10)), '')")


@register("messages_from_turns", """
SELECT conv_id, CAST(len(messages) AS BIGINT) AS n_messages,
       array_to_string(list_transform(messages, lambda x: x.role), ',') AS roles,
       CAST(list_sum(list_transform(messages, lambda x: length(x.content))) AS BIGINT) AS chars
FROM conv_msgs""", ["conv_msgs"])
def q_messages_from_turns(spark, sf_dir):
    m = P.messages_from_turns(table(spark, sf_dir, "conversations"))
    return m.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"),
                    F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"),
                    F.aggregate(F.transform("messages", lambda x: F.length(x["content"])), F.lit(0),
                                lambda a, b: a + b).cast("bigint").alias("chars"))


@register("apply_chat_template", f"""
SELECT conv_id, {_RENDER.format(m='messages')} || '<|im_start|>assistant' || chr(10) AS text FROM conv_msgs""",
          ["conv_msgs"])
def q_apply_chat_template(spark, sf_dir):
    m = P.messages_from_turns(table(spark, sf_dir, "conversations"))
    return P.apply_chat_template(m, add_generation_prompt=True).select("conv_id", "text")


@register("apply_chat_template_args", f"""
SELECT conv_id, 'conversation ' || conv_id || ' (' || CASE WHEN conv_id % 3 = 0 THEN 'short' ELSE '' END || ')' || chr(10)
       || CASE WHEN conv_id % 2 = 0 THEN '<tools>search; list_' || len(messages) || '</tools>' ELSE '' END
       || array_to_string(list_transform(messages, lambda x: '[' || CASE WHEN conv_id % 3 = 0 THEN 'short' ELSE '' END || '] '
                                                             || x.role || chr(10) || x.content || '<|im_end|>' || chr(10)), '')
       || CASE WHEN conv_id % 2 = 0 THEN '<|im_start|>assistant' || chr(10) ELSE '' END AS text
FROM conv_msgs""", ["conv_msgs"])
def q_apply_chat_template_args(spark, sf_dir):
    m = P.messages_from_turns(table(spark, sf_dir, "conversations"))
    even = F.col("conv_id") % 2 == 0
    m = (m.withColumn("args", F.when(F.col("conv_id") % 3 == 0, F.create_map(
            F.lit("id"), F.col("conv_id").cast("string"), F.lit("style"), F.lit("short")))
            .otherwise(F.create_map(F.lit("id"), F.col("conv_id").cast("string"))))
         .withColumn("tools", F.when(even, F.array(F.lit("search"), F.concat(F.lit("list_"), F.size("messages").cast("string"))))))
    template = {"head": "conversation {id} ({style})\n", "start": "[{style}] ", "tools_start": "<tools>", "tool_sep": "; ", "tools_end": "</tools>"}
    return P.apply_chat_template(m, template=template, add_generation_prompt=even, args="args", tools="tools").select("conv_id", "text")


@register("split_last_turn", f"""
SELECT conv_id, {_RENDER.format(m='messages[1:len(messages) - 1]')} AS prompt_text,
       {_RENDER.format(m='[messages[len(messages)]]')} AS completion_text,
       messages[len(messages)].role AS completion_role,
       CAST(length({_RENDER.format(m='messages[1:len(messages) - 1]')}) AS INT) AS prompt_chars
FROM conv_msgs""", ["conv_msgs"])
def q_split_last_turn(spark, sf_dir):
    m = P.messages_from_turns(table(spark, sf_dir, "conversations"))
    return P.split_last_turn(m).select("conv_id", "prompt_text", "completion_text", "completion_role",
                                       "prompt_chars")


@register("format_profile", """
SELECT format, source, COUNT(*) AS n FROM (
  SELECT 'prompt_completion' AS format, 'instr' AS source FROM instr
  UNION ALL SELECT 'conversational', 'conversations' FROM conv_msgs
  UNION ALL SELECT CASE WHEN text IS NULL THEN 'needs_formatter' ELSE 'language_modeling' END, source FROM documents
) t GROUP BY format, source""", ["instr", "conv_msgs"])
def q_format_profile(spark, sf_dir):
    v = Views(spark, sf_dir)
    a = v.instr().select(F.col("instruction").alias("prompt"), F.col("response").alias("completion"),
                         F.lit("instr").alias("source"))
    b = P.messages_from_turns(v.t("conversations")).select("messages", F.lit("conversations").alias("source"))
    c = v.t("documents").select("text", "source")
    mixed = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    return P.format_profile(mixed)


def _lcp_sql(a: str, b: str) -> str:
    short = f"LEAST(length({a}), length({b}))"
    return (f"COALESCE(list_position(list_transform(range(1, {short} + 1), "
            f"lambda i: substr({a}, i, 1) = substr({b}, i, 1)), false) - 1, {short})")


@register("extract_prompt", f"""
WITH f AS (SELECT row_id, prompt || chr(10) || chosen AS c, prompt || chr(10) || rejected AS r FROM pref),
k AS (SELECT row_id, c, r, {_lcp_sql('c', 'r')} AS k FROM f)
SELECT row_id, substr(c, 1, k) AS prompt, substr(c, k + 1) AS chosen, substr(r, k + 1) AS rejected FROM k""",
          ["pref"])
def q_extract_prompt(spark, sf_dir):
    p = Views(spark, sf_dir).pref()
    full = p.select("row_id", F.concat("prompt", F.lit("\n"), "chosen").alias("chosen"),
                    F.concat("prompt", F.lit("\n"), "rejected").alias("rejected"))
    return P.extract_prompt(full).select("row_id", "prompt", "chosen", "rejected")


@register("unpair_preferences", """
SELECT row_id, prompt, chosen AS completion, TRUE AS label FROM pref
UNION ALL SELECT row_id, prompt, rejected, FALSE FROM pref""", ["pref"])
def q_unpair_preferences(spark, sf_dir):
    return P.unpair_preferences(Views(spark, sf_dir).pref())


@register("special_token_audit", """
SELECT source, COUNT(*) AS n, COUNT_IF(starts_with(text, '<s>')) AS n_start_bos,
       COUNT_IF(NOT ends_with(text, '</s>')) AS n_missing_eos,
       CAST(SUM(length(CASE WHEN starts_with(text, '<s>') THEN '' ELSE '<s>' END || text
                || CASE WHEN ends_with(text, '</s>') THEN '' ELSE '</s>' END)) AS BIGINT) AS fixed_chars
FROM documents GROUP BY source""")
def q_special_token_audit(spark, sf_dir):
    return P.special_token_audit(table(spark, sf_dir, "documents"))


@register("validate_rows", f"""
SELECT COUNT(*) AS n_rows, COUNT_IF(prompt IS NULL) AS null_prompt, COUNT_IF(chosen IS NULL) AS null_chosen,
       COUNT_IF(rejected IS NULL) AS null_rejected,
       COUNT_IF(COALESCE({sql_strip('prompt')} = '', false)) AS blank_prompt,
       COUNT_IF(COALESCE({sql_strip('chosen')} = '', false)) AS blank_chosen,
       COUNT_IF(COALESCE({sql_strip('rejected')} = '', false)) AS blank_rejected,
       COUNT_IF(chosen = rejected) AS same_pair
FROM pref""", ["pref"])
def q_validate_rows(spark, sf_dir):
    return P.validate_rows(Views(spark, sf_dir).pref())


@register("quarantine_rows", f"""
WITH r AS (SELECT row_id, CASE WHEN prompt IS NULL THEN 'null prompt' WHEN chosen IS NULL THEN 'null chosen'
                  WHEN rejected IS NULL THEN 'null rejected' WHEN {sql_strip('prompt')} = '' THEN 'blank prompt'
                  WHEN {sql_strip('chosen')} = '' THEN 'blank chosen' WHEN {sql_strip('rejected')} = '' THEN 'blank rejected'
                  WHEN chosen = rejected THEN 'same pair' END AS reason FROM pref)
SELECT * FROM r WHERE reason IS NOT NULL""", ["pref"])
def q_quarantine_rows(spark, sf_dir):
    return P.quarantine(Views(spark, sf_dir).pref()).select("row_id", "reason")


@register("clear_nan_logprobs", """
SELECT seq_id, pos, CASE WHEN token_id % 7 <> 3 THEN logp END AS logp, ref_logp FROM seq""", ["seq"])
def q_clear_nan_logprobs(spark, sf_dir):
    s = Views(spark, sf_dir).seq()
    s = s.withColumn("logp", F.when(F.col("token_id") % 7 == 3, float("nan")).otherwise(F.col("logp")))
    return P.clear_nan_logprobs(s, ["logp", "ref_logp"]).select("seq_id", "pos", "logp", "ref_logp")


@register("input_form_audit", """
WITH g AS (SELECT text IS NOT NULL OR n_chars IS NOT NULL AS t, text IS NOT NULL AND n_chars IS NOT NULL AS tf,
                  lang IS NOT NULL OR source IS NOT NULL AS l, lang IS NOT NULL AND source IS NOT NULL AS lf FROM documents),
n AS (SELECT *, CAST(t AS INT) + CAST(l AS INT) AS n FROM g)
SELECT COUNT(*) AS n_rows, COUNT_IF(n = 0) AS no_form, COUNT_IF(n = 1) AS one_form, COUNT_IF(n > 1) AS several_forms,
       COUNT_IF(t AND NOT tf OR l AND NOT lf) AS incomplete, COUNT_IF(t) AS has_text, COUNT_IF(l) AS has_label FROM n""")
def q_input_form_audit(spark, sf_dir):
    return P.input_form_audit(table(spark, sf_dir, "documents"), {"text": ["text", "n_chars"], "label": ["lang", "source"]})


@register("nan_logprob_audit", """
SELECT seq_id % 4 AS source, COUNT(*) AS n,
       COUNT_IF(isnan(logp)) AS logp_nan, COUNT_IF(logp IS NULL) AS logp_null,
       COUNT_IF(isnan(ref_logp)) AS ref_logp_nan, COUNT_IF(ref_logp IS NULL) AS ref_logp_null
FROM seq GROUP BY 1""", ["seq"])
def q_nan_logprob_audit(spark, sf_dir):
    s = Views(spark, sf_dir).seq().withColumn("source", F.col("seq_id") % 4)
    return P.nan_logprob_audit(s, ["logp", "ref_logp"])

"""Queries for model application and text metrics (U3, M1-M6) and the
flagship evaluation report."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import clean_text
from ..operators import prompt as P
from ..operators import report as R
from ..operators import split as S
from ..operators import textmetric as TM
from ..operators.apply import STUB_MODELS, batch_apply_model, stub_embedder, stub_reward, stub_token_vectors, with_model_output
from ..sources.views import Views, table
from .catalog import register
from .q_data import sql_head, sql_md5, sql_strip

MODELS = ("half", "echo", "mix")


def generate(instr, models=STUB_MODELS):
    """instr rows -> inference prompt -> (row_id, model, generated, latency_s)."""
    prompts = P.format_infer_prompt(instr)
    return batch_apply_model(prompts, models, input_cols=("prompt", "instruction", "response"))


def predictions(instr, models=STUB_MODELS):
    """Generated text with the prompt prefix stripped, next to the cleaned
    instruction and reference (the long ``preds`` shape)."""
    gen = generate(instr, models)
    prompts = P.format_infer_prompt(instr).select("row_id", "prompt", "instruction", "response")
    joined = gen.join(prompts, "row_id")
    out = P.strip_prompt_prefix(joined, text="generated", prompt="prompt", out="prediction")
    return out.select("row_id", "model", clean_text("instruction").alias("instruction"),
                      clean_text("response").alias("reference"), "prediction", "latency_s")


def flagship_report(spark, sf_dir, n=50):
    instr = S.seeded_sample_n(Views(spark, sf_dir).instr(), n)
    preds = predictions(instr)
    return TM.model_report(scored(preds))


def scored(preds, use_stemmer=True):
    """BLEU, ROUGE-L and BERTScore of every prediction."""
    return TM.bert_score_texts(TM.rouge_l(TM.sentence_bleu(preds), use_stemmer=use_stemmer), stub_token_vectors)


_GEN_SQL = f"""
SELECT i.row_id, m.model, {sql_head()} || CASE m.model
    WHEN 'half' THEN SUBSTR(i.response, 1, CAST(FLOOR(LENGTH(i.response) / 2.0) AS INT))
    WHEN 'echo' THEN i.instruction
    ELSE SUBSTR(i.response, 1, 60) || ' ' || i.instruction END AS generated
FROM instr i CROSS JOIN (SELECT 'half' AS model UNION ALL SELECT 'echo' UNION ALL SELECT 'mix') m"""


@register("batch_apply_model", _GEN_SQL, ["instr"])
def q_batch_apply_model(spark, sf_dir):
    return generate(Views(spark, sf_dir).instr()).select("row_id", "model", "generated")


_WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@register("apply_embedding_model", f"""
WITH w AS (SELECT conv_id, turn, role, {_WORDS_SQL} AS words FROM conversations)
SELECT conv_id, turn, role, """ + ", ".join(
    f"CAST(len(list_filter(words, lambda x: length(x) % 4 = {i})) AS DOUBLE) AS e{i}" for i in range(4)) + """
FROM w""")
def q_apply_embedding_model(spark, sf_dir):
    # an array output, written once and joined back to the rows
    turns = table(spark, sf_dir, "conversations").withColumn("row_id", F.concat_ws(":", "conv_id", "turn"))
    out = with_model_output(turns, "words", stub_embedder(4), out="e", out_type=T.ArrayType(T.DoubleType()))
    return out.select("conv_id", "turn", "role", *[F.col("e")[i].alias(f"e{i}") for i in range(4)])


@register("apply_reward_model", f"""
WITH w AS (SELECT doc_id, source, {_WORDS_SQL} AS words FROM documents)
SELECT doc_id, source, CASE WHEN len(words) = 0 THEN 0.0
       ELSE CAST(list_sum(list_transform(words, lambda x: length(x))) AS DOUBLE) / len(words) END AS reward
FROM w""")
def q_apply_reward_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = with_model_output(docs, "reward", stub_reward, id_col="doc_id", out="reward", out_type=T.DoubleType())
    return out.select("doc_id", "source", "reward")


@register("strip_prompt_prefix", "SELECT row_id, model, instruction, reference, prediction FROM preds",
          ["preds"])
def q_strip_prompt_prefix(spark, sf_dir):
    return predictions(Views(spark, sf_dir).instr()).drop("latency_s")


def _tok_sql(x):
    return f"list_filter(string_split_regex({sql_strip(x)}, '\\s+'), lambda t: t <> '')"


def _grams_sql(col):
    return f"""SELECT row_id, model, ns.n, array_to_string({col}[i:i + ns.n - 1], ' ') AS gram, COUNT(*) AS cnt
       FROM base, ns, LATERAL (SELECT unnest(range(1, len({col}) - ns.n + 2)) AS i)
       GROUP BY ALL"""


BLEU_SQL = f"""
WITH base AS (SELECT row_id, model, {_tok_sql('prediction')} AS p, {_tok_sql('reference')} AS r FROM preds),
ns AS (SELECT unnest([1, 2, 3, 4]) AS n),
pg AS ({_grams_sql('p')}),
rg AS ({_grams_sql('r')}),
clip AS (SELECT pg.row_id, pg.model, pg.n, SUM(LEAST(pg.cnt, COALESCE(rg.cnt, 0))) AS num
         FROM pg LEFT JOIN rg ON pg.row_id = rg.row_id AND pg.model = rg.model AND pg.n = rg.n AND pg.gram = rg.gram
         GROUP BY ALL),
per AS (SELECT b.row_id, b.model, ns.n, len(b.p) AS c, len(b.r) AS rl,
               CAST(COALESCE(clip.num, 0) AS DOUBLE) AS num, CAST(GREATEST(1, len(b.p) - ns.n + 1) AS DOUBLE) AS den
        FROM base b CROSS JOIN ns LEFT JOIN clip ON clip.row_id = b.row_id AND clip.model = b.model AND clip.n = ns.n),
agg AS (SELECT row_id, model, ANY_VALUE(c) AS c, ANY_VALUE(rl) AS rl, SUM(CASE WHEN n = 1 THEN num END) AS num1,
               SUM(LN(CASE WHEN num > 0 THEN num / den ELSE 0.1 / den END)) AS slog FROM per GROUP BY ALL)
SELECT row_id, model, CASE WHEN c = 0 OR num1 = 0 THEN 0.0
       ELSE (CASE WHEN c > rl THEN 1.0 ELSE EXP(1.0 - rl / c) END) * EXP(slog / 4) END AS bleu
FROM agg"""


@register("sentence_bleu", BLEU_SQL, ["preds"])
def q_sentence_bleu(spark, sf_dir):
    return TM.sentence_bleu(Views(spark, sf_dir).preds()).select("row_id", "model", "bleu")


# LCS as a recursive CTE: one DP row per reference token, the running
# maximum along the prediction tokens by a window (oracle side only).
ROUGE_L_SQL = r"""
WITH RECURSIVE
t AS (SELECT row_id, model, regexp_extract_all(lower(prediction), '[a-z0-9]+') AS p,
             regexp_extract_all(lower(reference), '[a-z0-9]+') AS r FROM preds),
pt AS (SELECT row_id, model, unnest(p) AS tok, unnest(range(1, len(p) + 1)) AS j FROM t),
rt AS (SELECT row_id, model, unnest(r) AS tok, unnest(range(1, len(r) + 1)) AS i FROM t),
dp(row_id, model, i, j, v) AS (
  SELECT row_id, model, 0, j, 0 FROM pt
  UNION ALL
  SELECT row_id, model, i, j, MAX(c) OVER (PARTITION BY row_id, model ORDER BY j ROWS UNBOUNDED PRECEDING)
  FROM (SELECT d.row_id, d.model, d.i + 1 AS i, d.j,
               GREATEST(d.v, CASE WHEN pt.tok = rt.tok
                    THEN COALESCE(LAG(d.v) OVER (PARTITION BY d.row_id, d.model ORDER BY d.j), 0) + 1 ELSE 0 END) AS c
        FROM dp d JOIN pt ON pt.row_id = d.row_id AND pt.model = d.model AND pt.j = d.j
        JOIN rt ON rt.row_id = d.row_id AND rt.model = d.model AND rt.i = d.i + 1) s),
lcs AS (SELECT row_id, model, MAX(v) AS lcs FROM dp GROUP BY row_id, model)
SELECT t.row_id, t.model, CASE WHEN COALESCE(l.lcs, 0) = 0 THEN 0.0
       ELSE 2 * (l.lcs / len(t.p)) * (l.lcs / len(t.r)) / (l.lcs / len(t.p) + l.lcs / len(t.r)) END AS rouge_l
FROM t LEFT JOIN lcs l USING (row_id, model)"""


@register("rouge_l", ROUGE_L_SQL, ["preds"])
def q_rouge_l(spark, sf_dir):
    # checked without the stemmer (SQL has none); the stemmed form used by
    # model_report and the flagship is tested against the paper's examples
    return TM.rouge_l(Views(spark, sf_dir).preds(), use_stemmer=False).select("row_id", "model", "rouge_l")


@register("bert_score", """
WITH t AS (SELECT vec_id, example_id, side, CAST(embedding AS DOUBLE[]) AS e FROM emb_tokens),
b AS (SELECT a.example_id, a.side, a.vec_id, MAX(list_cosine_similarity(a.e, o.e)) AS best
      FROM t a JOIN t o ON a.example_id = o.example_id AND a.side <> o.side GROUP BY ALL),
s AS (SELECT example_id, AVG(CASE WHEN side = 'pred' THEN best END) AS bert_p,
             AVG(CASE WHEN side = 'ref' THEN best END) AS bert_r FROM b GROUP BY example_id)
SELECT example_id, bert_p, bert_r, 2 * bert_p * bert_r / (bert_p + bert_r) AS bert_f1 FROM s""", ["emb_tokens"])
def q_bert_score(spark, sf_dir):
    return TM.bert_score(Views(spark, sf_dir).emb_tokens())


# the token vectors of stub_token_vectors, and their best cosines per token
BERT_TEXTS_SQL = f"""
WITH base AS (SELECT row_id, model, {_tok_sql('prediction')} AS p, {_tok_sql('reference')} AS r FROM preds),
pt AS (SELECT row_id, model, tok, COUNT(*) AS c FROM (SELECT row_id, model, unnest(p) AS tok FROM base) GROUP BY ALL),
rt AS (SELECT row_id, model, tok, COUNT(*) AS c FROM (SELECT row_id, model, unnest(r) AS tok FROM base) GROUP BY ALL),
v AS (SELECT tok, [{", ".join(f"('0x' || substr(md5(tok), {1 + 4 * k}, 4))::BIGINT / 65535.0::DOUBLE - 0.5" for k in range(8))}]::DOUBLE[] AS e
      FROM (SELECT tok FROM pt UNION SELECT tok FROM rt)),
m AS (SELECT pt.row_id, pt.model, pt.tok AS pt, rt.tok AS rt, pt.c AS pc, rt.c AS rc, list_cosine_similarity(a.e, b.e) AS s
      FROM pt JOIN rt ON pt.row_id = rt.row_id AND pt.model = rt.model JOIN v a ON a.tok = pt.tok JOIN v b ON b.tok = rt.tok),
bp AS (SELECT row_id, model, SUM(pc * s) / SUM(pc) AS bert_p
       FROM (SELECT row_id, model, pt, ANY_VALUE(pc) AS pc, MAX(s) AS s FROM m GROUP BY row_id, model, pt) GROUP BY ALL),
br AS (SELECT row_id, model, SUM(rc * s) / SUM(rc) AS bert_r
       FROM (SELECT row_id, model, rt, ANY_VALUE(rc) AS rc, MAX(s) AS s FROM m GROUP BY row_id, model, rt) GROUP BY ALL)
SELECT b.row_id, b.model, COALESCE(bert_p, 0.0) AS bert_p, COALESCE(bert_r, 0.0) AS bert_r,
       COALESCE(2 * bert_p * bert_r / (bert_p + bert_r), 0.0) AS bert_f1
FROM base b LEFT JOIN bp ON b.row_id = bp.row_id AND b.model = bp.model LEFT JOIN br ON b.row_id = br.row_id AND b.model = br.model"""


@register("bert_score_texts", BERT_TEXTS_SQL, ["preds"])
def q_bert_score_texts(spark, sf_dir):
    return TM.bert_score_texts(Views(spark, sf_dir).preds(), stub_token_vectors).select("row_id", "model", "bert_p", "bert_r", "bert_f1")


@register("model_report")
def q_model_report(spark, sf_dir):
    return TM.model_report(scored(Views(spark, sf_dir).preds()))


@register("model_report_unstemmed", f"""
SELECT b.model, AVG(b.bleu) AS bleu, AVG(r.rouge_l) AS rouge_l, AVG(t.bert_f1) AS bert_f1, COUNT(*) AS n
FROM ({BLEU_SQL}) b JOIN ({ROUGE_L_SQL}) r ON r.row_id = b.row_id AND r.model = b.model
JOIN ({BERT_TEXTS_SQL}) t ON t.row_id = b.row_id AND t.model = b.model
GROUP BY b.model""", ["preds"])
def q_model_report_unstemmed(spark, sf_dir):
    return TM.model_report(scored(Views(spark, sf_dir).preds(), use_stemmer=False))


@register("merge_outputs_wide", """
SELECT row_id, instruction, reference,
       MAX(CASE WHEN model = 'half' THEN prediction END) AS half,
       MAX(CASE WHEN model = 'echo' THEN prediction END) AS echo,
       MAX(CASE WHEN model = 'mix' THEN prediction END) AS mix
FROM preds GROUP BY row_id, instruction, reference""", ["preds"])
def q_merge_outputs_wide(spark, sf_dir):
    return R.merge_outputs_wide(Views(spark, sf_dir).preds(), MODELS)


def _review_cols():
    cols = []
    for m in MODELS:
        cols.append(f"MAX(CASE WHEN model = '{m}' THEN prediction END) AS {m}")
        cols += [f"'' AS \"{m}_{c} (1-5)\"" for c in R.CRITERIA]
    return ",\n       ".join(cols)


@register("review_table", f"""
WITH ids AS (SELECT row_id FROM (SELECT DISTINCT row_id FROM preds) d ORDER BY {sql_md5(42, 'row_id')}, row_id LIMIT 5)
SELECT row_id, instruction, reference,
       {_review_cols()}
FROM preds WHERE row_id IN (SELECT row_id FROM ids) GROUP BY row_id, instruction, reference""", ["preds"])
def q_review_table(spark, sf_dir):
    return R.review_table(Views(spark, sf_dir).preds(), MODELS)


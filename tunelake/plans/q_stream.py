"""Queries for the streaming operators (S10, X1-X4). Each drains the
driver's parquet table as an unbounded source (``availableNow``) and reads
the sink back, so the oracle compares the stream result with the batch
semantics."""

from __future__ import annotations

from ..streaming import jobs as X
from .catalog import register
from .q_data import sql_clean, sql_hex8
from .q_tokens import sql_hashed, sql_ws


@register("stream_source", "SELECT conv_id, turn, role, text FROM conversations")
def q_stream_source(spark, sf_dir):
    return X.stream_source_copy(spark, sf_dir).select("conv_id", "turn", "role", "text")


@register("stream_prep", f"""
WITH c AS (SELECT conv_id, turn, {sql_clean('text')} AS text, conv_id * 100 + turn AS k FROM conversations),
b AS (SELECT *, {sql_hex8("md5('42:' || CAST(k AS VARCHAR))")} % 1000 AS bucket FROM c)
SELECT conv_id, turn, text, bucket,
       CASE WHEN bucket < 800 THEN 'train' WHEN bucket < 900 THEN 'dev' ELSE 'test' END AS split,
       CAST(len({sql_hashed(sql_ws('text'))}) AS INT) AS n_tokens
FROM b""")
def q_stream_prep(spark, sf_dir):
    return X.stream_prep(spark, sf_dir).select("conv_id", "turn", "text", "bucket", "split", "n_tokens")


@register("stream_step_metrics", """
WITH s AS (SELECT event_id AS step, ln(value + 1) AS loss FROM events WHERE event_id >= 1),
g AS (SELECT (step - 1) // 50 AS w, SUM(loss) AS s, COUNT(*) AS n FROM s GROUP BY 1)
SELECT CAST((w + 1) * 50 AS BIGINT) AS log_step, ROUND(s / n, 4) AS loss FROM g
WHERE (w + 1) * 50 <= (SELECT MAX(step) FROM s)""")
def q_stream_step_metrics(spark, sf_dir):
    return X.stream_step_metrics(spark, sf_dir)


@register("stream_running_delta", """
WITH r AS (SELECT CAST(FLOOR(l_orderkey / 100.0) AS BIGINT) AS batch_id,
                  0.1 * (ln(0.05 + l_discount) - ln(0.05 + l_tax)) AS reward FROM lineitem),
b AS (SELECT batch_id, SUM(reward) AS s, COUNT(*) AS n FROM r GROUP BY batch_id)
SELECT batch_id, SUM(s) OVER (ORDER BY batch_id) / SUM(n) OVER (ORDER BY batch_id) AS delta FROM b""")
def q_stream_running_delta(spark, sf_dir):
    return X.stream_running_delta(spark, sf_dir)


@register("stream_per_prompt_stats", """
WITH b AS (SELECT event_id, user_id AS prompt_id, event_id // 1000 AS batch_id, ln(value + 1) AS reward,
                  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events),
e AS (SELECT prompt_id, batch_id, MAX(k) AS kk FROM b GROUP BY 1, 2),
buf AS (SELECT e.prompt_id, e.batch_id, ANY_VALUE(e.kk) AS kk, AVG(b.reward) AS pm, STDDEV_POP(b.reward) AS ps
        FROM e JOIN b ON b.prompt_id = e.prompt_id AND b.k BETWEEN e.kk - 15 AND e.kk GROUP BY 1, 2),
g AS (SELECT batch_id, AVG(reward) AS gm, STDDEV_POP(reward) AS gs FROM b GROUP BY 1)
SELECT b.event_id, CASE WHEN buf.kk + 1 >= 16 THEN (b.reward - buf.pm) / (buf.ps + 1e-6)
                        ELSE (b.reward - g.gm) / (g.gs + 1e-6) END AS advantage,
       buf.kk + 1 >= 16 AS used_prompt_stats
FROM b JOIN buf USING (prompt_id, batch_id) JOIN g USING (batch_id)""")
def q_stream_per_prompt_stats(spark, sf_dir):
    return X.stream_per_prompt_stats(spark, sf_dir)

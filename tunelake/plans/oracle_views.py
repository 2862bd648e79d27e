"""The fixture views as DuckDB SQL, for the oracle side of the correctness
check. ``with_views(sql, ...)`` prefixes a query with the CTEs it needs."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "instr": ((), """
SELECT conv_id * 100 + turn AS row_id, conv_id, instruction, context, response
FROM (SELECT conv_id, turn, role, text AS instruction,
             LEAD(text) OVER (PARTITION BY conv_id ORDER BY turn) AS response,
             LEAD(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
             COALESCE(MAX(CASE WHEN role = 'system' THEN text END) OVER (PARTITION BY conv_id), '') AS context
      FROM conversations) t
WHERE role = 'user' AND next_role = 'assistant'"""),
    "preds": (("instr",), """
SELECT i.row_id, m.model,
       TRIM(TRANSLATE(i.instruction, CHR(10) || CHR(13), '  ')) AS instruction,
       TRIM(TRANSLATE(i.response, CHR(10) || CHR(13), '  ')) AS reference,
       TRIM(TRANSLATE(CASE m.model
            WHEN 'half' THEN SUBSTR(i.response, 1, CAST(FLOOR(LENGTH(i.response) / 2.0) AS INT))
            WHEN 'echo' THEN i.instruction
            ELSE SUBSTR(i.response, 1, 60) || ' ' || i.instruction END, CHR(10) || CHR(13), '  ')) AS prediction
FROM instr i CROSS JOIN (SELECT 'half' AS model UNION ALL SELECT 'echo' UNION ALL SELECT 'mix') m"""),
    "pref": (("instr",), """
SELECT row_id, instruction AS prompt, response AS chosen,
       COALESCE(LEAD(response) OVER (ORDER BY row_id), instruction) AS rejected
FROM instr"""),
    "unpaired": (("pref",), """
SELECT row_id * 2 AS row_id, prompt, chosen AS completion, TRUE AS label FROM pref
UNION ALL
SELECT row_id * 2 + 1, prompt, rejected, FALSE FROM pref"""),
    "steps": ((), """
SELECT conv_id, turn AS step, text AS completion, CAST(LENGTH(text) % 2 AS BIGINT) AS label
FROM conversations WHERE role = 'assistant'"""),
    "seq": ((), """
SELECT l_orderkey AS seq_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                                              l_quantity, l_discount, l_tax) - 1 AS BIGINT) AS pos,
       CAST(l_partkey % 1000 AS BIGINT) AS token_id,
       LN(0.05 + l_discount) AS logp, LN(0.05 + l_tax) AS ref_logp,
       LN(l_quantity + 1) / 4 AS val, LN(o_totalprice) - 11 AS score
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "pair_logp": ((), """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       LN(0.05 + l_discount) AS chosen_logp, LN(0.05 + l_tax) AS rejected_logp,
       LN(l_quantity + 1) / 10 AS margin
FROM lineitem"""),
    "unp_logp": ((), """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CAST(FLOOR(l_orderkey / 100.0) AS BIGINT) AS batch_id,
       LN(0.05 + l_discount) AS policy_logp, LN(0.05 + l_tax) AS reference_logp,
       LN(l_quantity / 60) AS policy_kl_logp, LN((51 - l_quantity) / 60) AS reference_kl_logp,
       l_returnflag <> 'R' AS label
FROM lineitem"""),
    "steplog": ((), """
SELECT event_id AS step, CAST(FLOOR(event_id / 100.0) AS BIGINT) AS epoch, user_id % 4 AS inner_epoch,
       event_type AS metric, LN(value + 1) AS val, ts,
       CASE WHEN event_id % 10 = 0 THEN 'eval' ELSE 'train' END AS mode
FROM events"""),
    "emb_tokens": ((), """
SELECT vec_id, CAST(FLOOR(vec_id / 10.0) AS BIGINT) AS example_id,
       CASE WHEN vec_id % 10 < 5 THEN 'pred' ELSE 'ref' END AS side, embedding, label < 5 AS desirable
FROM embeddings"""),
    "bench": ((), """
SELECT event_id, event_type AS model, user_id AS prompt_id, value AS latency_s,
       CAST(json_extract(props, '$.k') AS BIGINT) AS gen_tokens, LN(value + 1) AS reward, ts
FROM events"""),
    "grid": ((), """
SELECT r.r, f.f * r.r AS alpha, l.lr, l.lr_tag,
       'r' || CAST(r.r AS STRING) || '_a' || CAST(f.f * r.r AS STRING) || '_lr' || l.lr_tag AS run
FROM (SELECT 8 AS r UNION ALL SELECT 16 UNION ALL SELECT 32) r
CROSS JOIN (SELECT 1 AS f UNION ALL SELECT 2) f
CROSS JOIN (SELECT CAST(0.0001 AS DOUBLE) AS lr, '00001' AS lr_tag UNION ALL SELECT CAST(0.0002 AS DOUBLE), '00002') l"""),
    "grid_runs": (("grid",), """
SELECT g.run, g.r, g.alpha, g.lr, p.toolkit, p.eval_loss, p.time_min, p.peak_vram
FROM (SELECT run, r, alpha, lr, CASE r WHEN 8 THEN 0 WHEN 16 THEN 4 ELSE 8 END
             + CASE WHEN alpha = r THEN 0 ELSE 2 END + CASE lr_tag WHEN '00001' THEN 0 ELSE 1 END AS idx FROM grid) g
JOIN (SELECT p_partkey % 12 AS idx, CASE WHEN CAST(FLOOR(p_partkey / 12.0) AS BIGINT) % 2 = 0 THEN 'U' ELSE 'P' END AS toolkit,
             AVG(LN(p_retailprice)) AS eval_loss, MAX(LN(p_size + 1.0)) AS time_min, MIN(LN(p_retailprice)) AS peak_vram
      FROM part GROUP BY 1, 2) p ON g.idx = p.idx"""),
    "conv_msgs": ((), """
SELECT conv_id, list({'turn': turn, 'role': role, 'content': text} ORDER BY turn) AS messages
FROM conversations GROUP BY conv_id"""),
}


def _order(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        if n in seen:
            return
        for d in VIEWS[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with CTEs for ``names`` (and what they depend on).
    If ``sql`` itself starts with WITH, its CTEs are appended after ours."""
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in _order(names))
    import re

    body = sql.strip()
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if m:
        head = "WITH RECURSIVE" if m.group(1) else "WITH"
        return f"{head} {ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"

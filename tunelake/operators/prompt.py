"""Projections, templates and text cleaning (P*). Built-in string, array and
higher-order functions only."""

from __future__ import annotations

import re
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clean_text, is_blank, strip_ws

# The instruction prompt layout of the tuned models.
INSTRUCTION_HEADER = "### Instruction:\n"
CONTEXT_HEADER = "### Context:\n"
RESPONSE_HEADER = "### Response:\n"
BLOCK_SEP = "\n\n"

# Default chat template (ChatML-style markers); any template is a parameter.
CHAT_TEMPLATE = {
    "start": "<|im_start|>",
    "end": "<|im_end|>\n",
    "role_sep": "\n",
    "generation_prompt": "<|im_start|>assistant\n",
    "head": "",
    "tools_start": "<|im_start|>tools\n",
    "tool_sep": "\n",
    "tools_end": "<|im_end|>\n",
}


def _prompt_head(instruction: str, context: str):
    with_ctx = F.concat(F.lit(INSTRUCTION_HEADER), F.col(instruction), F.lit(BLOCK_SEP),
                        F.lit(CONTEXT_HEADER), F.col(context), F.lit(BLOCK_SEP),
                        F.lit(RESPONSE_HEADER))
    without = F.concat(F.lit(INSTRUCTION_HEADER), F.col(instruction), F.lit(BLOCK_SEP),
                       F.lit(RESPONSE_HEADER))
    return F.when(is_blank(context), without).otherwise(with_ctx)


def format_train_prompt(df: DataFrame, instruction="instruction", context="context",
                        response="response", out="text") -> DataFrame:
    """Instruction/context/response -> one training text. The context block
    appears only when the context is not blank; the context itself is kept
    as is."""
    return df.withColumn(out, F.concat(_prompt_head(instruction, context), F.col(response)))


def format_infer_prompt(df: DataFrame, instruction="instruction", context="context",
                        out="prompt") -> DataFrame:
    """Same layout, ending right after the response header."""
    return df.withColumn(out, _prompt_head(instruction, context))


def strip_prompt_prefix(df: DataFrame, text="generated", prompt="prompt", out=None) -> DataFrame:
    """Drop ``len(prompt)`` leading characters of the generated text, then
    strip and clean it."""
    cut = F.expr(f"substring({text}, length({prompt}) + 1)")
    return df.withColumn(out or text, clean_text(cut))


def messages_from_turns(turns: DataFrame, conv="conv_id", turn="turn", role="role",
                        text="text", out="messages") -> DataFrame:
    """Turn rows -> one ordered message array per conversation. A message
    array is a row value, so its size is bounded by one conversation."""
    agg = turns.groupBy(conv).agg(
        F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"),
                                             F.col(text).alias("content")))).alias("_m"))
    return agg.select(conv, F.transform("_m", lambda m: F.struct(
        m["role"].alias("role"), m["content"].alias("content"))).alias(out))


_PLACE = re.compile(r"\{(\w+)\}")


def _filled(text: str, args):
    """A template text with ``{name}`` places as a column: each is the row's argument of that name, '' without one."""
    if args is None:
        return F.lit(text)
    parts = _PLACE.split(text)  # literals and names take turns
    return F.concat(*[F.coalesce(F.try_element_at(args, F.lit(p)), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)])


def render_messages(messages, template=None, add_generation_prompt=False, args=None, tools=None):
    """Column expression: message array -> one string.

    ``args``: a map column of per-row arguments, which fill the template's
    ``{name}`` places; ``tools``: an array column of tool descriptions, laid
    between ``tools_start`` and ``tools_end`` before the messages of rows that
    have any; ``add_generation_prompt``: a constant or a boolean column. All
    of it compiles to one expression, so rows may differ in one plan."""
    t = dict(CHAT_TEMPLATE, **(template or {}))
    head = _filled(t["head"], args) if t["head"] else None
    body = F.array_join(F.transform(messages, lambda m: F.concat(
        _filled(t["start"], args), m["role"], _filled(t["role_sep"], args), m["content"], _filled(t["end"], args))), "")
    if tools is not None:
        listed = F.concat(_filled(t["tools_start"], args), F.array_join(tools, t["tool_sep"]), _filled(t["tools_end"], args))
        body = F.concat(F.when(F.coalesce(F.size(tools), F.lit(0)) > 0, listed).otherwise(""), body)
    if head is not None:
        body = F.concat(head, body)
    if isinstance(add_generation_prompt, Column):
        body = F.concat(body, F.when(add_generation_prompt, _filled(t["generation_prompt"], args)).otherwise(""))
    elif add_generation_prompt:
        body = F.concat(body, _filled(t["generation_prompt"], args))
    return body


def apply_chat_template(df: DataFrame, messages="messages", out="text", template=None,
                        add_generation_prompt=False, args: str | None = None, tools: str | None = None) -> DataFrame:
    """``args`` and ``tools`` name the columns of per-row template arguments
    (a map of strings) and tools (an array of strings, or JSON text of an
    array); without a template of their own, tools precede the messages."""
    listed = None
    if tools is not None:
        kind = df.schema[tools].dataType.simpleString()
        listed = F.from_json(tools, "array<string>") if kind == "string" else F.col(tools)
    return df.withColumn(out, render_messages(F.col(messages), template, add_generation_prompt,
                                              F.col(args) if args else None, listed))


def split_last_turn(df: DataFrame, messages="messages", template=None) -> DataFrame:
    """Conversation -> prompt messages (all but the last) and completion (the
    last message), both rendered; ``prompt_chars`` lets generated positions
    be sliced by prompt length later."""
    m = F.col(messages)
    prompts = F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0)))
    last = F.array(F.element_at(m, -1))
    return (df.withColumn("prompt_text", render_messages(prompts, template, add_generation_prompt=False))
            .withColumn("completion_text", render_messages(last, template))
            .withColumn("completion_role", F.element_at(m, -1)["role"])
            .withColumn("prompt_chars", F.length("prompt_text")))


def format_profile(df: DataFrame, source="source") -> DataFrame:
    """Classify every row of a mixed corpus by its input form and count per
    (format, source). Precedence: labels > input_ids > prompt+completion >
    text > needs a formatter; 'conversational' when the value is a message
    list."""
    cols = set(df.columns)

    def has(c):
        return F.col(c).isNotNull() if c in cols else F.lit(False)

    fmt = (F.when(has("labels"), "labels")
           .when(has("input_ids"), "tokenized")
           .when(has("prompt_messages") & has("completion_messages"), "prompt_completion_conversational")
           .when(has("prompt") & has("completion"), "prompt_completion")
           .when(has("messages"), "conversational")
           .when(has("text"), "language_modeling")
           .otherwise("needs_formatter"))
    return df.withColumn("format", fmt).groupBy("format", source).agg(
        F.count(F.lit(1)).alias("n"))


def common_prefix_len(a, b):
    """Length of the longest common character prefix of two strings."""
    a, b = F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b
    eq = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    pos = F.array_position(eq, False)
    short = F.least(F.length(a), F.length(b))
    return F.when(pos == 0, short).otherwise(F.least(pos - 1, short)).cast("int")


def common_message_prefix(a, b):
    """Number of equal leading messages of two message arrays."""
    a, b = F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b
    eq = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    pos = F.array_position(eq, False)
    short = F.least(F.size(a), F.size(b))
    return F.when(pos == 0, short).otherwise(F.least(pos - 1, short)).cast("int")


def extract_prompt(df: DataFrame, chosen="chosen", rejected="rejected") -> DataFrame:
    """Implicit prompt: the shared leading characters (strings) or messages
    (message arrays) of chosen and rejected become ``prompt``; the
    remainders stay. Rows are passed through when ``prompt`` exists."""
    if "prompt" in df.columns:
        return df
    kind = df.schema[chosen].dataType.simpleString()
    if kind.startswith("array"):
        k = common_message_prefix(chosen, rejected)
        return (df.withColumn("_k", k)
                .withColumn("prompt", F.slice(chosen, 1, F.col("_k")))
                .withColumn(chosen, F.expr(f"slice({chosen}, _k + 1, size({chosen}))"))
                .withColumn(rejected, F.expr(f"slice({rejected}, _k + 1, size({rejected}))"))
                .drop("_k"))
    k = common_prefix_len(chosen, rejected)
    return (df.withColumn("_k", k)
            .withColumn("prompt", F.expr(f"substring({chosen}, 1, _k)"))
            .withColumn(chosen, F.expr(f"substring({chosen}, _k + 1)"))
            .withColumn(rejected, F.expr(f"substring({rejected}, _k + 1)"))
            .drop("_k"))


def unpair_preferences(df: DataFrame, id_col="row_id", prompt="prompt", chosen="chosen",
                       rejected="rejected") -> DataFrame:
    """One paired row -> (prompt, chosen, true) and (prompt, rejected, false).
    Already unpaired input (has ``label``) passes through."""
    if "label" in df.columns and "completion" in df.columns:
        return df
    e = df.select(id_col, prompt, F.explode(F.array(
        F.struct(F.col(chosen).alias("completion"), F.lit(True).alias("label")),
        F.struct(F.col(rejected).alias("completion"), F.lit(False).alias("label")))).alias("_u"))
    return e.select(id_col, prompt, "_u.completion", "_u.label")


def special_token_audit(df: DataFrame, text="text", source="source", bos="<s>",
                        eos="</s>") -> DataFrame:
    """Per source: rows already starting with BOS, rows lacking EOS, and the
    size of the corrected text (BOS prepended / EOS appended once)."""
    t = F.coalesce(F.col(text), F.lit(""))
    has_bos = t.startswith(bos)
    has_eos = t.endswith(eos)
    fixed = F.concat(F.when(has_bos, F.lit("")).otherwise(F.lit(bos)), t,
                     F.when(has_eos, F.lit("")).otherwise(F.lit(eos)))
    return df.groupBy(source).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(has_bos).alias("n_start_bos"),
        F.count_if(~has_eos).alias("n_missing_eos"),
        F.sum(F.length(fixed)).cast("bigint").alias("fixed_chars"))


def require_strings(df: DataFrame, cols, lists=()) -> DataFrame:
    """``df`` itself if ``cols`` are strings and ``lists`` arrays of strings, else a TypeError that names all misfits."""
    types = dict(df.dtypes)
    wrong = [f"{c} is {types[c]}, not {want}" for names, want in ((cols, "string"), (lists, "array<string>"))
             for c in names if types[c] != want]
    if wrong:
        raise TypeError("; ".join(wrong))
    return df


def input_form_audit(df: DataFrame, forms: dict[str, list[str]], group=None) -> DataFrame:
    """Rows by the input forms they give. A form is given if one of its
    columns is not null, and complete if all are: each row should give one
    form, completely. Counts of rows with none, one and several, of rows with
    an incomplete one, and of each form."""
    given = {f: reduce(or_, [F.col(c).isNotNull() for c in cols]) for f, cols in forms.items()}
    full = {f: reduce(and_, [F.col(c).isNotNull() for c in cols]) for f, cols in forms.items()}
    n = reduce(add, [g.cast("int") for g in given.values()])
    incomplete = reduce(or_, [given[f] & ~full[f] for f in forms])
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_if(n == 0).alias("no_form"), F.count_if(n == 1).alias("one_form"),
            F.count_if(n > 1).alias("several_forms"), F.count_if(incomplete).alias("incomplete"),
            *[F.count_if(g).alias(f"has_{f}") for f, g in given.items()]]
    return df.groupBy(group).agg(*aggs) if group else df.agg(*aggs)


def validate_rows(df: DataFrame, prompt="prompt", chosen="chosen", rejected="rejected") -> DataFrame:
    """One aggregate of violation counts for preference rows; a column that
    holds no strings is an error before any row is read."""
    require_strings(df, [prompt, chosen, rejected])

    def blank(c):
        return F.coalesce(strip_ws(F.col(c)) == "", F.lit(False))

    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(prompt).isNull()).alias("null_prompt"),
        F.count_if(F.col(chosen).isNull()).alias("null_chosen"),
        F.count_if(F.col(rejected).isNull()).alias("null_rejected"),
        F.count_if(blank(prompt)).alias("blank_prompt"),
        F.count_if(blank(chosen)).alias("blank_chosen"),
        F.count_if(blank(rejected)).alias("blank_rejected"),
        F.count_if(F.col(chosen) == F.col(rejected)).alias("same_pair"))


def quarantine(df: DataFrame, prompt="prompt", chosen="chosen", rejected="rejected") -> DataFrame:
    """The rows that ``validate_rows`` counts as violations, with the first reason that holds."""
    cols = {"prompt": prompt, "chosen": chosen, "rejected": rejected}
    reasons = [F.when(F.col(c).isNull(), f"null {n}") for n, c in cols.items()]
    reasons += [F.when(strip_ws(F.col(c)) == "", f"blank {n}") for n, c in cols.items()]
    reasons.append(F.when(F.col(chosen) == F.col(rejected), "same pair"))
    return df.withColumn("reason", F.coalesce(*reasons)).where(F.col("reason").isNotNull())


def clear_nan_logprobs(df: DataFrame, cols) -> DataFrame:
    """``df`` with null for NaN in ``cols``."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def nan_logprob_audit(df: DataFrame, cols, source="source") -> DataFrame:
    """NaN and null counts of log-prob columns per source (``clear_nan_logprobs`` makes NaN null)."""
    aggs = []
    for c in cols:
        aggs += [F.count_if(F.isnan(c)).alias(f"{c}_nan"),
                 F.count_if(F.col(c).isNull()).alias(f"{c}_null")]
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n"), *aggs)

"""Token and sequence jobs (K1-K14).

The tokeniser is a parameter. Two built-in defaults exist:
* ``vocab_ids`` - regex word tokens mapped through a frequency-ranked
  vocabulary built from the corpus itself (a relational job: explode, count,
  rank, join);
* ``hashed_ids`` - a stateless hashing tokeniser (52 bits of the md5 of the
  token), usable inside any expression and on streams.
Sequences are arrays per row (one row = one text, so an array is bounded by
the row); corpus-level work is aggregates and joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import IGNORE_INDEX
from ..functions.order import prefix_offsets
from ..functions.sizing import join_checked
from ..session import materialize
from .prompt import render_messages

WORD_PATTERN = r"[\p{L}\p{N}]+"
N_SPECIAL = 3  # ids 0 pad, 1 eos, 2 bos are reserved
PAD_ID, EOS_ID, BOS_ID = 0, 1, 2


def word_tokens(text):
    """Lower-cased runs of letters and numbers of any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), 0)


def ws_tokens(text):
    """Whitespace tokens (str.split())."""
    return F.filter(F.split(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+", ""),
                                             r"\s+$", ""), r"\s+"), lambda t: t != "")


def hashed_id(tok):
    # 13 hex digits: different words get different ids, and sums of a row's ids stay within a bigint
    return F.conv(F.substring(F.md5(tok), 1, 13), 16, 10).cast("bigint") + F.lit(N_SPECIAL)


def hashed_ids(tokens):
    return F.transform(tokens, lambda t: hashed_id(t))


# -- K1 ---------------------------------------------------------------------------

def build_vocab(docs: DataFrame, text="text", materialize_counts: bool = True, tokenizer=word_tokens) -> DataFrame:
    """(token, cnt, id): ids by frequency (desc), ties by token, after the
    reserved ids. Counting is a partial aggregate over all tokens of all
    texts; see ``rank_vocab``."""
    counts = (docs.select(F.explode(tokenizer(F.col(text))).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("cnt")))
    return rank_vocab(counts, materialize_counts)


def rank_vocab(counts: DataFrame, materialize_counts: bool = True) -> DataFrame:
    """(token, cnt, id) of (token, cnt): the counts are written once (an
    artefact in the shared checkpoint folder), so ranking and size checks
    read that small table instead of the corpus; the ranked vocabulary is
    written as well."""
    if materialize_counts:
        counts = materialize(counts, "token-counts")
    ranked = prefix_offsets(counts.withColumn("neg_cnt", -F.col("cnt")), ["neg_cnt", "token"], None,
                            offset_col="rank")
    vocab = ranked.select("token", (-F.col("neg_cnt")).alias("cnt"), (F.col("rank") + N_SPECIAL).alias("id"))
    return materialize(vocab, "vocab") if materialize_counts else vocab


#: Tokens of the texts that share one dictionary.
CHUNK_TOKENS = 1 << 20


def dictionary_chunks(rows: DataFrame, max_length: int, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row per chunk of about ``chunk_tokens`` tokens of ``rows`` (any
    columns, the last one a token array): the chunk's distinct ``tokens`` with
    their ``counts``, and its rows (Arrow stream) with the numbers of their
    first ``max_length`` tokens in place of the strings."""
    def run(batches):
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32
        for b in batches:
            at = 0
            ends = np.cumsum(pc.list_value_length(b.column(b.num_columns - 1)).fill_null(0).to_numpy())
            while at < len(ends):  # at least one row a chunk
                before = ends[at - 1] if at else 0
                n = max(1, int(np.searchsorted(ends, before + chunk_tokens, "right")) - at)
                part = b.slice(at, n)
                lists = part.column(part.num_columns - 1)
                coded = lists.flatten().dictionary_encode()
                codes = coded.indices.to_numpy()
                size = pc.list_value_length(lists).fill_null(0).to_numpy()
                place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
                offsets = np.concatenate([[0], np.cumsum(np.minimum(size, max_length))]).astype(np.int32)
                kept = pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes[place < max_length], pa.int32()))
                table = pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(size, pa.int64()), kept],
                                                   [*part.schema.names[:-1], "n_tokens", "codes"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_batch(table)
                counts = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int64)
                whole = pa.array([0, len(counts)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([serial], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                     pa.ListArray.from_arrays(whole, coded.dictionary), pa.ListArray.from_arrays(whole, pa.array(counts))],
                    ["chunk", "rows", "tokens", "counts"])
                serial, at = serial + 1, at + n

    return rows.mapInArrow(run, "chunk long, rows binary, tokens array<string>, counts array<long>")


def tokenize_corpus(docs: DataFrame, id_col="doc_id", text="text", max_length=512,
                    vocab: DataFrame | None = None, keep=("source",), tokenizer=word_tokens,
                    chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """text -> ids through the vocabulary, truncated to ``max_length``.
    ``tokenizer``: column of texts -> column of token arrays (a built-in
    expression or an Arrow UDF). Output per row: ids, n_tokens, n_kept,
    truncated.

    The tokens are dictionary-encoded: a chunk of texts writes its distinct
    tokens once, only those are counted and meet the vocabulary, and the texts
    carry numbers that one lookup array a chunk turns into ids. Tokens that a
    given vocabulary lacks are left out."""
    columns = list(dict.fromkeys([id_col, *keep]))
    chunks = materialize(dictionary_chunks(docs.select(*columns, tokenizer(F.col(text)).alias("_t")), max_length, chunk_tokens), "token-chunks")
    entries = chunks.select("chunk", F.posexplode(F.arrays_zip("tokens", "counts")).alias("code", "e")).select("chunk", "code", "e.tokens", "e.counts")
    if vocab is None:
        vocab = rank_vocab(entries.groupBy(F.col("tokens").alias("token")).agg(F.sum("counts").alias("cnt")))
    ided = join_checked(entries.withColumnRenamed("tokens", "token"), vocab.select("token", "id"), "token")
    lookup = ided.groupBy("chunk").agg(F.collect_list("code").alias("known"), F.collect_list("id").alias("ids"))

    def run(chunk: pa.Table) -> pa.Table:
        done = []
        for rows, known, ids in zip(chunk["rows"], chunk["known"], chunk["ids"]):  # one row a chunk
            table = pa.ipc.open_stream(rows.as_buffer()).read_all().combine_chunks()
            codes = table["codes"].combine_chunks() if table.num_rows else table["codes"]
            flat, size = codes.flatten().to_numpy(), pc.list_value_length(codes).to_numpy()
            to_id = np.full(int(flat.max(initial=-1)) + 1, -1, np.int64)
            at = known.values.to_numpy() if known.is_valid else np.empty(0, np.int64)
            use = at < len(to_id)
            if len(at):
                to_id[at[use]] = ids.values.to_numpy()[use]
            out = to_id[flat]
            row = np.repeat(np.arange(len(size)), size)[out >= 0]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out[out >= 0]))
            done.append(pa.Table.from_arrays([*[table[c].combine_chunks() for c in columns], lists, table["n_tokens"].combine_chunks()],
                                             [*columns, "input_ids", "n_tokens"]))
        return pa.concat_tables(done)

    schema = docs.select(*columns).schema.add("input_ids", T.ArrayType(T.LongType())).add("n_tokens", T.LongType())
    # a group is one chunk: a worker holds one, not the Arrow batch of all chunks of its task
    out = chunks.select("chunk", "rows").join(lookup, "chunk", "left").groupBy("chunk").applyInArrow(run, schema)
    return (out.withColumn("n_kept", F.size("input_ids").cast("bigint"))
            .withColumn("truncated", F.col("n_tokens") > max_length))


def tokenize_summary(docs: DataFrame, source="source", text="text", max_length=512, tokenizer=word_tokens) -> DataFrame:
    """Per source: rows, tokens, tokens kept by truncation, truncated rows; no vocabulary is needed for that."""
    n = F.greatest(F.size(tokenizer(F.col(text))), F.lit(0)).cast("bigint")
    return docs.select(F.col(source), n.alias("_n")).groupBy(source).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("_n").alias("n_tokens"),
        F.sum(F.least("_n", F.lit(max_length).cast("bigint"))).alias("n_kept"),
        F.count_if(F.col("_n") > max_length).alias("n_truncated"))


# -- K2 ---------------------------------------------------------------------------

def padding_waste_report(lengths: DataFrame, length_col="length", batch_col="batch_id",
                         max_length=512, multiple=8) -> DataFrame:
    """Real vs padded tokens under each layout, from one aggregate per batch
    and one total: pad to max_length, pad to batch max, batch max rounded up
    to a multiple, packed into max_length blocks, flattened (no padding)."""
    L = F.least(F.col(length_col), F.lit(max_length))
    per_batch = lengths.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("n"), F.sum(L).alias("real"), F.max(L).alias("mx"),
        F.sum(F.greatest(F.col(length_col) - max_length, F.lit(0))).alias("cut"),
        F.sum(F.col(length_col)).alias("raw"))
    return per_batch.agg(
        F.sum("real").cast("bigint").alias("real_tokens"),
        F.sum(F.col("n") * max_length).cast("bigint").alias("padded_max_length"),
        F.sum(F.col("n") * F.col("mx")).cast("bigint").alias("padded_batch_max"),
        F.sum(F.col("n") * F.ceil(F.col("mx") / multiple) * multiple).cast("bigint").alias("padded_multiple"),
        F.sum(F.ceil(F.col("real") / max_length) * max_length).cast("bigint").alias("packed_tokens"),
        F.sum("real").cast("bigint").alias("flattened_tokens"),
        (F.sum("cut") / F.sum("raw")).alias("truncated_share"))


# -- K5 / K6 -----------------------------------------------------------------------

def pad_right(ids, max_length, pad=PAD_ID):
    cut = F.slice(ids, 1, max_length)
    return F.concat(cut, F.array_repeat(F.lit(pad).cast("bigint"), F.lit(max_length) - F.size(cut)))


def supervision_labels(df: DataFrame, ids="input_ids", prompt_len="prompt_len", max_length=8,
                       mode="mask_pad") -> DataFrame:
    """Padded ids, attention mask and labels. Modes: ``full`` = ids incl.
    pads (pads become targets), ``mask_pad`` = ids where mask = 1 else -100,
    ``completion`` = also -100 over the prompt."""
    n_real = F.least(F.size(ids), F.lit(max_length))
    padded = pad_right(F.col(ids), max_length)
    mask = F.transform(F.sequence(F.lit(0), F.lit(max_length - 1)),
                       lambda i: F.when(i < n_real, 1).otherwise(0))
    if mode == "full":
        labels = padded
    elif mode == "mask_pad":
        labels = F.zip_with(padded, mask, lambda t, m: F.when(m == 1, t).otherwise(F.lit(IGNORE_INDEX)))
    elif mode == "completion":
        labels = F.transform(padded, lambda t, i: F.when(
            (i < n_real) & (i >= F.col(prompt_len)), t).otherwise(F.lit(IGNORE_INDEX)))
    else:
        raise ValueError(f"unknown label mode {mode}")
    return (df.withColumn("padded_ids", padded).withColumn("attention_mask", mask)
            .withColumn("labels", labels.cast("array<bigint>")))


def supervised_count(labels):
    return F.size(F.filter(labels, lambda x: x != IGNORE_INDEX))


def prompt_completion_mask(df: DataFrame, prompt_ids="prompt_ids", completion_ids="completion_ids",
                           max_length=64, token_type_ids=False) -> DataFrame:
    """ids = prompt + completion cut at max_length; completion mask = 0 for
    min(len(prompt), len(ids)) positions, then 1."""
    ids = F.slice(F.concat(F.col(prompt_ids), F.col(completion_ids)), 1, max_length)
    out = df.withColumn("input_ids", ids)
    n_p = F.least(F.size(prompt_ids), F.size("input_ids"))
    out = out.withColumn("completion_mask", F.concat(
        F.array_repeat(F.lit(0), n_p), F.array_repeat(F.lit(1), F.size("input_ids") - n_p)))
    if token_type_ids:
        out = out.withColumn("token_type_ids", F.array_repeat(F.lit(0), F.size("input_ids")))
    return out


# -- K7 ---------------------------------------------------------------------------

def assistant_mask(df: DataFrame, messages="messages", template=None) -> DataFrame:
    """Per rendered message, its whitespace tokens; mask 1 on assistant
    messages only. Requires a message array column."""
    dt = df.schema[messages].dataType.simpleString()
    if not dt.startswith("array<struct"):
        raise ValueError("assistant_mask needs a conversational (message list) column")
    per_msg = F.transform(messages, lambda m: F.struct(
        ws_tokens(render_messages(F.array(m), template)).alias("toks"),
        F.when(m["role"] == "assistant", 1).otherwise(0).alias("a")))
    return (df.withColumn("_pm", per_msg)
            .withColumn("tokens", F.flatten(F.transform("_pm", lambda x: x["toks"])))
            .withColumn("assistant_masks", F.flatten(F.transform(
                "_pm", lambda x: F.array_repeat(x["a"], F.size(x["toks"])))))
            .drop("_pm"))


# -- K8 ---------------------------------------------------------------------------

def _boundary(prompt_toks, full_toks):
    k = F.size(prompt_toks)
    same = F.slice(full_toks, 1, k) == prompt_toks
    return F.when(same, k).otherwise(k - 1)


def pair_boundary_audit(df: DataFrame, prompt="prompt", chosen="chosen", rejected="rejected") -> DataFrame:
    """Tokenise prompt+answer and prompt alone; where the joint tokenisation
    changes the prompt part, the boundary moves back by one. Chosen and
    rejected prompt parts may differ in at most one token and one length."""
    pt = ws_tokens(F.col(prompt))
    ct = ws_tokens(F.concat(F.col(prompt), F.col(chosen)))
    rt = ws_tokens(F.concat(F.col(prompt), F.col(rejected)))
    out = (df.withColumn("_pt", pt).withColumn("_ct", ct).withColumn("_rt", rt)
           .withColumn("boundary_chosen", _boundary(F.col("_pt"), F.col("_ct")))
           .withColumn("boundary_rejected", _boundary(F.col("_pt"), F.col("_rt"))))
    cp = F.slice("_ct", 1, F.col("boundary_chosen"))
    rp = F.slice("_rt", 1, F.col("boundary_rejected"))
    n_diff = F.size(F.filter(F.zip_with(cp, rp, lambda a, b: F.coalesce(a != b, F.lit(True))), lambda x: x))
    return (out.withColumn("prompt_token_diff", n_diff.cast("int"))
            .withColumn("violation", (F.abs(F.col("boundary_chosen") - F.col("boundary_rejected")) > 1)
                        | (F.col("prompt_token_diff") > 1))
            .drop("_pt", "_ct", "_rt"))


# -- K10 / K14 ---------------------------------------------------------------------

def truncate_pair(df: DataFrame, prompt_ids="prompt_ids", chosen_ids="chosen_ids",
                  rejected_ids="rejected_ids", max_length=512, max_prompt_length=128,
                  mode="keep_end") -> DataFrame:
    """If prompt + longer answer exceeds max_length: cut the prompt to
    max_prompt_length (keep_start = head, keep_end = tail); if still too
    long, cut both answers to max_length - max_prompt_length."""
    p, c, r = F.col(prompt_ids), F.col(chosen_ids), F.col(rejected_ids)
    longer = F.greatest(F.size(c), F.size(r))
    over = F.size(p) + longer > max_length
    n_keep = F.least(F.size(p), F.lit(max_prompt_length))
    if mode == "keep_start":
        cut_p = F.slice(p, 1, max_prompt_length)
    elif mode == "keep_end":
        cut_p = F.when(F.size(p) > max_prompt_length,
                       F.slice(p, F.size(p) - n_keep + 1, n_keep)).otherwise(p)
    else:
        raise ValueError(f"unknown truncation mode {mode}")
    out = df.withColumn("_p", F.when(over, cut_p).otherwise(p))
    still = F.size("_p") + longer > max_length
    budget = max_length - max_prompt_length
    out = (out.withColumn("_c", F.when(still, F.slice(c, 1, budget)).otherwise(c))
           .withColumn("_r", F.when(still, F.slice(r, 1, budget)).otherwise(r)))
    lost = (F.size(p) - F.size("_p")) + (F.size(c) - F.size("_c")) + (F.size(r) - F.size("_r"))
    return (out.withColumn("tokens_lost", lost.cast("bigint"))
            .drop(prompt_ids, chosen_ids, rejected_ids)
            .withColumnRenamed("_p", prompt_ids).withColumnRenamed("_c", chosen_ids)
            .withColumnRenamed("_r", rejected_ids))


def truncate_sequence(df: DataFrame, ids="input_ids", max_length=512, mode="keep_end", out=None) -> DataFrame:
    """Single-sequence truncation: ``keep_start`` keeps the head,
    ``keep_end`` the tail (e.g. separate limits for encoder inputs and
    decoder labels are two calls)."""
    c = F.col(ids)
    if mode == "keep_start":
        cut = F.slice(c, 1, max_length)
    elif mode == "keep_end":
        n = F.least(F.size(c), F.lit(max_length))
        cut = F.when(F.size(c) > max_length, F.slice(c, F.size(c) - n + 1, n)).otherwise(c)
    else:
        raise ValueError(f"unknown truncation mode {mode}")
    return df.withColumn(out or ids, cut)


def length_filter_pairs(df: DataFrame, chosen_ids="chosen_ids", rejected_ids="rejected_ids",
                        max_length=512) -> DataFrame:
    """Keep pairs whose both sides fit; never truncate."""
    return df.where((F.size(chosen_ids) <= max_length) & (F.size(rejected_ids) <= max_length))


def length_filter_report(df: DataFrame, chosen_ids="chosen_ids", rejected_ids="rejected_ids",
                         max_length=512) -> DataFrame:
    """Kept and dropped pair counts of ``length_filter_pairs`` (one aggregate)."""
    fits = (F.size(chosen_ids) <= max_length) & (F.size(rejected_ids) <= max_length)
    return df.agg(F.count_if(fits).alias("n_kept"), F.count_if(~fits).alias("n_dropped"))


# -- K13 ---------------------------------------------------------------------------

def prm_step_labels(df: DataFrame, prompt_ids="prompt_ids", steps_ids="steps_ids", labels="labels",
                    separator_id=EOS_ID, max_prompt_length=None, max_completion_length=None,
                    max_length=None, train_on_last_step_only=False, add_bos=True) -> DataFrame:
    """Stepwise supervision: each step's ids + separator; labels -100 except
    the last token of a step = the step's 0/1 label (only the last step when
    ``train_on_last_step_only``); BOS + prompt (keeps its tail), completion
    keeps its head; all cut at max_length."""
    n_steps = F.size(steps_ids)
    step_ids = F.transform(steps_ids, lambda s: F.concat(s, F.array(F.lit(separator_id).cast("bigint"))))
    step_lbl = F.transform(F.arrays_zip(F.col(steps_ids).alias("s"), F.col(labels).alias("l")),
                           lambda z, i: F.concat(
                               F.array_repeat(F.lit(IGNORE_INDEX).cast("bigint"), F.size(z["s"])),
                               F.array(F.when(F.lit(not train_on_last_step_only) | (i == n_steps - 1),
                                              z["l"].cast("bigint")).otherwise(F.lit(IGNORE_INDEX).cast("bigint")))))
    p = F.col(prompt_ids)
    if add_bos:
        p = F.concat(F.array(F.lit(BOS_ID).cast("bigint")), p)
    out = df.withColumn("_p", p).withColumn("_c", F.flatten(step_ids)).withColumn("_l", F.flatten(step_lbl))
    if max_prompt_length is not None:
        k = F.least(F.size("_p"), F.lit(max_prompt_length))
        out = out.withColumn("_p", F.slice("_p", F.size("_p") - k + 1, k))
    if max_completion_length is not None:
        out = (out.withColumn("_c", F.slice("_c", 1, max_completion_length))
               .withColumn("_l", F.slice("_l", 1, max_completion_length)))
    ids = F.concat("_p", "_c")
    lab = F.concat(F.array_repeat(F.lit(IGNORE_INDEX).cast("bigint"), F.size("_p")), F.col("_l"))
    if max_length is not None:
        ids, lab = F.slice(ids, 1, max_length), F.slice(lab, 1, max_length)
    return out.withColumn("input_ids", ids).withColumn("step_labels", lab).drop("_p", "_c", "_l")

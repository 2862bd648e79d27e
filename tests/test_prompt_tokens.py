"""Prompt templates and token jobs on literal rows (boundaries: blank and
null context, whitespace kinds, empty arrays, all-pad, truncation modes)."""


from tunelake.operators import prompt as P
from tunelake.operators import tokens as K


def test_prompt_context_block(spark):
    rows = [(1, "Q", "ctx", "A"), (2, "Q", " \t\n", "A"), (3, "Q", None, "A")]
    df = spark.createDataFrame(rows, "row_id long, instruction string, context string, response string")
    got = {r.row_id: r.text for r in P.format_train_prompt(df).collect()}
    assert got[1] == "### Instruction:\nQ\n\n### Context:\nctx\n\n### Response:\nA"
    assert got[2] == got[3] == "### Instruction:\nQ\n\n### Response:\nA"


def test_clean_and_strip_prefix(spark):
    df = spark.createDataFrame([("PROMPT", "PROMPT  gen\r\ntext \n"), ("P", None)], ["prompt", "generated"])
    got = [r.generated for r in P.strip_prompt_prefix(df).collect()]
    assert got == ["gen  text", ""]


def test_extract_prompt_strings_and_messages(spark):
    df = spark.createDataFrame([("abcX", "abcY"), ("same", "same"), ("", "x")], ["chosen", "rejected"])
    got = [(r.prompt, r.chosen, r.rejected) for r in P.extract_prompt(df).collect()]
    assert got == [("abc", "X", "Y"), ("same", "", ""), ("", "", "x")]


def test_supervision_modes(spark):
    df = spark.createDataFrame([([5, 6, 7], 1), ([], 0)], "input_ids array<bigint>, prompt_len int")
    full = K.supervision_labels(df, max_length=4, mode="full").collect()
    assert full[0].labels == [5, 6, 7, 0] and full[1].labels == [0, 0, 0, 0]
    mp = K.supervision_labels(df, max_length=4, mode="mask_pad").collect()
    assert mp[0].labels == [5, 6, 7, -100] and mp[0].attention_mask == [1, 1, 1, 0]
    comp = K.supervision_labels(df, max_length=4, mode="completion").collect()
    assert comp[0].labels == [-100, 6, 7, -100] and comp[1].labels == [-100] * 4


def test_truncate_pair_modes(spark):
    df = spark.createDataFrame([(list(range(10)), list(range(6)), list(range(3)))],
                               "prompt_ids array<bigint>, chosen_ids array<bigint>, rejected_ids array<bigint>")
    end = K.truncate_pair(df, max_length=8, max_prompt_length=4, mode="keep_end").collect()[0]
    assert end.prompt_ids == [6, 7, 8, 9] and end.chosen_ids == [0, 1, 2, 3] and end.rejected_ids == [0, 1, 2]
    start = K.truncate_pair(df, max_length=8, max_prompt_length=4, mode="keep_start").collect()[0]
    assert start.prompt_ids == [0, 1, 2, 3] and start.tokens_lost == 6 + 2


def test_prm_labels(spark):
    df = spark.createDataFrame([([10, 11], [[20, 21], [30]], [True, False])],
                               "prompt_ids array<bigint>, steps_ids array<array<bigint>>, labels array<boolean>")
    r = K.prm_step_labels(df).collect()[0]
    assert r.input_ids == [2, 10, 11, 20, 21, 1, 30, 1]
    assert r.step_labels == [-100, -100, -100, -100, -100, 1, -100, 0]
    last = K.prm_step_labels(df, train_on_last_step_only=True).collect()[0]
    assert last.step_labels == [-100, -100, -100, -100, -100, -100, -100, 0]


def test_assistant_mask_requires_messages(spark):
    import pytest

    df = spark.createDataFrame([("x",)], ["messages"])
    with pytest.raises(ValueError):
        K.assistant_mask(df)


def test_truncate_sequence_modes(spark):
    df = spark.createDataFrame([(list(range(6)),), ([1],)], "input_ids array<bigint>")
    head = [r.input_ids for r in K.truncate_sequence(df, max_length=4, mode="keep_start").collect()]
    tail = [r.input_ids for r in K.truncate_sequence(df, max_length=4, mode="keep_end").collect()]
    assert head == [[0, 1, 2, 3], [1]] and tail == [[2, 3, 4, 5], [1]]


def test_input_forms_and_column_types(spark):
    import pytest

    from tunelake.operators import prompt as P

    df = spark.createDataFrame([("a", None, None), ("a", [1], [1]), (None, [1], None), (None, None, None)],
                               "text string, ids array<int>, labels array<int>")
    r = P.input_form_audit(df, {"text": ["text"], "ids": ["ids", "labels"]}).collect()[0]
    assert r.asDict() == {"n_rows": 4, "no_form": 1, "one_form": 2, "several_forms": 1, "incomplete": 1, "has_text": 2, "has_ids": 2}
    empty = P.input_form_audit(df.limit(0), {"text": ["text"]}).collect()[0]
    assert empty["n_rows"] == 0 and empty["no_form"] == 0
    with pytest.raises(TypeError, match="chosen is bigint"):
        P.validate_rows(spark.createDataFrame([("p", 1, "r")], ["prompt", "chosen", "rejected"]))
    assert P.require_strings(spark.createDataFrame([("p", ["t"])], ["prompt", "turns"]), ["prompt"], ["turns"]).count() == 1


def test_quarantine_names_the_first_reason(spark):
    from tunelake.operators import prompt as P

    rows = [("p", "a", "b"), (None, "a", "b"), ("p", " ", "b"), ("p", "a", "a"), ("p", None, "")]
    df = spark.createDataFrame(rows, "prompt string, chosen string, rejected string")
    assert sorted(r["reason"] for r in P.quarantine(df).collect()) == ["blank chosen", "null chosen", "null prompt", "same pair"]


def test_nan_logprobs_become_null(spark):
    from tunelake.operators import prompt as P

    df = spark.createDataFrame([(float("nan"),), (None,), (-1.0,)], "logp double")
    assert [r["logp"] for r in P.clear_nan_logprobs(df, ["logp"]).collect()] == [None, None, -1.0]

from pyspark.sql import functions as F

from tunelake.functions.text import DEFAULT_PROMPT_TEMPLATE, render_template
from tunelake.operators import pairs as P
from tunelake.sources.readers import MESSAGES_SCHEMA


def msg_df(spark, rows):
    schema = "conv_id bigint, messages array<struct<role:string,content:string>>"
    return spark.createDataFrame(rows, schema)


def test_last_user_and_last_assistant_are_independent(spark):
    rows = [
        (1, [("user", "q1"), ("assistant", "a1"), ("user", "q2")]),           # ends in a user turn
        (2, [("user", "q"), ("assistant", "a1"), ("assistant", "a2")]),       # two assistants
        (3, [("system", "s"), ("user", "q"), ("tool", "t")]),                  # no assistant, unknown roles
        (4, None),                                                             # null messages
        (5, [("user", None), ("assistant", "a")]),                             # null content
    ]
    got = {r.conv_id: (r.prompt, r.response) for r in P.pairs_from_messages(msg_df(spark, rows)).collect()}
    assert got[1] == ("q2", "a1")
    assert got[2] == ("q", "a2")
    assert got[3] == ("q", None)
    assert got[4] == (None, None)
    assert got[5] == (None, "a")


def test_turn_table_and_chunked_fold_agree(spark):
    turns = spark.createDataFrame(
        [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(9)] +
        [(2, 0, "user", "only")], "conv_id bigint, turn bigint, role string, text string")
    a = {r.conv_id: (r.prompt, r.response) for r in P.pairs_from_turns(turns).collect()}
    # chunks of 2 turns: the merge must still pick the last of each role overall
    b = {r.conv_id: (r.prompt, r.response)
         for r in P.pairs_from_messages(P.fold_messages(turns, chunk_turns=2)).collect()}
    assert a == b == {1: ("m8", "m7"), 2: ("only", None)}


def test_flat_aliases_and_empty_filter(spark):
    df = spark.createDataFrame([(1, "i", "o"), (2, "", "o"), (3, "  ", "o"), (4, None, "o")],
                               "id bigint, instruction string, output string")
    p = P.pairs_from_columns(df, keep=["id"])
    assert p.columns == ["id", "prompt", "response"]
    kept = sorted(r.id for r in P.nonempty_pairs(p).collect())
    assert kept == [1, 3]  # "" and null dropped, whitespace-only kept
    assert sorted(r.id for r in P.drop_null_pairs(p).collect()) == [1, 2, 3]
    # absent column -> "" -> dropped
    only_prompt = P.pairs_from_columns(spark.createDataFrame([(1, "x")], "id bigint, prompt string"), keep=["id"])
    assert P.nonempty_pairs(only_prompt).count() == 0


def test_template_is_literal(spark):
    tricky = "a {b} $1 \\\\ {instruction} }{"
    df = spark.createDataFrame([(tricky, "r")], "prompt string, response string")
    row = P.chat_template(df).first()
    assert row.formatted_prompt == DEFAULT_PROMPT_TEMPLATE.format(instruction=tricky)
    assert row.formatted_response == "r<|im_end|>"
    esc = spark.range(1).select(render_template(F.lit("X"), "{{x}} {instruction}").alias("s")).first().s
    assert esc == "{x} X"


def test_template_rejects_other_fields():
    import pytest
    with pytest.raises(ValueError):
        render_template(F.lit("x"), "{instruction} {response}")


def test_messages_schema_declared():
    assert MESSAGES_SCHEMA.fields[0].name == "messages"


def test_whitespace_tokens_equal_python_split(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from tunelake.functions.text import whitespace_tokens
    alphabet = st.sampled_from(list("ab é") + ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0",
                                               " ", " ", " ", " ", "　", "​"])
    texts = []

    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet=alphabet, max_size=30))
    def collect(s):
        texts.append(s)
    collect()
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", whitespace_tokens("s").alias("t")).collect()}
    for i, s in enumerate(texts):
        assert got[i] == s.split(), repr(s)

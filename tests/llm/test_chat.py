import hashlib

import pytest

from panelloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows):
    return {r.conv_id: r for r in chat.read_chats(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()}


def expect(turns):
    every = "".join(f"{r}\n{t}\n" for r, t in turns)
    said = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(every.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def check(row, turns):
    assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == expect(turns) and row.identical


@pytest.mark.parametrize("text", [
    "</s>[INST] ok [/INST]", "[\\INST]", "[\\\\/INST]", "<", "[", "</s", "</s></s>", "[TURN x]", "[/TURN]", "<\\s>", "a\nb", "", "é😀", "[INST", "$1 \\", "<<s>s>",
])
def test_control_strings_come_back(spark, text):
    roles = ["user", "assistant", "system", "we[ir]d<%5D", ""]
    row = run(spark, [(1, k, r, text) for k, r in enumerate(roles)])[1]
    check(row, [(r, text) for r in roles])


def test_plain_text_is_not_changed_and_hostile_text_is(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "</s>")], SCHEMA)
    assert chat.format_chats(rows).head().formatted == "[INST]hi[/INST]<s><\\/s></s>"


def test_nulls_ties_order_and_many_turns(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, None, "x"), (2, 5, "user", "q"), (2, 5, "user", "q"), (2, None, "assistant", "z")]
    rows += [(3, k, "assistant" if k % 2 else "user", str(k)) for k in range(1000)]
    got = run(spark, rows)
    check(got[1], [("user", ""), ("assistant", "b")])
    check(got[None], [("", "x")])
    check(got[2], [("assistant", "z"), ("user", "q"), ("user", "q")])
    check(got[3], [("assistant" if k % 2 else "user", str(k)) for k in range(1000)])


def test_empty_table_and_extra_columns(spark):
    from pyspark.sql import functions as F

    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, 0, "user", "x" * 100_000)], SCHEMA).withColumn("block", F.lit(1)).withColumn("plain", F.lit(2))
    assert chat.read_chats(chat.format_chats(df)).head().n_turns == 1

import pytest
from pyspark.sql import functions as F

from nearfield.llm import chat_format as cf


def turns_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x"))
    return {r.conv_id: r for r in cf.read_back(cf.format_conversations(df)).collect()}


def test_round_trip_and_merge(spark):
    odd = ["", "~", "~1", "<|end|>\n", "<|next|>", "a<", "|>", "</s>[INST] ok [/INST]", "<<|text|>", "~~0[[INST]", "é\U0001f600" * 3, "w " * 60_000]
    rows = [(1, i, "user" if i // 2 % 2 else "assistant", t) for i, t in enumerate(odd)] + [(2, None, None, None), (None, 1, "<|role|>", "x"), (2, 1, "user", "q"), (2, 1, "user", "q")]
    got = turns_of(spark, rows)
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t) for _, _, r, t in rows[: len(odd)]]
    assert got[1].loss_text == "".join(t for _, _, r, t in rows[: len(odd)] if r == "assistant")
    assert got[1].formatted.count("<|role|>") == len(odd) // 2  # neighbours of one role share a block
    assert [(t.role, t.text) for t in got[2].turns] == [("", ""), ("user", "q"), ("user", "q")]
    assert [(t.role, t.text) for t in got[None].turns] == [("<|role|>", "x")]
    assert "".join(s.text for s in got[1].segments) == got[1].formatted


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cf.read_back(cf.format_conversations(df)).count() == 0


def test_mask_must_agree_with_the_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    formatted = cf.format_conversations(df)
    assert cf.read_back(formatted).first().loss_text == "a"
    wrong = formatted.withColumn("segments", F.transform("segments", lambda s: F.struct(s["text"].alias("text"), (~s["loss"]).alias("loss"))))
    with pytest.raises(Exception, match="mask"):
        cf.read_back(wrong).collect()

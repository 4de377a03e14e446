"""Chat formatting: what goes in comes out, control strings never do."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pendscope.llm.chat_format import HOSTILE, USUAL, Template, chat_digests, format_conversations, read_turns, trained_text

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
PARTS = ["\\", "<", "|im_end|>", "<|im_end|>", "<|im_start|>", "\n", "</s>", "s>", "[INST]", "[", "/INST]", "<<SYS>>", "<|nl|>", "😀", "a", "$1", " "]


def _texts(count: int) -> list[str]:
    dice = random.Random(3)
    return ["".join(dice.choices(PARTS, k=dice.randint(0, 12))) for _ in range(count)]


def test_escaping_is_reversible(spark):
    texts = _texts(3000)
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", USUAL.escaped(F.col("t")).alias("e"))
    rows = frame.select("t", "e", USUAL.plain(F.col("e")).alias("back"), USUAL.read_role(USUAL.shown_role(F.col("t"))).alias("role")).collect()
    assert all(r["t"] == r["back"] == r["role"] for r in rows)
    assert not any(c in r["e"] for r in rows for c in USUAL.controls)


def test_read_back(spark):
    texts = _texts(600)
    rows = [(k % 40, k // 40, ["user", "assistant", "us\ner<|im_end|>", ""][k % 4 if k % 7 else k % 2], text) for k, text in enumerate(texts)]
    made = format_conversations(spark.createDataFrame(rows, SCHEMA))
    got = made.select("conv_id", "formatted", "segments", read_turns(F.col("formatted")).alias("turns"), trained_text(F.col("segments")).alias("loss")).collect()
    for row in got:
        want = [(role, text) for conv, _, role, text in sorted(rows) if conv == row["conv_id"]]
        assert [tuple(t) for t in row["turns"]] == want
        assert row["loss"] == "".join(text for role, text in want if role == "assistant")
        assert "".join(s["text"] for s in row["segments"]) == row["formatted"]


@pytest.mark.parametrize("roles, valid, fault", [
    ("user assistant", True, None), ("system user assistant user assistant", True, None), ("user", False, None), ("assistant", False, 0),
    ("user user assistant", False, 1), ("user system user assistant", False, 1), ("user assistant tool assistant", False, 2)])
def test_turn_order(spark, roles, valid, fault):
    rows = [(1, turn, role, "x") for turn, role in enumerate(roles.split())]
    got = format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got["valid"], got["first_fault"]) == (valid, fault)


def test_awkward_rows(spark):
    rows = [(None, 1, None, None), (1, None, "user", ""), (1, 0, "assistant", "y" * 200_000), (1, 0, "assistant", "y" * 200_000)]
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("z").alias(c) for c in ("turns", "run", "segments", "state", "formatted")))
    got = {r["conv_id"]: r for r in chat_digests(frame).collect()}
    assert set(got) == {None, 1, -1}
    assert (got[None]["n_turns"], got[None]["loss_chars"], got[None]["valid"]) == (1, 0, False)
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["first_fault"]) == (3, 400_000, 2)
    assert (got[-1]["n_turns"], got[-1]["loss_chars"]) == (2, len(HOSTILE))
    assert {r["conv_id"] for r in chat_digests(frame.limit(0)).collect()} == {-1}


def test_other_template(spark):
    own = Template(turn_open="[T]", role_close=": ", turn_close="[/T]", controls=("[T]", "[/T]", "[;]"), role_close_inside="[;]", escape="~",
                   trained=("bot", "critic"), moves={("start", "human"): "h", ("h", "bot"): "b", ("b", "critic"): "c"}, final=("c",))
    rows = [(1, 0, "human", "[T]~ hi: ["), (1, 1, "bot", "[/T]"), (1, 2, "critic", "fine")]
    got = format_conversations(spark.createDataFrame(rows, SCHEMA), own)
    row = got.select("valid", "formatted", read_turns(F.col("formatted"), own).alias("turns"), trained_text(F.col("segments"), own).alias("loss")).first()
    assert row["valid"] and [tuple(t) for t in row["turns"]] == [r[2:] for r in rows] and row["loss"] == "[/T]fine"
    assert row["formatted"].count("[T]") == row["formatted"].count("[/T]") == 3


@pytest.mark.parametrize("bad", [
    {"escape": "<"}, {"turn_close": "\n\n"}, {"controls": ("<|im_start|>", "<|im_end|>")}, {"role_close": "|"}, {"role_close": "<"}])
def test_templates_that_could_not_be_read_back(bad):
    with pytest.raises(ValueError):
        Template(**bad)

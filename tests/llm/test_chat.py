"""Chat formatting: read back what was said, whatever it holds; attachments at their places."""

import random
import re

import pytest
from pyspark.sql import functions as F

from orrerium.llm import chat

ROWS = "conv_id long, turn long, role string, text string"
BITS = ["</s>", "[INST]", "[/INST]", "<s>", "[SYS]", "[ROLE]", "[/ROLE]", "<image>", "</document>", "<", "[", "\\", "\\\\", "/", "INST]", "s>", "\n", " ", "é", "𝄞", "a"]


def read(blocks):
    turns = blocks.select("conv_id", "block", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("spans")).alias("loss"), "formatted", "spans")
    out = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id is not None, r.conv_id, r.block is not None, r.block)):
        said, loss = out.setdefault(r.conv_id, ([], []))
        said += [(t.role, t.text) for t in r.turns]
        loss.append(r.loss)
    return {k: (said, "".join(loss)) for k, (said, loss) in out.items()}


def test_any_text_is_read_back(spark):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "we[/ROLE]ird", "", None]), "".join(rnd.choices(BITS, k=rnd.randrange(12)))) for c in range(12) for t in range(rnd.randrange(1, 150))]
    got = read(chat.format_blocks(spark.createDataFrame(rnd.sample(rows, len(rows)), ROWS).withColumn("block", F.lit("clash")).withColumn("spans", F.lit(1))))
    for c in range(12):
        mine = [(r or "", t) for k, _, r, t in rows if k == c]
        assert got[c] == (mine, "".join(t for r, t in mine if r == "assistant"))


def test_no_control_string_of_a_text_survives(spark):
    t = chat.Template()
    rows = [(0, k, "user", "".join(random.Random(k).choices(BITS, k=9))) for k in range(300)]
    for r in chat.format_blocks(spark.createDataFrame(rows, ROWS), turns=1).collect():
        inside = r.formatted[len(t.user) : -len(t.end)]
        assert not any(s in inside for s in t.controls)


def test_nulls_empties_ties_and_repeats(spark):
    rows = [(None, 0, "assistant", "x"), (1, None, "assistant", "late?"), (1, 3, None, None), (1, -70, "user", ""), (1, 3, "assistant", "b"), (1, 3, "assistant", "a"), (1, 3, "assistant", "a"), (2, 0, "assistant", "y" * 2_000_000)]
    got = read(chat.format_blocks(spark.createDataFrame(rows, ROWS)))
    assert got[None] == ([("assistant", "x")], "x")
    assert got[1] == ([("assistant", "late?"), ("user", ""), ("", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")], "late?aab")
    assert len(got[2][1]) == 2_000_000
    assert chat.format_blocks(spark.createDataFrame([], ROWS)).count() == 0


def test_parts_become_placeholders_in_order(spark):
    leaf = (None,) * 7
    text, image, audio = ("text", "see </s>", *leaf[2:]), ("image", None, "a.png", 28, 15, None, None), ("audio", None, "s.wav", None, None, 1.5, None)
    parts = [(*text, None), None, (*image, None), ("document", None, "d", None, None, None, 3, [text, audio, None]), ("document", None, "bare", None, None, None, None, []), ("odd", None, "z", None, None, None, None, None), ("odd", "kept", "z", None, None, None, None, None), ("image", None, None, None, 9, None, None, None)]
    rows = [(1, 4, "assistant", "ignored", parts), (1, 5, "user", "plain", None), (1, 6, "user", "none", [])]
    out = chat.format_blocks(spark.createDataFrame(rows, f"{ROWS}, parts {chat.PARTS}"), parts="parts").first()
    assert out.formatted == "[/INST]see <\\/s>\n<image>\n<document>\nsee <\\/s>\n<audio>\n</document>\n<document></document>\nkept\n<image></s>[INST]plain</s>[INST]</s>"
    assert [tuple(a)[2:] for a in out.attachments] == [("image", "a.png", 4), ("document", "d", 1536), ("audio", "s.wav", 38), ("document", "bare", 0), ("image", None, 256)]
    for a in out.attachments:
        assert a.turn == 4 and out.formatted.startswith(f"<{a.kind}>", a.position)


def test_marks_are_held_to_what_can_be_escaped():
    for mark in ("INST]", "[a[b]", "<x\\>", "<"):
        with pytest.raises(ValueError, match=re.escape(repr(mark))):
            chat.Template(user=mark)


def test_no_python_in_the_plan(spark):
    blocks = chat.format_blocks(spark.createDataFrame([(1, 1, "user", "a")], ROWS).union(spark.sql("select 2L, 1L, 'user', 'b'")))
    plan = blocks.select(chat.read_turns(F.col("formatted")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

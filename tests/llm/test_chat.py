"""Formatted conversations: exact round trips of awkward texts, placeholders, masks."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from cobasket.llm import chat, queries

PARTS = f"conv_id long, turn long, role string, parts array<{chat.PART}>, id int, said string"
MARKS = chat.CHAT.control()


def plain(rows, spark):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def back(df, *more):
    return df.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss")).alias("said"), *more)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))


def test_round_trip(spark):
    rng = random.Random(1)
    pieces = [*MARKS, "\\", "\\\\", "<", "[", "|>", "<\\/s>", "ok", "\n", "é", "𝄞", "$1", " ", "[[INST]", "<s></s>", "<<s>"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            text = rng.choice([None, "", "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))])
            rows.append((conv, rng.choice([turn, None]), rng.choice(["user", "assistant", "system", None, "<|says|>", "a\\b"]), text))
    rows += [(None, 1, "assistant", "no id"), (None, None, "user", "first"), (7, 99, "assistant", "again"), (7, 99, "assistant", "again"), (500, 0, "assistant", "\\<s>" * 30_000)]
    made = chat.format_chats(plain(rows, spark), chat.text_part(F.col("text")))
    got = {r.conv_id: r for r in back(made, "formatted", "n_turns").collect()}
    for conv in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in in_order(r for r in rows if r[0] == conv)]
        assert sorted((t.role, t.text) for t in got[conv].turns) == sorted(want)
        assert got[conv].n_turns == len(want)
        said = [t.text for t in got[conv].turns if t.role == "assistant"]
        assert got[conv].said == "".join(said)
        # No mark but the template's own.
        whole = got[conv].formatted
        for mark in MARKS:
            own = {"<s>": 1, "</s>": 1, "<|turn|>": len(want), "<|says|>": len(want), "<|end|>": len(want)}
            assert whole.count(mark) == own.get(mark, 0), mark


def test_turns_in_order(spark):
    rows = [(1, 10, "user", "b"), (1, 9, "user", "a"), (1, None, "system", "x"), (1, 11, "assistant", "c")]
    turns = back(chat.format_chats(plain(rows, spark), chat.text_part(F.col("text")))).first().turns
    assert [t.text for t in turns] == ["x", "a", "b", "c"]


def test_parts(spark):
    parts = [
        ("text", "see <|image|> ", None, None, None), ("image", None, "cat.png", 100.0, 57.0), ("text", " and hear", None, None, None),
        ("audio", "ignored", "moo.wav", 2.5, None), ("document", None, None, 3.0, None), ("film", "no", "x", 1.0, 1.0), (None, None, None, None, None),
    ]
    rows = [(1, 0, "user", parts, 5, "z"), (1, 1, "assistant", [("text", "fine", None, None, None), ("image", None, "b.png", None, 5.0)], 6, "z"), (1, 2, "user", None, 7, "z"), (2, 0, "user", [], 8, "z")]
    df = spark.createDataFrame(rows, PARTS)
    got = {r.conv_id: r for r in chat.format_chats(df, F.col("parts")).collect()}
    one = got[1]
    assert one.formatted == "<s><|turn|>user<|says|>see <\\|image|> <|image|> and hear<|audio|><|document|><|end|><|turn|>assistant<|says|>fine<|image|><|end|><|turn|>user<|says|><|end|></s>"
    image = math.ceil(100 / 28) * math.ceil(57 / 28)
    assert [tuple(a) for a in one.attachments] == [("image", "cat.png", image), ("audio", "moo.wav", 63), ("document", "", 768), ("image", "b.png", 0)]
    assert one.n_tokens == 2 + image + 2 + 63 + 768 + 1
    start, stop = one.loss[0]
    assert one.formatted[start:stop] == "fine<|image|>" and len(one.loss) == 1
    assert got[2].formatted == "<s><|turn|>user<|says|><|end|></s>" and got[2].attachments == [] and got[2].loss == []


def test_no_rows(spark):
    assert chat.format_chats(plain([], spark), chat.text_part(F.col("text"))).count() == 0


def test_other_template(spark):
    other = chat.Template(begin="", open="<|im_start|>", says="\n\n", close="<|im_end|>\n", finish="", trained=("bot",), others=("</s>",))
    rows = [(1, 0, "user", "a\nb</s><|im_end|>\n"), (1, 1, "bot", "c\n\nd")]
    with pytest.raises(ValueError):
        chat.Template(says="\n")
    made = chat.format_chats(plain(rows, spark), chat.text_part(F.col("text")), template=other)
    row = made.select(chat.parse(F.col("formatted"), other).alias("turns"), chat.masked(F.col("formatted"), F.col("loss")).alias("said")).first()
    assert [(t.role, t.text) for t in row.turns] == [r[2:] for r in rows] and row.said == "c\n\nd"


def test_query_reads_back_what_was_said(spark, tmp_path):
    rows = [(3, 1, "assistant", "one"), (3, 0, "user", None), (4, None, None, "</s>")]
    plain(rows, spark).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op12_chat_format(spark, str(tmp_path)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[3].turns_sha256 == digest("user\n\nassistant\none\n") and got[3].loss_sha256 == digest("one") and got[3].loss_chars == 3
    assert got[4].turns_sha256 == digest("\n</s>\n") and got[4].loss_chars == 0
    awkward = "</s>[INST] ok [/INST]"
    assert got[-1].turns_sha256 == digest(f"user\n{awkward}\nassistant\n{awkward}\n") and got[-1].loss_sha256 == digest(awkward)

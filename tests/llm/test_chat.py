"""Chat formatting: spans, escapes and rewritten history, against direct rendering."""

from __future__ import annotations

import hashlib
import random

import pytest

from bandweave.llm import chat

BITS = ["<", ">", "/s", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "\\\\", " ", "\n", "]", "[ROLE ", "[/ROLE]", "a", "é", "[", "b"]
ROLES = ["user", "assistant", "system", "tool", "", "to]ol\\", "[ROLE "]
SCHEMA = "conv_id long, turn long, role string, text string"


def conversation(rng: random.Random, turns: int) -> list[chat.Turn]:
    return [(rng.choice(ROLES), "".join(rng.choice(BITS) for _ in range(rng.randint(0, 6)))) for _ in range(turns)]


@pytest.mark.parametrize("context", [None, 1, 2])
def test_spans_of_turns_and_round_trip(context):
    rng = random.Random(3)
    for _ in range(1500):
        turns = conversation(rng, rng.randint(1, 6))
        state, rows = chat.Rendering(chat.instruct, context), []
        for turn in turns:
            piece, offset, start, end, rewrites, located = state.add(*turn)
            rows.append((offset, piece))
            assert located and not rewrites
            assert chat.read_turn(piece) == turn
            assert chat.unescaped(chat.applied(rows)[start:end]) == turn[1]
        assert chat.applied(rows) == chat.instruct(turns)


def test_no_control_string_is_left_in_a_text():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 8)))
        assert not chat.CONTROL.search(chat.escaped(text))
        assert chat.unescaped(chat.escaped(text)) == text


def templates():
    """Made here, so that workers get them by value: one keeps the thoughts of the last answer only, as some templates do; one trims."""

    def last_user_only(turns):
        last = max((i for i, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
        return "".join(f"<{r}>{t if r != 'assistant' or i == last else t[:1]}\n" for i, (r, t) in enumerate(turns))

    def trimmed(turns):
        return "".join(f"<{r}>{t.strip()}\n" for r, t in turns)

    return last_user_only, trimmed


last_user_only, trimmed = templates()


def test_templates_that_change_history_are_detected():
    turns = [("user", "one"), ("assistant", "two"), ("user", "three"), ("assistant", "four")]
    assert chat.rewriting(chat.instruct, [turns]) == []
    assert chat.rewriting(last_user_only, [turns[:3], turns]) == [(1, 3)]
    state, rows = chat.Rendering(last_user_only, None), []
    for turn in turns:
        piece, offset, *_ = state.add(*turn)
        rows.append((offset, piece))
    assert chat.applied(rows) == last_user_only(turns)


def test_rewritten_or_trimmed_turns_are_marked_and_not_read_back(spark):
    rows = [(1, 0, "user", " a "), (1, 1, "assistant", "bc"), (1, 2, "user", "d"), (1, 3, "assistant", "ef")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = chat.format_conversations(df, last_user_only, None).orderBy("place").collect()
    assert [r.rewrites for r in got] == [False, False, False, True]
    assert [r.located for r in chat.format_conversations(df, trimmed).orderBy("place").collect()] == [False, True, True, True]
    with pytest.raises(Exception, match="can't be read back"):
        chat.read_back(chat.format_conversations(df, trimmed)).collect()


def slow(turns):
    text = "".join(f"{r}\n{t}\n" for r, t in turns)
    learnt = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(chat.instruct(turns))


def test_hard_rows(spark):
    """Nulls, repeated rows and turns, one long conversation, long texts, clashing columns, empty tables."""
    rng = random.Random(5)
    rows = [(7, i, *turn) for i, turn in enumerate(conversation(rng, 5000))]
    rows += [(1, 0, "user", None), (1, 1, None, "x"), (1, None, "assistant", "first"), (2, 0, "user", "same"), (2, 0, "user", "same"), (2, 0, "assistant", "tie")]
    rows += [(None, 1, "assistant", "nobody's"), (3, 0, "assistant", "</s>\\" * 100_000)]
    df = spark.createDataFrame([(*r, "piece", 9) for r in rows], f"{SCHEMA}, piece string, place long")
    wanted = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        wanted.setdefault(conv, []).append((role or "", text or ""))
    got = {r[0]: tuple(r)[1:] for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got == {c: slow(t) for c, t in wanted.items()}
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0


def test_whole_and_short_context_agree(spark, data):
    df = spark.read.parquet(f"{data}/conversations.parquet")
    whole, short = (sorted(map(tuple, chat.format_conversations(df, context=c).collect())) for c in (None, 2))
    assert whole == short


def test_a_rewrite_far_back_is_seen(spark):
    """A template that drops the first turn once five follow it: by the last two turns alone it looks harmless."""

    def dropping(turns):
        return chat.instruct(turns[1:] if len(turns) > 5 else turns)

    rows = [(1, k, ("user", "assistant")[k % 2], f"text {k}") for k in range(8)]
    found = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), dropping)
    assert [r.rewrites for r in found.orderBy("place").collect()] == [False] * 5 + [True, False, False]

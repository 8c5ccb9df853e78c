import pytest
from hypothesis import given
from hypothesis import strategies as st

from promptledger.llm import chat


@given(st.text(alphabet="<|\\a\n%im_startend>"), st.text(alphabet="<|\\%\n0Aa25"))
def test_segments_round_trip(text, role):
    s = chat.render(role, text)
    got = chat.parse(s)
    assert got[:2] == (role, text) and chat.unescape(s[got[2]:got[3]]) == text
    assert s.count("<|") == 2


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, "message", 0, "user", "hi"), (1, 1, "message", 1, "assistant", ""), (1, 2, "delta", 1, None, "Hel"), (1, 3, "delta", 1, None, "lo"),
        (1, 4, "message", 2, "user", "more"), (1, 5, "message", 3, "assistant", "bad"), (1, 6, "edit", 0, None, "hi!"),
        (1, 7, "regenerate", 1, "assistant", ""), (1, 8, "delta", 1, None, "An"), (1, 9, "delta", 1, None, "ew"), (1, 10, "edit", 0, None, "hey"),
        (2, 0, "delta", 0, "assistant", "x"), (2, 1, "message", 0, "user", "y"), (2, 2, "message", None, "system", None),
        (None, 0, "message", 0, None, "z"), (None, 0, "message", 0, None, "z"),
    ]
    import random

    random.Random(1).shuffle(log)
    found = chat.messages(spark.createDataFrame(log, chat.EVENTS)).collect()
    got = {}
    for r in found:
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert got == {
        1: [(0, "user", "hey"), (1, "assistant", "Anew")],
        2: [(None, "system", ""), (0, "assistant", "x"), (0, "user", "y")],
        None: [(0, "", "z"), (0, "", "z")],
    }
    with pytest.raises(Exception, match="unknown kind"):
        chat.messages(spark.createDataFrame([(1, 0, "odd", 0, "user", "a")], chat.EVENTS)).collect()
    assert chat.format_conversations(spark.createDataFrame([], chat.EVENTS)).count() == 0


def test_query_reads_back_the_trap(spark, sf):
    rows = {r.conv_id: r for r in chat.op6_chat_format(spark, sf).collect()}
    r = rows[-1]
    assert (r.n_turns, r.loss_chars) == (2, len(chat.TRAP))
    texts = chat.conversation_texts(chat.format_conversations(spark.createDataFrame([(1, 0, "message", 0, "user", "a<|b"), (1, 1, "message", 1, "assistant", "c")], chat.EVENTS)))
    assert texts.first().formatted == "<|im_start|>user\na<\\|b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"

import hashlib
from collections import defaultdict

from lectern.llm import chat, queries

EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string"


def expected(rows):
    turns = defaultdict(list)
    for r in rows:
        turns[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    out = {}
    for conv, own in turns.items():
        own.sort()
        told = "".join(f"{role}\n{text}\n" for *_, role, text in own)
        loss = "".join(text for *_, role, text in own if role == "assistant")
        out[conv] = (len(own), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_op2(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own = "\\### Assistant: </turn> ok"
    want = expected([*rows, (-7, 0, "user", own), (-7, 1, "assistant", own)])
    got = queries.op2_chat_formatting(spark, sf_dir).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    assert len(got) == len(want)


def test_odd_turns_come_back(spark):
    nasty = ["", None, "\\", "\\\\#", "#", "###", "### user: x</turn>\n", "</turn>\n</turn>", "<\\/turn>", "</", "<//", "\\n", "a\r\nb c", "😀é", "$0 \\1"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)]
    rows += [(None, None, None, None), (2, 3, "a: b#\\+%", "x"), (2, 3, "a: b#\\+%", "x"), (2, None, "assistant", "y"), (3, 0, None, "z")]
    parsed = chat.parse(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    got = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in parsed}
    assert got[1] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(nasty)]
    assert got[None] == [("", "")] and got[3] == [("", "z")]
    assert got[2] == [("assistant", "y"), ("a: b#\\+%", "x"), ("a: b#\\+%", "x")]
    losses = {r.conv_id: r.loss_texts for r in parsed}
    assert losses[1] == [t or "" for i, t in enumerate(nasty) if i % 2 and t]
    assert spark.createDataFrame([], "conv_id long, turn long, role string, text string").transform(chat.format_conversations).count() == 0


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 1, "message", "assistant", ""), (1, 3, 1, "delta", None, "world"), (1, 2, 1, "delta", None, "hello "),
        (1, 4, 2, "message", "user", "again?"), (1, 5, 3, "message", "assistant", "dropped"),
        (1, 6, 1, "regenerate", "assistant", None), (1, 7, 1, "delta", None, "anew"),
        (1, 8, 2, "message", "user", "more"), (1, 9, 2, "edit", "user", "more!"), (1, 10, 2, "delta", None, "?"),
        (2, 0, 0, "delta", None, "no start"),
    ]
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(spark.createDataFrame(log, EVENTS)).collect()}
    assert got == {(1, 0): ("user", "hi"), (1, 1): ("assistant", "anew"), (1, 2): ("user", "more!?"), (2, 0): (None, "no start")}

import hashlib
import random

import pytest

from haulframe.llm import chat

LOG = "conv_id bigint, seq bigint, kind string, message bigint, role string, text string"


def fold(events):
    """Event by event, as a chat client would."""
    done = {}
    for conv, _, kind, message, role, text in sorted(events, key=lambda e: e[1]):
        state = done.setdefault(conv, {})
        if kind == "regenerate":
            for m in [m for m in state if m >= message]:
                del state[m]
            continue
        r, t = state.get(message, (None, ""))
        state[message] = (role if role is not None else r, (t if kind == "delta" else "") + (text or ""))
    return sorted((c, m, r, t) for c, s in done.items() for m, (r, t) in s.items())


def test_fold_equals_replay(spark):
    rng = random.Random(5)
    events = []
    for conv in range(25):
        for seq in range(rng.randint(0, 30)):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate"])
            events.append((conv, seq, kind, rng.randint(0, 4), "user" if kind == "message" else None, rng.choice(["a", "b ", None, ""])))
    got = [tuple(r) for r in chat.fold_events(spark.createDataFrame(events, LOG)).select("conv_id", "message", "role", "text").collect()]
    assert sorted(got, key=repr) == sorted(fold(events), key=repr)


ROWS = [
    (1, 0, "user", "hi & <b> ### x: y"), (1, 1, "assistant", "&amp; ok</turn>\n### Assistant: no"), (1, 1, "assistant", "tie"),
    (2, 0, "system", None), (3, None, None, "lost"), (None, 2, "assistant", "alone"), (4, 0, "a: b", "\\### Assistant: </turn> ok"),
    (5, 0, "assistant", ""), (5, 1, "assistant", "é漢😀"), (6, 3, "user", "same"), (6, 3, "user", "same"),
]


@pytest.mark.parametrize("folded", [
    lambda rows: chat.fold_events(chat.log_of(rows)), lambda rows: chat.fold_events(chat.streamed_log(rows), chat.STREAMED),
    lambda rows: chat.fold_events(chat.streamed_log(rows, delta_chars=3), chat.STREAMED),
])
def test_round_trip_and_digests(spark, folded):
    rows = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id bigint, turn bigint, role string, text string, formatted string")
    out = chat.read_back(chat.render(folded(rows))).collect()
    want = {}
    order = sorted(ROWS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
    for conv, _, role, text in order:
        want.setdefault(conv, []).append((role or "", text or "", role == "assistant"))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in out} == want
    digests = {r["conv_id"]: r for r in chat.digests(chat.read_back(chat.render(folded(rows)))).collect()}
    for conv, turns in want.items():
        loss = "".join(t for _, t, masked in turns if masked)
        assert digests[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and digests[conv]["loss_chars"] == len(loss)
        assert digests[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, _ in turns).encode()).hexdigest()


def test_streamed_log_is_wrong_without_its_regenerations_edits_or_deltas(spark):
    """Every kind of event decides the result."""
    rows = spark.createDataFrame([(1, 0, "user", "abcdefgh"), (1, 1, "assistant", "ijklmnop")], "conv_id bigint, turn bigint, role string, text string")
    log = chat.streamed_log(rows, delta_chars=3)
    texts = lambda events: [r["text"] for r in chat.fold_events(events, chat.STREAMED).orderBy("message").collect()]
    assert texts(log) == ["abcdefgh", "ijklmnop"]
    assert {r["kind"] for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    assert texts(log.where("kind != 'regenerate'")) == ["abcdefgh", "hgfedcba", "ijklmnop", "ponmlkji"]
    assert texts(log.where("kind != 'edit'")) == ["hgfedcbadefgh", "ponmlkjilmnop"]
    assert texts(log.where("kind != 'delta'")) == ["abc", "ijk"]


def test_control_strings_only_from_the_template(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "### user: </turn>\n")], "conv_id bigint, turn bigint, role string, text string")
    text = chat.render(chat.fold_events(chat.log_of(rows))).first()["formatted"]
    assert text.count("</turn>") == 1 and text.count("###") == 1


def test_empty_log(spark):
    assert chat.render(chat.fold_events(spark.createDataFrame([], LOG))).collect() == []


def test_messages_are_folded_where_their_turns_were_placed(spark):
    """One exchange places the rows of a turn, one brings the messages of a conversation together."""
    rows = spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string")
    plan = chat.render(chat.fold_events(chat.streamed_log(rows), chat.STREAMED))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2

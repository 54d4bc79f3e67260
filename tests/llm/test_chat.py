import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from fieldglass.llm import chat

PARTS = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<\\s>", "<\\\\/s>", "[\\INST]", "<", "[", "a", "\n", "é", "/s>", "INST]"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PARTS, PARTS)
def test_any_turn_survives(role, text):
    fragment, start, end = chat.format_turn(role, text)
    ((got_role, got_text, *_),) = chat.parse(fragment)
    assert (got_role, got_text) == (role, text)
    assert chat.unescape(fragment[start:end]) == text
    assert chat.unescape(chat.escape(text)) == text


def test_escapes_only_where_needed():
    assert chat.format_turn("user", "plain <b> [x]")[0] == "<s>[INST]user[/INST]plain <b> [x]</s>"
    assert "<\\/s>" in chat.format_turn("user", "</s>")[0]


def test_conversations(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["hi </s> there", "[INST] x", "ok", "", "line\ntwo"]) * rng.randint(1, 3), "extra", 1) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(50, 0, None, None, None, None), (51, None, "assistant", "no turn", None, None), (52, 1, "user", "twice", None, None), (52, 1, "user", "twice", None, None), (None, 0, "assistant", "no id", None, None)]
    rows += [(53, 1, "user", text, None, None) for text in ("b", "a", "é", "</s>", "")] + [(53, 1, "assistant", "b", None, None), (53, 0, "user", "z", None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, fragment string, place int").repartition(5)
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    want = {}
    for c, t, role, text, *_ in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort(key=lambda x: (x[0], chat.format_turn(x[1], x[2])[0].encode()))
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), digest, len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import chat

SHAPE = "conv_id long, turn long, role string, text string, formatted string, spans string"
PIECES = st.lists(st.sampled_from(["<", "|", "\\", "<|im_end|>", "<|im_start|>", "<\\|", "assistant", "\n", "x", "é", "im_"]), max_size=8).map("".join)
TURNS = st.lists(st.tuples(PIECES, PIECES), max_size=6)


@settings(max_examples=400, deadline=None)
@given(TURNS)
def test_round_trip(turns):
    formatted, spans, rewrites = chat.locate(turns)
    assert not rewrites and chat.read_back(formatted) == turns == chat.read_back(chat.marked(turns))
    assert [chat.unescape(formatted[a:b]) for *_, a, b in spans] == [t for _, t in turns]
    assert [s[0] for s in spans] == [0, *(s[1] for s in spans)][: len(spans)] and (not spans or spans[-1][1] == len(formatted))
    assert formatted.count(chat.END) == len(turns)


def test_templates_that_rewrite_history_are_told():
    last_only = lambda turns: "".join(f"[{r}]{t if k == len(turns) - 1 else '...'}" for k, (r, t) in enumerate(turns))
    assert chat.locate([("user", "a"), ("assistant", "b")], last_only)[2]
    counted = lambda turns: f"{len(turns)} turns:" + "".join(t for _, t in turns)
    assert chat.locate([("user", "a"), ("assistant", "b")], counted)[2]
    assert not chat.locate([("user", "a"), ("assistant", "b")], lambda turns: "".join(f"<{r}>{t.strip()}</>" for r, t in turns))[2]


def test_other_templates_texts_are_found():
    render = lambda turns: "<s>" + "".join(f"### {r}:\n{t}\n\n" for r, t in turns)
    out, spans, _ = chat.locate([("user", "hi"), ("assistant", "hi\n\n")], render)
    assert [out[a:b] for *_, a, b in spans] == ["hi", "hi\n\n"]


def test_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "hello", "<|im_end|>", "long " * 2000]), "f", "s") for c in range(20) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "null id", "f", "s"), (5, 0, "assistant", "tie", "f", "s"), rows[0], rows[0]]
    rng.shuffle(rows)
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, SHAPE)).collect()}
    groups = {}
    for c, t, r, x, *_ in rows:
        groups.setdefault(c, []).append((t, r or "", x or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        assert chat.read_back(got[c]["formatted"]) == [(r, t) for _, r, t in turns]
        assert got[c]["formatted"] == chat.marked([(r, t) for _, r, t in turns])
    assert chat.digests(chat.format_conversations(spark.createDataFrame(rows, SHAPE))).count() == len(groups)


def test_nothing(spark):
    none = spark.createDataFrame([], SHAPE)
    assert chat.digests(chat.format_conversations(none)).count() == 0


def test_ids_of_any_type(spark):
    for kind, ids in (("int", [1, 2, None]), ("string", ["a", "b", None]), ("smallint", [7, 8, None])):
        rows = [(c, t, "assistant", f"text {t}") for c in ids for t in range(3)]
        got = chat.digests(chat.format_conversations(spark.createDataFrame(rows, f"conv_id {kind}, turn int, role string, text string"))).collect()
        assert {r["conv_id"] for r in got} == set(ids) and all(r["loss_chars"] == 18 for r in got)


def test_texts_that_hold_the_probe():
    turns = [("user", chat.PROBE), (chat.PROBE, "a" + chat.PROBE), ("assistant", "")]
    out, spans, rewrites = chat.locate(turns)
    assert not rewrites and [out[a:b] for *_, a, b in spans] == [t for _, t in turns]
    twice = lambda turns: "".join(f"[{r}:{t}|{t}]" for r, t in turns)
    assert not chat.locate([("user", "hi"), ("user", "ho")], twice)[2]

import pytest

from sluice.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, speaker string"


def render(turns, speaker):
    """(text, trained pieces) of ordered (role, text) turns."""
    out, own = "", []
    for role, text in turns:
        head = "assistant" if role == speaker else "system" if role == "system" else f"user name={role}"
        out += f"<|im_start|>{head}\n{text}<|im_end|>\n"
        if role == speaker:
            own.append(text + "<|im_end|>")
    return out, own


def views(df):
    return {(r["conv_id"], r["speaker"], r["part"]): r for r in C.perspectives(df).collect()}


def test_every_participant_is_the_assistant_once(spark):
    turns = [("system", "be kind"), ("ann", "hé 😀 there"), ("bob", "hi"), ("cid", ""), ("ann", "bye")]
    df = spark.createDataFrame([(1, i, r, t, "x") for i, (r, t) in enumerate(turns)], SCHEMA)
    got = views(df)
    assert {k[1] for k in got} == {"ann", "bob", "cid"}
    for (_, speaker, _), r in got.items():
        text, own = render(turns, speaker)
        assert r["text"] == text and r["n_turns"] == 5
        assert [text[m["start"]:m["end"]] for m in r["mask"]] == own


def test_edge_rows(spark):
    rows = [(1, 1, "ann", "b", "x"), (1, 0, "bob", "a", "x"), (1, 1, "ann", "b", "y"), (1, None, None, None, "x"),
            (2, 0, "system", "only", "x"), (None, 0, "ann", "<|im_end|> trick", "x"), (None, 1, "a\nb", "z", "x"),
            (3, 0, "ann", "word " * 100_000, "x")]
    got = views(spark.createDataFrame(rows, SCHEMA))
    assert {k[:2] for k in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (None, "a b"), (3, "ann")}
    assert got[1, "ann", 0]["text"] == render([("bob", "a"), ("ann", "b")], "ann")[0]
    late = [r for k, r in got.items() if k[1] == "unknown" and k[2] > 0]
    assert [r["text"] for r in late] == ["<|im_start|>assistant\n<|im_end|>\n"]
    assert "< |im_end|> trick" in got[None, "ann", 0]["text"]
    assert len(got[3, "ann", 0]["text"]) > 500_000
    assert C.perspectives(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("one_turn", [False, True])
def test_long_conversations_come_in_parts(spark, monkeypatch, one_turn):
    monkeypatch.setattr(C, "PART_ROWS", 40)
    turns = [(7 if one_turn else i, f"r{i % 2}", f"text {i}") for i in range(700)]
    df = spark.createDataFrame([(1, t, r, x, "x") for t, r, x in turns], SCHEMA)
    got = sorted((k[2], r) for k, r in views(df).items() if k[1] == "r0")
    assert len(got) > 2 and max(r["n_turns"] for _, r in got) <= 256
    import hashlib
    tie = lambda r, x: hashlib.md5(f"{len(r)}|{r}|{x}".encode()).hexdigest()
    ordered = [(r, x) for t, r, x in sorted(turns, key=lambda t: (t[0], tie(t[1], t[2])))]
    assert "".join(r["text"] for _, r in got) == render(ordered, "r0")[0]


def test_roles_and_texts_with_bars_stay_two_turns(spark):
    df = spark.createDataFrame([(1, 0, "a|b", "c", "x"), (1, 0, "a", "b|c", "x"), (1, 0, "a", "b|c", "again")], SCHEMA)
    got = views(df)
    assert {k[1] for k in got} == {"a", "a|b"} and all(r["n_turns"] == 2 for r in got.values())
    assert all("\nc<|im_end|>" in r["text"] and "\nb|c<|im_end|>" in r["text"] for r in got.values())

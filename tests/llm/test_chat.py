import hashlib
import random

from quillsieve.llm import chat


def test_escape_round_trip():
    rng = random.Random(1)
    pieces = ["<", "|", ">", "\\", "s", "/", "[", "INST", "]", "n", "\n", "<|end|>", "</s>", "[/INST]", "é"]
    for _ in range(5000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        held = chat.escape(text)
        assert chat.unescape(held) == text
        assert not any(c in held for c in chat.CONTROL)
        assert chat.read_turns(chat.render(text, text)[0] + chat.render("x", "y")[0]) == [(text, text), ("x", "y")]


def test_windows_of_random_conversations():
    rng = random.Random(2)
    for _ in range(500):
        turns = [("system" if not i and rng.random() < 0.5 else rng.choice(["user", "assistant"]), f"{i}" * rng.randint(0, 5), rng.randint(1, 40)) for i in range(rng.randint(0, 9))]
        now, windows = chat._Conversation(1, 60, 25), []
        for t in turns:
            windows += now.add(*t)
        windows += now.end()
        assert [x for w in windows for x in chat.read_turns(w["text"])[w["n_repeated"] :]] == [t[:2] for t in turns]
        assert [w["text"][a:b] for w in windows for a, b in zip(w["loss_starts"], w["loss_ends"], strict=True)] == [t[1] for t in turns if t[0] == "assistant"]
        for w in windows:
            assert w["tokens"] <= 60 or w["n_turns"] - w["n_repeated"] == 1 or w["n_turns"] <= 2
            if turns and turns[0][0] == "system":
                assert chat.read_turns(w["text"])[0] == turns[0][:2]


def test_digests_of_a_table(spark):
    rows = [(1, 0, "system", "be kind", "a"), (1, 2, "assistant", "x " * 700, "b"), (1, 1, "user", None, "c"), (1, 3, "user", "q", "d"), (1, 4, "assistant", "</s>[INST] ok [/INST]", "e"), (2, 0, None, "n", "f"), (None, 0, "user", "z", "g"), (2, 0, None, "n", "f")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tokens string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(frame)).collect()}
    assert set(got) == {1, 2, None}
    order = sorted((r for r in rows if r[0] == 1), key=lambda r: r[1])
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r[2]}\n{r[3] or ''}\n" for r in order).encode()).hexdigest()
    said = "".join(r[3] for r in order if r[2] == "assistant")
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["n_windows"]) == (5, len(said), 3)
    assert got[1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[2]["n_turns"] == 2 and got[2]["turns_sha256"] == hashlib.sha256(b"\nn\n\nn\n").hexdigest()
    assert chat.digests(chat.format_conversations(frame.limit(0))).count() == 0

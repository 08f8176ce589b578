import re

import pytest

from quillsieve.operators import measure as m
from quillsieve.operators.readers import LineReader


class Counting(LineReader):
    """Notes every prompt that it answers in a file; stops at one prompt if that is set."""

    name = "counting"

    def __init__(self, log: str, stop: str | None = None):
        super().__init__(1, 2)
        self.log, self.stop = log, stop

    def generate(self, contexts, questions):
        if self.stop and any(self.stop == f"{q}|{c}" for c, q in zip(contexts, questions, strict=True)):
            raise RuntimeError("stopped")
        with open(self.log, "a") as f:
            f.writelines(f"{q}|{c}".replace("\n", "/") + "\n" for c, q in zip(contexts, questions, strict=True))
        return super().generate(contexts, questions)


SCHEMA = "doc_id string, question string, answers array<string>, chunks array<string>, masks array<array<boolean>>, extra int"
T, N = True, False
DOCS = [
    ("a", "blue sky", ["the sky"], ["the sky is blue", "a cat sat"], [[T, N], [N, T], [T, N]], 1),  # a repeated mask
    ("b", "blue sky", ["a cat"], ["the sky is blue", "a cat sat"], [[T, N]], 1),  # a copy with other answers
    ("c", None, None, ["the sky is blue"], [[N]], 1),  # the empty context
    ("d", "q", ["x"], [], [], 1),
    ("e", "zebra", ["x y"], ["x y zebra", "", "long " * 5000], [], 1),
]


def expected(docs):
    reader = LineReader(1, 2)
    prompts, rows = set(), {}
    for d, q, answers, chunks, masks, _ in docs:
        if not chunks:
            continue
        contexts = ["\n".join(chunks)] + ["\n".join(c for c, b in zip(chunks, mask, strict=True) if b) for mask in masks]
        prompts |= {f"{q}|{c}".replace("\n", "/") for c in contexts}
        said = [reader.generate([c], [q])[0] for c in contexts]
        rows[d] = (said[0], [float(bool(answers) and x in answers) for x in said[1:]])
    return prompts, rows


def test_each_prompt_once_and_handed_out_to_all(spark, tmp_path):
    log, sink = str(tmp_path / "log"), str(tmp_path / "sink")
    docs = spark.createDataFrame(DOCS, SCHEMA)
    prompts, rows = expected(DOCS)
    got = {r["doc_id"]: r for r in m.measure(docs, Counting(log), sink).collect()}
    asked = open(log).read().splitlines()
    assert sorted(asked) == sorted(prompts) and len(asked) == 6
    assert set(got) == set(rows)
    for d, (full, f1) in rows.items():
        assert got[d]["full_answer"] == full and len(got[d]["f1"]) == len(f1)
    assert got["a"]["f1"] == [1.0, 0.0, 1.0] and got["b"]["f1"] == [0.0] and got["e"]["full_f1"] == 1.0 and got["e"]["f1"] == []
    # More documents on the same sink: only their own prompts are asked.
    more = spark.createDataFrame([*DOCS, ("f", "cat", ["a cat"], ["a cat sat", "the sky is blue"], [[T, N]], 1)], SCHEMA)
    assert m.measure(more, Counting(log), sink).count() == 5
    assert len(open(log).read().splitlines()) == 8
    with pytest.raises(ValueError, match="settings differ"):
        m.measure(docs, Counting(log), sink, {"most": 9})


def test_restart_asks_only_what_is_missing(spark, tmp_path):
    log, sink = str(tmp_path / "log"), str(tmp_path / "sink")
    data = [(f"d{i}", f"q{i % 7}", ["x"], [f"line {i % 9}", "end", f"word {i % 5}"], [[T, N, T], [N, T, N]], 0) for i in range(60)]
    docs = spark.createDataFrame(data, SCHEMA)
    waves = {r["key"]: r["wave"] for r in m.planned(docs, 4).collect()}
    assert set(waves.values()) == {0, 1, 2, 3}
    # Stop at a prompt of the last wave, so that the waves before it are in the sink.
    last = next(d for d in data if waves[m_key(spark, docs, d[0])] == 3)
    with pytest.raises(Exception, match="stopped"):
        m.measure(docs, Counting(log, f"{last[1]}|" + "\n".join(last[3])), sink).count()
    held = {r["key"] for r in m.answers_in(spark, sink).collect()}
    assert held == {k for k, w in waves.items() if w < 3}
    open(log, "w").close()
    assert m.measure(docs, Counting(log), sink).count() == 60
    assert len(open(log).read().splitlines()) == len(set(waves)) - len(held)
    keys = [r["key"] for r in m.answers_in(spark, sink).collect()]
    assert len(keys) == len(set(keys)) == len(waves)
    assert m.measure(docs.limit(0), Counting(log), str(tmp_path / "none")).count() == 0


def m_key(spark, docs, doc_id):
    return m.planned(docs, 4).where(f"doc_id = '{doc_id}' AND k = -1").first()["key"]


def test_no_context_is_shuffled_with_the_queue(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    plan = m.queue(m.planned(docs, 4))._jdf.queryExecution().executedPlan().toString()
    between = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert set(between) == {"key"} and "partial_min" in plan

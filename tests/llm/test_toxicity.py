import random
import zlib

import numpy as np

from quillsieve.llm import toxicity as t


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubdglmnprst") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    docs, labels = [], []
    for i in range(n):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 30))) + "." for _ in range(rng.randint(1, 5))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                word = rng.choice(["grobnak", "zwerfel", "velkh" + rng.choice(vocabulary), "velkh" + rng.choice(vocabulary)])
                k = rng.randrange(len(lines))
                lines[k] = lines[k].replace(" ", f" {word} ", 1)
        docs.append((i, "\n".join(lines)))
        labels.append((i, toxic))
    return docs, labels


def test_grammar_marks_scopes():
    machine = t.grammar()
    run = lambda *tags: [(x, set(s)) for x, s in machine.run([(g, frozenset()) for g in tags])[0]]
    assert run(t.TARGET, t.OTHER, t.INSULT)[-1] == (t.INSULT, {"target"})
    assert run(t.NEGATION, t.INSULT)[-1] == (t.INSULT, {"negated"})
    assert run(t.NEGATION, t.OTHER, t.OTHER, t.OTHER, t.INSULT)[-1] == (t.INSULT, set())
    assert run(t.REPORT, t.TARGET, t.OTHER, t.THREAT)[-1] == (t.THREAT, {"reported", "target"})


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    odd = [(5000, None), (5001, ""), (5002, "you are a grobnak"), (5002, "you are a grobnak"), (None, "grobnak"), (5003, "word " * 50_000 + "zwerfel")]
    frame = spark.createDataFrame([(i, x, 0.5) for i, x in docs + odd], "doc_id long, text string, score double")
    marks = spark.createDataFrame([*labels, (5000, None), (9999, 1), (0, None)], "doc_id long, toxic int")
    model = t.fit(frame, marks)
    got = t.scored(frame, model).collect()
    assert len(got) == len(docs) + len(odd)
    said = {r["doc_id"]: r["score"] for r in got}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    wrong = [i for i, y in held if (said[i] >= t.CUT) != bool(y)]
    assert len(wrong) <= 0.02 * len(held)
    assert said[5000] == said[5001] < 0.3 and said[5002] > 0.7 and said[5003] > 0.7 and said[None] > 0.7
    kept = {r["doc_id"] for r in t.without_toxic(frame, marks).collect()}
    assert None not in kept and 5002 not in kept and 5000 in kept
    harmless = t.without_toxic(frame.union(spark.createDataFrame([(None, "a quiet word", 0.5)], frame.schema)), marks)
    assert [r["text"] for r in harmless.where("doc_id is null").collect()] == ["a quiet word"]
    nothing = t.fit(frame, marks.limit(0))
    assert {r["score"] for r in t.scored(frame, nothing).collect()} == {0.5}
    assert t.scored(frame.limit(0), model).count() == 0


def test_words_stay_where_the_documents_lie(spark, monkeypatch):
    """The driver gets signatures and keys of several toxic documents, not the words of each."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
    docs = [(i, " ".join(word() for _ in range(400)) + " grobnak" * (i % 4 == 0)) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs], "doc_id long, toxic int")
    plain, sizes = type(frame).toArrow, []

    def watched(self):
        out = plain(self)
        sizes.append(out.nbytes)
        return out

    monkeypatch.setattr(type(frame), "toArrow", watched)
    model = t.fit(frame, marks)
    assert "grobnak" in model.whole and max(sizes) < 0.1 * sum(len(x) for _, x in docs)


def test_evidence_of_many_at_once():
    a, b = [0, 1, 3, 50, 7, 200], [0, 0, 40, 2, 7, 900]
    many = t._evidences(np.array(a), np.array(b), 300, 2000)
    assert np.allclose(many, [t._evidence(x, y, 300, 2000) if x else 0.0 for x, y in zip(a, b, strict=True)])

import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa

from quillsieve.llm import filters, scan


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(docs, labels):
    """The audit by walking each document through each order."""
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, t in labels if t == 1} - {None}
    fails = []
    for d, text, _ in docs:
        text, w = text or "", words(text)
        copy = d is not None and any(x is not None and x < d and (t or "") == text for x, t, _ in docs)
        caps = sum("A" <= c <= "Z" for c in text)
        fails.append({"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * caps > 10 * len(text), "D": any(c in "#$%&*|" for c in text), "E": copy})
    out = {}
    for order in map("".join, permutations("ABCDE")):
        gone = [False] * len(docs)
        for step, x in enumerate(order, 1):
            for part in {lang or "" for _, _, lang in docs}:
                own = [k for k, (_, _, lang) in enumerate(docs) if (lang or "") == part]
                removed = [k for k in own if fails[k][x] and not gone[k]]
                out[part, order, step] = [
                    sum(not gone[k] and not fails[k][x] for k in own), len(removed), sum(fails[k][x] and gone[k] for k in own),
                    sum(fails[k][x] and sum(fails[k].values()) == 1 for k in own), sum(docs[k][0] in good for k in removed), sum(docs[k][0] in toxic for k in removed)]
            gone = [g or fails[k][x] for k, g in enumerate(gone)]
    total = {}
    for (part, order, step), row in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + row[1]
    return {k: [*row, total[k[0], k[1][k[2] - 1]]] for k, row in out.items()}


def test_audit_against_brute_force(spark):
    rng = random.Random(3)
    pieces = ["ä", "word", "Word", "WORD", "é#", "a|b", "x" * 20, "naïve", " ", "日本語", "$", "longer-than-eight-bytes", "longer-than-eight-bites"]
    docs = []
    for i in range(120):
        few = rng.sample(pieces, rng.randint(1, 5)) if i % 3 else [f"w{k}" for k in range(150)]
        text = rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t", "\x0b\n "]).join(rng.choice(few) for _ in range(rng.choice([0, 3, 99, 100, 140])))
        docs.append((i, text, rng.choice(["en", "de", None, ""])))
    docs += [(500 + k, docs[k][1], "en") for k in range(30)] + [(7, docs[7][1], "en"), (None, docs[8][1], "fr"), (600, None, "fr"), (601, "", "fr"), (602, "w " * 60_000, "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 620, 3)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame([(d, t, g, 1, 2) for d, t, g in docs], "doc_id long, text string, lang string, good int, fails int").repartition(5)
    got = filters.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got.collect()}
    assert found == brute(docs, labels)
    assert filters.audit(frame.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_string_ids(spark):
    frame = spark.createDataFrame([("a", "same", "en"), ("b", "same", "en")], "doc_id string, text string, lang string")
    row = filters.audit(frame, spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int")).where("filter_order = 'EABCD' and step = 1").first()
    assert (row["removed"], row["good_lost"], row["kept"]) == (1, 1, 1)


def test_scan_in_slices(monkeypatch):
    rng = random.Random(4)
    texts = [None, "", " ", *["".join(rng.choice("ab c\nä\x0b") for _ in range(rng.randint(0, 60))) for _ in range(300)]]
    monkeypatch.setattr(scan, "SLICE", 100)
    for column in (pa.array(texts), pa.array(["x", *texts, "y"], pa.large_string()).slice(1, len(texts))):
        got = []
        for first, last, data, ends in scan.slices(column):
            starts, lengths = scan.word_spans(data, ends)
            owner = np.searchsorted(ends, starts, side="right") - 1
            count = scan.distinct_words(data, scan.eights(data), starts, lengths, owner, last - first)
            for k in range(last - first):
                got.append((int(count[k]), [data[s : s + n].tobytes().decode() for s, n in zip(starts[owner == k], lengths[owner == k], strict=True)]))
        assert got == [(len(set(words(t))), words(t)) for t in texts]


def test_words_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(scan, "word_hashes", lambda at, starts, lengths: np.zeros(len(starts), np.uint64))
    column = pa.array(["a b a c", "a a", "", "b c d e"])
    (first, last, data, ends), = scan.slices(column)
    starts, lengths = scan.word_spans(data, ends)
    owner = np.searchsorted(ends, starts, side="right") - 1
    assert scan.distinct_words(data, scan.eights(data), starts, lengths, owner, 4).tolist() == [3, 1, 0, 4]

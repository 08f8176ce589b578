import itertools
import math
import random
import re

from quillsieve.llm import decontaminate as d


def words(t):
    return [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]


def brute(docs, items):
    out = {}
    for doc_id, text in docs:
        w = words(text)
        for item_id, passage in items:
            b = words(passage)
            n = min(13, len(b))
            if n == 0:
                continue
            for at in range(-len(b) + 1, len(w)):
                same = [int(0 <= at + k < len(w) and w[at + k] == b[k]) for k in range(len(b))]
                best = max(sum(same[s : s + n]) for s in range(len(b) - n + 1))
                if best >= math.ceil(n * 0.8):
                    out[doc_id, item_id] = max(best, out.get((doc_id, item_id), 0))
    return out


def test_any_two_substitutions_leave_a_mask_whole():
    for gone in itertools.combinations(range(13), 2):
        assert any(all(c == "0" or i + k not in gone for k, c in enumerate(m)) for m in d.MASKS for i in range(14 - len(m)))


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(200)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(13, 40)))) for i in range(12)]
    docs = []
    for k in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if k % 2:
            part = items[k % 12][1].split(" ")
            part = part[: rng.randint(10, len(part))]
            for _ in range(rng.randint(0, 4)):
                part[rng.randrange(len(part))] = "other"
            at = rng.randint(0, len(w))
            w[at:at] = [p.upper() + rng.choice(["", ",", "."]) for p in part]
        docs.append((k, " ".join(w)))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (103, "la " * 3000)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([*items, (50, None), (51, "too short"), (52, "la " * 30)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_matched"] for r in d.contaminated(frame, bench).collect()}
    want = brute(docs, items)
    want[103, 52] = 13
    assert got == want
    kept = {r["doc_id"] for r in d.decontaminate(frame, bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}
    assert d.contaminated(frame.limit(0), bench).count() == 0 and d.contaminated(frame, bench.limit(0)).count() == 0


def test_masks_of_short_items_allow_any_substitutions():
    for n in range(1, 13):
        for gone in itertools.combinations(range(n), n - math.ceil(n * d.SIMILARITY)):
            assert any(all(c == "0" or at + k not in gone for k, c in enumerate(m)) for at, m in d.short_masks(n)), (n, gone)


def test_short_items_against_brute_force_and_sql(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(1 + i % 14))) for i in range(28)]
    docs = []
    for k in range(140):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        part = items[k % 28][1].split(" ")
        for at in rng.sample(range(len(part)), min(len(part), rng.randint(0, 2))):
            part[at] = "other"
        at = rng.choice([0, len(w), rng.randint(0, len(w))])
        w[at:at] = part
        docs.append((k, " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_matched"] for r in d.contaminated(frame, bench).collect()}
    want = brute(docs, items)
    assert got == want
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    assert {(a, b): c for a, b, c in con.sql(d.SQL).fetchall()} == want

import re

import numpy as np
import xxhash

from quillsieve.llm import simhash


def brute(docs, size=3):
    prints = {}
    for k, (doc_id, text) in enumerate(docs):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        runs = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
        prints[k] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    head = list(range(len(docs)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                head[find(b)] = find(a)
    groups = {}
    for k in prints:
        groups.setdefault(find(k), []).append(docs[k][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((docs[k][0], f"{prints[k]:016x}", least[find(k)]) for k in prints), key=str)


def rows(spark, docs):
    made = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, fp string")
    found = simhash.near_duplicates(made)
    return sorted(((r[0], f"{r[1] & (1 << 64) - 1:016x}", r[2]) for r in found.select("doc_id", "fp", "component_id").collect()), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "ABC"]
    base = [" ".join(rng.choice(vocabulary, rng.integers(1, 60))) for _ in range(30)]
    docs = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        w = base[i % 30].split(" ")
        for _ in range(i % 3):
            w[rng.integers(len(w))] = "X"
        docs.append((100 + i, " ".join(w)))
    docs += [(500, None), (501, ""), (502, " \n\t"), (503, "one"), (503, "one"), (None, "two words"), (504, "TWO words"), (505, "lang " * 5000)]
    assert rows(spark, docs) == brute(docs)


def test_links_of_planted_distances(spark):
    rng = np.random.default_rng(4)
    values = set()
    for x in rng.integers(-(2**63), 2**63 - 1, 40):
        y = int(x) & (1 << 64) - 1
        for flips in (0, 1, 2, 3, 4):
            z = y
            for b in rng.choice(64, flips, replace=False):
                z ^= 1 << int(b)
            values.add(z)
    values |= {0, 1 << 63, 1, 3, (1 << 63) | 1}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    got = simhash.linked(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_keep_one_and_empty(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", "s"), (1, "a b c d e f", "t"), (1, "a b c d e f", "t"), (None, "q", "u"), (7, None, "v"), (8, "", "v")], "doc_id long, text string, source string")
    assert sorted(str(r[0]) for r in simhash.keep_one(docs).collect()) == ["1", "7", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_copies_at_anchors_are_not_broadcast(spark):
    """33 rows of each fingerprint are taken by Spark for as small as the fingerprints, which it would broadcast."""
    found = simhash.linked(spark.range(1000).selectExpr("xxhash64(id) AS fp"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan

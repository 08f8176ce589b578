import numpy as np

from quillsieve.llm import topk


def brute(rows, asked, k):
    held = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            held.setdefault(i, []).append([int(np.floor(256 * float(x))) for x in v])
    out = []
    for i in asked:
        for q in held.get(i, []):
            scores = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, cs in held.items() if j != i for c in cs if len(c) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_nra_equals_all_scores():
    rng = np.random.default_rng(1)
    for n, d in ((3, 4), (50, 8), (400, 16), (600, 3)):
        block = rng.integers(-5, 6, (n, d)).astype(float)
        ids = rng.permutation(n * 3)[:n]
        queries, owns = rng.integers(-3, 4, (20, d)).astype(float), rng.choice(ids, 20)
        for query, own, (found, scores, _) in zip(queries, owns, topk.nra(block, ids, queries, owns), strict=True):
            want = sorted((-s, i) for s, i in zip(block @ query, ids, strict=True) if i != own)[:5]
            assert [(-s, i) for s, i in zip(scores, found, strict=True)] == want


def test_search_stops_early():
    rng = np.random.default_rng(2)
    block = np.sort(np.abs(rng.normal(0, 100, (2000, 4))).astype(int).astype(float), axis=0)
    found, _, read = next(topk.nra(block, np.arange(2000), np.array([[1.0, 2.0, 1.0, 3.0]]), np.array([-1])))
    assert list(found) == [1999, 1998, 1997, 1996, 1995] and read < 2000


def test_table(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 6)], "c") for i in range(300)]
    rows += [(400 + i, rows[i][1], "copy") for i in range(20)]
    rows += [(500, None, "n"), (550, [], "e"), (600, [0.1, None, 0.0, 0.0, 0.0, 0.0], "h"), (650, [float("nan"), 0.0, 0.0, 0.0, 0.0, 0.0], "f"), (700, [0.5, 0.5], "short"), (701, [0.1, 0.2], "short"), (None, rows[0][1], "x"), (750, [0.0] * 6, "zero")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    asked = [i for i, *_ in rows if i is not None and i % 50 == 0]
    got = sorted(tuple(r) for r in topk.search(frame, frame.where("vec_id % 50 = 0")).collect())
    assert got == brute([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v, _ in rows], asked, 5)
    assert topk.search(frame.limit(0), frame.limit(0)).count() == 0

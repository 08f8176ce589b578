import numpy as np

from quillsieve.llm import sketch


def shingles(text, size=2):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs):
    """Shingles and component of each document, by all pairs."""
    sets = [shingles(t) for _, t in docs]
    head = list(range(len(docs)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                head[find(a)] = find(b)
    ids = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            ids.setdefault(find(k), []).append(d)
    least = [min(ids[find(k)]) if find(k) in ids else None for k in range(len(docs))]
    return sorted(((d, len(sets[k]), least[k], d is not None and d == least[k]) for k, (d, _) in enumerate(docs)), key=repr)


def changed(rng, words, n):
    w = list(words)
    for k in rng.choice(len(w), min(n, len(w)), replace=False):
        w[k] = f"x{rng.integers(1 << 30)}"
    return w


def planted(rng):
    """Families from just above to below the limit, chains of links, a template family, short texts, odd rows."""
    vocabulary = [f"w{i}" for i in range(3000)]
    docs = []
    for k in range(40):
        base = rng.choice(vocabulary, rng.integers(3, 300))
        docs += [changed(rng, base, n) for n in range(0, 1 + len(base) // 12, 1 + len(base) // 60)]
    chain = list(rng.choice(vocabulary, 200))
    for k in range(40):
        docs.append(list(chain))
        chain[k * 5 : k * 5 + 4] = changed(rng, chain[k * 5 : k * 5 + 4], 4)
    template = list(rng.choice(vocabulary, 60))
    docs += [template + list(rng.choice(vocabulary, 30)) for _ in range(60)]
    docs += [["a"], ["A"], ["a", "b"], ["a", "b"], ["b", "a"], ["a", "a", "a"], ["Ä"], ["ä"]]
    return [" ".join(x) for x in docs]


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    docs = list(enumerate(planted(rng)))
    rng.shuffle(docs)
    docs = [(int(i) * 3 % 7919, t) for i, t in docs]
    docs += [(9000, None), (9001, ""), (9002, " \n"), (docs[3][0], docs[3][1]), (None, docs[4][1]), (None, "lonely words here"), (docs[5][0], docs[6][1]), (9003, "word " * 60_000), (9004, "Word " * 50_000)]
    frame = spark.createDataFrame([(d, t, 1, "a") for d, t in docs], "doc_id long, text string, n int, node string").repartition(3)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in sketch.near_duplicates(frame).collect()), key=repr)
    assert got == brute(docs)
    assert sketch.near_duplicates(frame.limit(0)).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(6)
    h = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    whole, first, second = (sketch.registers(x, np.array([0, len(x)])) for x in (h, h[:1000], h[800:]))
    assert (whole == np.maximum(first, second)).all()
    for shared, want in ((0.8, True), (0.95, True), (0.3, False), (0.5, False)):
        n = int(2000 * 2 * shared / (1 + shared))
        a, b = h[:2000], np.r_[h[:n], rng.integers(0, 1 << 63, 2000 - n, dtype=np.uint64)]
        sizes = np.array([2000])
        ra, rb = (sketch.registers(x, np.array([0, len(x)])) for x in (a, b))
        assert sketch.plausible(ra, rb, sizes, sizes)[0] == want
        assert abs((ra == rb).mean() - (1 - 2 * sketch._larger(np.array((1 - shared) / 2)))) < 0.12


def test_large_buckets_in_several_blocks(spark, monkeypatch):
    """A family around a template, most of it just below the limit, compared in blocks of a few sets."""
    monkeypatch.setattr(sketch, "ELEMENTS", 2000)
    monkeypatch.setattr(sketch, "COLUMNS", 64)
    rng = np.random.default_rng(15)
    template = [f"w{i}" for i in range(100)]
    docs = [(k, " ".join(changed(rng, template, int(rng.integers(2, 9))))) for k in range(250)]
    got = sketch.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    want = brute(docs)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in got.collect()), key=repr) == want
    assert 10 < len({c for _, _, c, _ in want}) < 240

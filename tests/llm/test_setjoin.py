import numpy as np

from quillsieve.llm import setjoin, simhash


def shingles(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs):
    """(doc_id, least doc_id of its component), by all pairs."""
    sets = [shingles(t) for _, t in docs]
    head = list(range(len(docs)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                head[find(a)] = find(b)
    groups = {}
    for k in range(len(docs)):
        groups.setdefault(find(k), []).append(docs[k][0])
    return sorted((docs[k][0], min(groups[find(k)])) for k in range(len(docs)))


def test_planted_near_copies_against_brute_force(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(900)]
    passage = " ".join(rng.choice(vocabulary, 40))
    base = [" ".join(rng.choice(vocabulary, rng.integers(1, 260))) + (" " + passage if k % 2 else "") for k in range(60)]
    docs = list(enumerate(base))
    for i in range(180):
        w = base[i % 60].split(" ")
        for _ in range(i // 60 * 2 + 1):
            w[rng.integers(len(w))] = "X"
        docs.append((100 + i, " ".join(w)))
    chain = list(rng.choice(vocabulary, 120))
    for i in range(30):
        chain[i * 4] = f"c{i}"
        docs.append((400 + i, " ".join(chain)))
    docs += [(500, None), (501, ""), (502, " \n\t"), (503, "one"), (504, "One"), (505, "two words")]
    frame = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, source string")
    want = brute(docs)
    assert sorted(tuple(r) for r in simhash.near_copies(frame).collect()) == want
    assert sorted(r[0] for r in simhash.keep_one(frame).select("doc_id").collect()) == sorted({c for _, c in want})
    # Most of these links are more than 2 bits apart.
    near = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(frame, 5).collect()}
    assert len(set(want) - near) > 20


def test_pipeline_stage_drops_planted_near_copies(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(9)
    text = [f"p{i}" for i in rng.integers(0, 5000, 200)]
    changed = [*text[:60], "other", *text[61:140], "words", *text[141:]]
    docs = spark.createDataFrame([(1, " ".join(text), "s"), (2, " ".join(changed), "s"), (3, " ".join(text[:150]), "s")], "doc_id long, text string, source string")
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, str(tmp_path)).collect()) == [1, 3]


def test_nothing_to_link(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "s")], "doc_id long, text string, source string")
    assert simhash.keep_one(docs).count() == 1 and simhash.keep_one(docs.limit(0)).count() == 0
    assert setjoin.SIMILARITY == 0.8


def test_fingerprints_come_first_and_are_checked(spark, monkeypatch):
    """The stage compares what SimHash finds within 2 bits first; texts of one fingerprint but unlike sets both stay."""
    rng = np.random.default_rng(14)
    cycle = " ".join(f"c{i}" for i in range(61))
    long = " ".join([cycle] * 20)
    often = " ".join(["again"] * 200)
    unlike = [often + " " + " ".join(f"{x}{i}" for i in rng.permutation(90)) for x in "ab"]
    docs = spark.createDataFrame([(1, long), (2, long + " more"), (3, unlike[0]), (4, unlike[1]), (5, ""), (6, None)], "doc_id long, text string")
    seen, plain = [], setjoin.similar_sets

    def spied(sets, similarity=0.8, close=None):
        fp = {r["key"]: r["fp"] for r in sets.select("key", "fp").collect()}
        seen.extend((fp[r["u"]], fp[r["v"]]) for r in close.collect())
        return plain(sets, similarity, close)

    monkeypatch.setattr(setjoin, "similar_sets", spied)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [1, 3, 4, 5]
    assert len(seen) == 2 and all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in seen)


def test_buckets_of_many_components_are_compared_whole(spark):
    """A few links among 2,000 sets that share all their buckets with unlike ones: rounds with buckets' ends hardly ever meet them."""
    rng = np.random.default_rng(21)
    universe = np.arange(1, 41) * 7919
    sets = [rng.choice(universe, 10, replace=False) for _ in range(2000)]
    links = set()
    for k in range(4):
        other = sets[k].copy()
        other[0] = next(x for x in universe if x not in sets[k])
        sets[1000 + k] = other
    keys = rng.permutation(1 << 40 - 20)[: len(sets)]
    members = [set(s.tolist()) for s in sets]
    for a in range(len(sets)):
        for b in range(a):
            if len(members[a] & members[b]) >= 9:
                links.add(tuple(sorted((int(keys[a]), int(keys[b])))))
    frame = spark.createDataFrame([(int(k), [int(x) for x in s]) for k, s in zip(keys, sets, strict=True)], "key long, h array<long>")
    parts = {r["node"]: r["component"] for r in setjoin.similar_sets(frame).collect()}
    assert len(links) >= 4 and all(parts.get(u, u) == parts.get(v, v) for u, v in links)
    assert len(parts) - len(set(parts.values())) <= len(links)

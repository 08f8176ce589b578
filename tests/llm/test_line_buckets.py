import numpy as np
from pyspark.sql import functions as F

from quillsieve.llm import lines


def test_candidates_are_linear_in_a_bucket(spark):
    """Each line of a bucket meets its two ends only, and buckets have ends of their own."""
    keys = spark.range(2000).select(F.xxhash64("id").alias("key"))
    members = keys.crossJoin(spark.range(4).select(F.xxhash64("id", F.lit(1)).alias("bucket")))
    pairs = [tuple(r) for r in lines.candidates(members).collect()]
    assert len(pairs) == len(set(pairs)) <= 2 * 4 * 2000 and all(u < v for u, v in pairs)
    met = {}
    for u, v in pairs:
        met.setdefault(u, set()).add(v)
        met.setdefault(v, set()).add(u)
    assert len(met) == 2000 and min(map(len, met.values())) >= 6


def test_recall_of_a_large_family(spark):
    """Chains of near copies, thousands of lines of a few families: the components are those of all pairs, nearly."""
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnop")
    lines_of, family = [], []
    for f in range(6):
        base = rng.choice(letters, 240)
        for _ in range(250):
            x = base.copy()
            x[rng.integers(240)] = rng.choice(letters)  # any two at 0.87 or more
            lines_of.append("".join(x))
            family.append(f)
    docs = spark.createDataFrame(list(enumerate(lines_of)), "doc_id long, text string")
    parts, _ = lines.similar_lines(docs)
    found = {r["node"]: r["component"] for r in parts.collect()}
    placed = docs.select("doc_id", F.xxhash64("text").alias("key")).collect()
    components = [{found.get(r["key"], r["key"]) for r in placed if family[r["doc_id"]] == f} for f in range(6)]
    assert not set.intersection(*components) and sum(map(len, components)) <= 12


def test_lines_that_link_to_no_end_of_their_bucket(spark, monkeypatch):
    """One bucket of many unlike lines with two near copies among them, neither at an end of it; in one block and in many."""
    rng = np.random.default_rng(12)
    text = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 200))
    texts = [text() for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {r["text"]: r["key"] for r in docs.select("text", F.xxhash64("text").alias("key")).collect()}
    inner = sorted(texts, key=lambda x: keys[x])[20]
    copy = inner
    while not min(keys.values()) < spark.range(1).select(F.xxhash64(F.lit(copy))).first()[0] < max(keys.values()) or copy == inner:
        at = int(rng.integers(200))
        copy = inner[:at] + "z" + inner[at + 1 :]
    docs = spark.createDataFrame(list(enumerate([*texts, copy])), "doc_id long, text string")
    monkeypatch.setattr(lines, "buckets", lambda signed, bands=None: signed.select("key", F.lit(0).cast("long").alias("bucket")))
    for block in (512, 5):
        monkeypatch.setattr(lines.apart, "__defaults__", (*lines.apart.__defaults__[:-1], block))
        parts, _ = lines.similar_lines(docs)
        found = {r["node"]: r["component"] for r in parts.collect()}
        assert len(found) == 2 and keys[inner] in found and len(set(found.values())) == 1


def test_bitmaps_rule_no_link_out(spark):
    rng = np.random.default_rng(13)
    base = ["".join(rng.choice(list("abcdefgh"), n)) for n in (3, 8, 9, 60, 300, 3000)]
    rows = [(k, x[:at] + "X" * w + x[at + w :]) for k, x in enumerate(base * 12) for at, w in [(int(rng.integers(max(1, len(x) - 2))), int(rng.integers(0, 1 + len(x) // 9)))]]
    made = lines.bitmaps(spark.createDataFrame(rows, "key long, line string")).collect()
    both = [(a.asDict(), b.asDict()) for a in made for b in made if a["key"] < b["key"]]
    flat = spark.createDataFrame([{**{f"x{c}": v for c, v in a.items()}, **{f"y{c}": v for c, v in b.items()}} for a, b in both])
    got = {(r["xkey"], r["ykey"]): r["fit"] for r in flat.select("xkey", "ykey", lines.fitting("x", "y").alias("fit")).collect()}
    sets = {k: {x[i : i + 8] for i in range(max(1, len(x) - 7))} for k, x in rows}
    linked = [(a, b) for a, b in got if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(linked) > 20 and all(got[p] for p in linked) and not all(got.values())

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsieve.functions import hashing, text
from quillsieve.operators import attribution, documents, scoring, selection, statistics
from quillsieve.plans import arms


def one(spark, expr, **columns):
    names = list(columns)
    schema = ", ".join(f"{n} {columns[n][1]}" for n in names) or "x int"
    frame = spark.createDataFrame([tuple(columns[n][0] for n in names) or (1,)], schema)
    return frame.select(expr.alias("v")).first()["v"]


def test_hash_is_sha1(spark):
    import hashlib

    key = "Thủ đô"
    want = int(hashlib.sha1(f"{hashing.SPLIT_SALT}:{key}".encode()).hexdigest()[:13], 16) / 16**13
    assert one(spark, hashing.hash_unit(F.col("k")), k=(key, "string")) == want


def test_samples_are_nested(spark):
    frame = spark.range(60).select(F.col("id").cast("string").alias("id"))
    small = {r[0] for r in hashing.take_n(frame, 10, "id").collect()}
    large = {r[0] for r in hashing.take_n(frame, 20, "id").collect()}
    rest = {r[0] for r in hashing.take_n(frame, 10, "id", offset=10).collect()}
    assert small < large and rest == large - small


def test_metrics(spark):
    f1 = text.token_f1(F.col("p"), F.col("a"))
    ddl = {"p": None, "a": None}
    del ddl
    assert one(spark, f1, p=("the Hà Nội", "string"), a=(["Sài Gòn", "Hà Nội!"], "array<string>")) == 1.0
    assert one(spark, f1, p=("b c", "string"), a=(["b d e"], "array<string>")) == pytest.approx(0.4)
    assert one(spark, f1, p=("", "string"), a=([""], "array<string>")) == 1.0
    assert one(spark, f1, p=("x", "string"), a=([], "array<string>")) == 0.0
    assert one(spark, text.exact_match(F.col("p"), F.col("a")), p=("Ha", "string"), a=(["Hà"], "array<string>")) == 0.0
    assert one(spark, text.answer_recall(F.col("p"), F.col("a")), p=("it is b c", "string"), a=(["", "b d"], "array<string>")) == 0.5
    assert one(spark, text.split_sentences(F.col("t")), t=("A b. C d!\n e", "string")) == ["A b.", "C d!", "e"]
    assert one(spark, text.clean_answer(F.col("t"), True), t=("<think>x\ny</think> Paris\nand", "string")) == "Paris"
    assert one(spark, text.gold_recall(F.col("k"), F.col("g")), k=([1, 3], "array<int>"), g=([1, 2], "array<int>")) == 0.5
    assert one(spark, text.gold_recall(F.col("k"), F.col("g")), k=([1], "array<int>"), g=([], "array<int>")) is None
    assert one(spark, text.middle_cut(F.col("k"), 3), k=([1, 2, 3, 4, 5], "array<int>")) == [1, 4, 5]


def test_greedy_skips_and_keeps_order(spark):
    chunks, scores = ["a b c", "d e", "f g h i", "j"], [0.1, 0.9, 0.5, 0.8]
    pick = selection.select_chunks(F.col("c"), F.col("s"), F.transform("c", lambda c: text.token_count(c)), F.lit(3))
    got = one(spark, pick, c=(chunks, "array<string>"), s=(scores, "array<double>"))
    assert got["kept"] == [1, 3] and got["text"] == "d e\n\nj" and got["kept_tokens"] == 3 and not got["truncated"]
    tight = selection.select_chunks(F.col("c"), F.col("s"), F.transform("c", lambda c: text.token_count(c)), F.lit(1))
    got = one(spark, tight, c=(["a b", "c d e"], "array<string>"), s=([0.1, 0.9], "array<double>"))
    assert got["kept"] == [1] and got["text"] == "c" and got["truncated"]


def test_rank_fusion_with_missing_scores(spark):
    got = one(spark, scoring.fused(F.col("a"), F.col("b")), a=([3.0, 2.0, 1.0], "array<double>"), b=([1.0, float("nan"), 2.0], "array<double>"))
    assert got == pytest.approx([1 / 61 + 1 / 62, 1 / 62 + 1 / 63, 1 / 63 + 1 / 61])
    with pytest.raises(ValueError):
        scoring.fused(F.col("a"))


def test_bm25_ranks_the_matching_chunk(spark):
    got = one(spark, scoring.bm25(F.col("q"), F.col("c")), q=("where is Paris", "string"), c=(["noise here", "Paris is where it is", "other"], "array<string>"))
    assert max(range(3), key=lambda i: got[i]) == 1 and got[2] == 0.0


def test_oracle_and_gold_ranks(spark):
    assert one(spark, scoring.oracle(F.col("g"), F.col("s")), g=([1, 2], "array<int>"), s=([5.0, 0.0, 1.0, 2.0], "array<double>")) == [5.0, 6.0, 6.0, 2.0]
    order = scoring.ranking(F.col("b"))
    recall, mrr = attribution.gold_ranks(order, F.col("g"))
    assert one(spark, F.array(recall, mrr), b=([0.1, 0.9, 0.0, 0.5], "array<double>"), g=([1, 3], "array<int>")) == [1.0, 1.0]
    assert one(spark, F.array(recall, mrr), b=([0.9, 0.1, 0.0, 0.5], "array<double>"), g=([1], "array<int>")) == pytest.approx([0.0, 1 / 3])


def test_masks(spark):
    loo = attribution.loo_masks(F.col("n"))
    assert one(spark, loo, n=(3, "int")) == [[False, True, True], [True, False, True], [True, True, False]]
    assert one(spark, loo, n=(1, "int")) == [[False]]
    assert one(spark, attribution.is_loo(loo), n=(4, "int"))
    masks = one(spark, attribution.random_masks(F.lit("d"), F.col("n"), F.lit(64)), n=(4, "int"))
    assert len(masks) == 64 and all(any(m) and not all(m) for m in masks)
    z = one(spark, attribution.zscore(F.col("b")), b=([1.0, 1.0], "array<double>"))
    assert z["z"] == [0.0, 0.0] and not z["informative"]


def test_ridge_finds_planted_chunks(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    for chunks, number in ((20, 200), (60, 40)):
        masks = rng.random((number, chunks)) < np.where(np.arange(number) % 2, 0.25, 0.5)[:, None]
        y = 0.05 + 0.6 * masks[:, 3] + 0.3 * masks[:, 11] + rng.normal(0, 0.01, number)
        frame = spark.createDataFrame([("d", k, [float(b) for b in m], float(v)) for k, (m, v) in enumerate(zip(masks, y, strict=True))], "doc_id string, k int, mask array<double>, y double")
        fit = attribution.fit_ridge(frame, 1.0).first()
        assert set(np.argsort(fit["beta"])[-2:]) == {3, 11} and fit["residual"] < 1e-8
    assert [r["alpha"] for r in attribution.select_alpha(frame).collect()][0] in attribution.ALPHAS


def test_adjustments(spark):
    p = [0.01, 0.04, None, 0.03, 0.2]
    frame = spark.createDataFrame([("f", i, v) for i, v in enumerate(p)], "family string, i int, p double")
    got = {r["i"]: (r["holm"], r["bh"]) for r in statistics.adjusted(frame, "p", ["family"], "i").collect()}
    assert [got[i][0] for i in (0, 1, 3, 4)] == pytest.approx([0.04, 0.09, 0.09, 0.2]) and got[2] == (None, None)
    assert [got[i][1] for i in (0, 1, 3, 4)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.2])
    boot = spark.createDataFrame([(x,) for x in (0.03, 0.04, 0.05, 0.06)], "d double")
    d = F.col("d")
    row = boot.agg(statistics.directional_p("superiority", d), statistics.directional_p("noninferiority", d, 0.02), statistics.directional_p("equivalence", d, 0.05)).first()
    assert list(row) == pytest.approx([1 / 5, 1 / 5, 3 / 5])
    assert one(spark, statistics.retention(F.lit(0.3), F.lit(0.5), F.lit(0.4), F.lit(0.8))) == pytest.approx(0.5)
    assert one(spark, statistics.retention(F.lit(0.3), F.lit(0.5), F.lit(0.4), F.lit(0.4))) is None


def test_multihop_rows(spark):
    schema = "id string, question string, answer string, type string, context struct<title: array<string>, sentences: array<array<string>>>, supporting_facts struct<title: array<string>, sent_id: array<int>>"
    context = (["A", "B", "C"], [[" s1.", " s2."], ["t1."], ["u1."]])
    make = lambda sents, answer="x": spark.createDataFrame([("1", "q", answer, "t", context, (["A", "C"], sents))], schema)
    got = documents.multihop(make([0, 0]), "src", "dev", "en").first()
    assert got["chunks"][0] == "A\ns1. s2." and got["gold_chunks"] == [0, 2]
    got = documents.multihop(make([0, 0]), "src", "dev", "en", "sentence").first()
    assert got["chunks"] == ["A\ns1.", "A\ns2.", "B\nt1.", "C\nu1."] and got["metadata"]["para"] == [0, 0, 1, 2] and got["gold_chunks"] == [0, 3]
    assert documents.multihop(make([7, 0]), "src", "dev", "en", "sentence").first()["gold_chunks"] == [0, 1, 3]
    assert documents.multihop(make([0, 0], "Yes."), "src", "dev", "en").count() == 0


def test_haystack_properties(spark):
    pool = [f"Câu thứ {i} " + "không có gì " * 12 for i in range(200)] + ["có Hà Nội ở đây"]
    needles = spark.createDataFrame([(f"d{i}", "Thủ đô là Hà Nội.", ["Hà Nội"]) for i in range(30)], "doc_id string, needle string, answers array<string>")
    got = documents.haystacks(needles, spark.createDataFrame([(p,) for p in pool], "chunk string"), 3000).collect()
    assert len(got) == 30 and len({r["gold"] for r in got}) > 5
    for r in got:
        assert [i for i, c in enumerate(r["chunks"]) if "Hà Nội" in c] == [r["gold"]] and 5 < len(r["chunks"]) < 40


def test_haystacks_draw_from_the_whole_pool(spark):
    import hashlib
    import math as m

    unit = lambda key, salt: int(hashlib.sha1(f"{salt}:{key}".encode()).hexdigest()[:13], 16) / 16**13
    pool = [(f"line {i} " + "x" * (i % 37), f"t{i % 3}") for i in range(4000)]
    needles = [(f"d{i}", f"needle {i}", [f"line {i}7 "], f"t{i % 4}") for i in range(12)]
    frame = spark.createDataFrame(needles, "doc_id string, needle string, answers array<string>, title string")
    lines = spark.createDataFrame(pool, "chunk string, title string")
    got = {r["doc_id"]: r for r in documents.haystacks(frame, lines.select("chunk"), 1500).collect()}
    order = sorted((c for c, _ in pool), key=lambda c: (hashlib.sha1(c.encode()).hexdigest(), c))
    most = 4 * m.ceil(1500 / (sum(map(len, order)) / len(order))) + 16
    for doc, needle, answers, _ in needles:
        taken, total = [], len(needle)
        for j in range(most):
            c = order[m.floor(len(order) * unit(f"{doc}:{j}", "draw"))]
            if c in taken or answers[0].strip() in c:
                continue
            if total + len(c) > 1500 and taken:
                break
            taken.append(c)
            total += len(c)
        taken.insert(m.floor(unit(doc, "gap") * (len(taken) + 1)), needle)
        assert got[doc]["chunks"] == taken
    hard = {r["doc_id"]: r for r in documents.haystacks(frame, lines, 1500, "title").collect()}
    title = dict(pool)
    for doc, needle, _, own in needles:
        others = [title[c] for c in hard[doc]["chunks"] if c != needle]
        assert set(others) == {own} if own != "t3" else len(set(others)) == 3
    # A pool smaller than the target is taken whole; an empty one leaves the needle alone.
    few = documents.haystacks(frame, lines.select("chunk").limit(9), 10_000).collect()
    assert all(len(r["chunks"]) == 10 for r in few) and all(r["chunks"] == [r["needle"]] for r in documents.haystacks(frame, lines.select("chunk").limit(0), 100).collect())
    with pytest.raises(ValueError):
        documents.squad_documents(frame, frame, "s", "dev", "vi", distractors="near")


def test_padding_moves_gold(spark):
    frame = spark.createDataFrame([("d", ["a" * 10, "gold", "b" * 10], [1], ["gold"], [f"pad {i}" for i in range(9)] + ["has gold"])], "doc_id string, chunks array<string>, gold_chunks array<int>, answers array<string>, pool array<string>")
    got = documents.padded(frame, "pool", 60).first()
    assert [got["chunks"][g] for g in got["gold_chunks"]] == ["gold"] and len(got["chunks"]) > 4 and "has gold" not in got["chunks"]


def test_arm_specifications():
    arm = arms.parse("mine=sent+rrf:bm25|pruner:p")
    assert (arm.label, arm.kind, arm.parts[0].name, arm.models()) == ("mine", "sentence", "rrf", ["pruner:p"])
    for bad in ("sent+lead", "rrf:bm25", "nothing", "pruner"):
        with pytest.raises(ValueError):
            arms.parse(bad)
    assert arms.parse("bm25").label == "bm25" and math.isfinite(1.0)


def test_draws_move_as_numbers(spark):
    """A document's repeated draws are dropped inside its row: no aggregation, and so no shuffle, comes before the lines are met."""
    lines = spark.range(500).selectExpr("concat('line ', id) AS chunk", "id AS _i", "500L AS _n")
    asked = spark.createDataFrame([("d", "x", ["y"])], "doc_id string, needle string, answers array<string>")
    found = documents._candidates(asked, lines, 60, None, "draw")
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert len({r["chunk"] for r in rows}) == len(rows) <= 60


def test_penalties_are_tried_without_moving_masks(spark):
    """A document's masks stay in one row; errors of documents of one shape equal those of one at a time."""
    import __spark_entry__ as entry

    plan = entry.queries()["ridge_alpha"](spark, entry.SAMPLE)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
    rng = np.random.default_rng(12)
    rows = [(k, (rng.random((20 + k % 3, 3 + k % 2)) < 0.5)) for k in range(12)]
    outcomes = [(k, m, m @ rng.normal(size=m.shape[1]) + rng.normal(size=len(m))) for k, m in rows]
    long = spark.createDataFrame([(k, i, [float(b) for b in bits], float(v)) for k, m, y in outcomes for i, (bits, v) in enumerate(zip(m, y, strict=True))], "doc_id long, k int, mask array<double>, y double")
    got = {r["alpha"]: r["cv_mse"] for r in attribution.select_alpha(long).collect()}
    want = {a: np.mean([attribution.cv_errors(m, y, a)[0] for _, m, y in outcomes]) for a in attribution.ALPHAS}
    assert all(abs(got[a] - want[a]) < 1e-9 for a in want) and len(got) == len(want)

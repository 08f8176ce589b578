"""Dual fits against plain normal equations with a column for each pair."""

import hashlib
import itertools
import random

import numpy as np

from quillsieve.operators import surrogates as su
from quillsieve.operators.attribution import fold_of

SCHEMA = "doc_id long, source string, masks array<array<boolean>>, y array<double>, gold array<int>, answers_in array<int>"


def plain_fit(x, y, penalty):
    """Normal equations with a free intercept."""
    a = np.hstack([np.ones((len(x), 1)), x])
    return np.linalg.solve(a.T @ a + np.diag(np.r_[0.0, penalty]), a.T @ y)


def columns(m, pairs):
    return np.hstack([m, *[(m[:, i] * m[:, j])[:, None] for i, j in pairs]])


def plain_held_out(build, y, penalty):
    folds, said = fold_of(len(y)), np.zeros(len(y))
    for f in range(folds.max() + 1):
        train = folds != f
        x = build(train)
        w = plain_fit(x[train], y[train], penalty)
        said[~train] = w[0] + x[~train] @ w[1:]
    return said


def plain_models(m, y, gold, alpha):
    c = m.shape[1]

    def top2(train):
        w = plain_fit(m[train], y[train], np.full(c, alpha))[1:]
        i, j = sorted(np.argsort(-np.round(w, 9), kind="stable")[:2])
        return columns(m, [(i, j)])

    every, golden = list(itertools.combinations(range(c), 2)), list(itertools.combinations(sorted(set(gold)), 2))
    out = {"additive": (lambda t: m, 0), "top2_pair": (top2, 1), "all_pairs": (lambda t: columns(m, every), len(every))}
    return out | ({"gold_pairs": (lambda t: columns(m, golden), len(golden))} if golden else {})


def made(seed=3, n=14):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        c = int(rng.integers(2, 8))
        m = rng.random((int(rng.integers(20, 60)), c)) < 0.5
        gold = sorted(rng.choice(c, min(c, int(rng.integers(0, 4))), replace=False).tolist())
        w = rng.normal(size=c)
        y = m @ w + 2.0 * (m[:, 0] & m[:, 1]) + 0.05 * rng.normal(size=len(m))
        if k == 4:
            y = np.zeros(len(m))
        rows.append((k, "a" if k % 2 else "b", m.tolist(), y.tolist(), gold, [0] if k % 3 else []))
    rows += [(90, "a", [[True, False]] * 3, [0.0, 1.0, 0.5], [0], [0]), (91, "c", [], [], [0], []), (92, None, [[True], [False], [True], [False], [True]], [1.0, 0.0, 1.0, 0.2, 0.9], [0], [0])]
    return rows


def test_interactions_against_columns(spark):
    rows, alpha = made(), 0.7
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want: dict = {}
    for d, s, m, y, gold, _ in rows:
        m, y = np.array(m, dtype=float), np.round(np.array(y), 9)
        if len(y) < 4 or np.ptp(y) < 1e-9:
            continue
        for name, (build, n) in plain_models(m, y, gold, alpha).items():
            for a in su.MAIN_GRID if name == "additive" else su.PAIR_GRID:
                pen = np.full(m.shape[1], a) if name == "additive" else np.r_[np.full(m.shape[1], alpha), np.full(n, a)]
                if m.shape[1] == 1 and name == "top2_pair":
                    continue
                want.setdefault((s, name, a), []).append(((plain_held_out(build, y, pen) - y) ** 2).mean())
    got = {(r["source"], r["model"], r["penalty"]): r["cv_mse"] for r in su.interaction_errors(frame, alpha).collect()}
    for k, v in want.items():
        assert abs(got[k] - np.mean(v)) < 1e-7, k
    best = {}
    for (s, name, a), v in sorted(want.items(), key=lambda kv: repr(kv[0])):
        if (s, name) not in best or np.mean(v) < best[s, name][0] - 1e-12:
            best[s, name] = (np.mean(v), a)
    found = {(r["source"], r["model"]): r for r in su.interaction_gain(frame, alpha).collect()}
    for (s, name), (_, a) in best.items():
        r2, gains, coefficients = [], [], []
        for d, source, m, y, gold, _ in rows:
            m, y = np.array(m, dtype=float), np.round(np.array(y), 9)
            if source != s or len(y) < 4 or np.ptp(y) < 1e-9 or name not in plain_models(m, y, gold, alpha):
                continue
            c = m.shape[1]
            fit = lambda name, a: 1 - ((plain_held_out(plain_models(m, y, gold, alpha)[name][0], y, np.full(c, alpha) if name == "additive" else np.r_[np.full(c, alpha), np.full(plain_models(m, y, gold, alpha)[name][1], a)]) - y) ** 2).sum() / ((y - y.mean()) ** 2).sum()  # noqa: B023, E731
            r2.append(fit(name, a))
            gains.append(r2[-1] - fit("additive", alpha))
            if name == "gold_pairs":
                x = plain_models(m, y, gold, alpha)[name][0](None)
                coefficients.append(plain_fit(x, y, np.r_[np.full(c, alpha), np.full(x.shape[1] - c, a)])[1 + c :].mean())
        r = found[s, name]
        assert r["penalty"] == a and r["n"] == len(r2) and abs(r["r2"] - np.mean(r2)) < 1e-6 and abs(r["gain"] - np.mean(gains)) < 1e-6
        if coefficients:
            assert abs(r["gold_pair"] - np.mean(coefficients)) < 1e-6
    assert found["a", "all_pairs"]["gain"] > 0 and su.interaction_gain(frame.limit(0)).count() == 0


def test_refits_against_plain_version(spark):
    rows, alpha = made(7), 1.0
    frame = spark.createDataFrame(rows, SCHEMA).repartition(2)
    subsets: dict = {}
    for r in su.mask_subsets(frame, (8, 16, 32)).collect():
        subsets.setdefault((r["doc_id"], r["draw"], r["calls"]), set()).add(r["k"])
    got = {(r["doc_id"], r["fit"], r["calls"]): r for r in su.refits(frame, alpha, (8, 16, 32)).collect()}
    seen = 0
    for d, _, m, y, gold, inside in rows:
        m, y = np.array(m, dtype=float), np.round(np.array(y), 9)
        if not len(y) or np.ptp(y) < 1e-9:
            assert not any(k[0] == d for k in got)
            continue
        for calls in (8, 16, 32):
            if calls >= len(y):
                assert (d, "curve", calls) not in got
                continue
            out = []
            for draw in range(su.DRAWS):
                at = np.array(sorted(subsets[d, draw, calls]))
                by_hash = sorted(range(len(y)), key=lambda k: (hashlib.sha1(f"subset:{draw}:{d}:{k}".encode()).hexdigest()[:13], k))
                assert set(at) == set(by_hash[:calls])
                w = plain_fit(m[at], y[at], np.full(m.shape[1], alpha))
                rest = np.setdiff1d(np.arange(len(y)), at)
                order = np.argsort(-np.round(w[1:], 9), kind="stable")
                out.append((1 - ((w[0] + m[rest] @ w[1:] - y[rest]) ** 2).sum() / ((y[rest] - y[rest].mean()) ** 2).sum(), float(order[0] in inside), len(set(order[: len(gold)]) & set(gold)) / max(1, len(gold))))
            r = got[d, "curve", calls]
            assert abs(r["heldout_r2"] - np.mean([x[0] for x in out])) < 1e-7
            assert r["first"] is None if not inside else abs(r["first"] - np.mean([x[1] for x in out])) < 1e-9
            assert r["recall"] is None if not gold else abs(r["recall"] - np.mean([x[2] for x in out])) < 1e-9
            seen += 1
    assert seen > 10
    curve = {(r["source"], r["fit"], r["calls"]): r for r in su.k_curve(frame, alpha, (8, 16, 32)).collect()}
    assert curve["a", "curve", 32]["heldout_r2"] > curve["a", "curve", 8]["heldout_r2"]
    assert {f for _, f, _ in curve} == {"curve", "sparse", "dense", "any"}


def test_nested_draws():
    rng = random.Random(1)
    for _ in range(5):
        d, n = rng.randint(0, 99), rng.randint(9, 60)
        assert sorted(su.subset_order(d, 1, n)) == list(range(n)) and su.subset_order(d, 1, n) != su.subset_order(d, 2, n)


def test_measured_rows_are_made_once(spark):
    """The two passes over a document's masks share one making of them."""
    made = spark.sparkContext.accumulator(0)
    rng = np.random.default_rng(4)
    masks = [[[bool(x) for x in m] for m in rng.random((12, 4)) < 0.5] for _ in range(3)]
    frame = spark.createDataFrame([(d, "s", m, [float(x) for x in rng.random(12)], [0, 2], [1]) for d, m in enumerate(masks)], "doc_id long, source string, masks array<array<boolean>>, y array<double>, gold array<int>, answers_in array<int>")

    su.interaction_gain(frame.mapInArrow(lambda bs: (made.add(b.num_rows) or b for b in bs), frame.schema)).collect()
    assert made.value == 3


def test_fits_at_once_equal_single_ones():
    rng = np.random.default_rng(5)
    masks, y = (rng.random((30, 6)) < 0.5).astype(float), rng.random(30)
    every = [masks @ masks.T / a for a in (0.3, 1.0, 10.0)]
    got = su.held_out_all(lambda train: np.stack(every), y)
    assert np.allclose(got, [su.held_out(lambda train, k=k: k, y) for k in every], atol=1e-12)


def test_outcomes_read_documents_once(spark):
    from quillsieve.plans import queries_labels

    plan = queries_labels._outcomes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_mask_subsets_stay_in_their_row(spark):
    """No window over a document's masks: the orders are made in the row, from the number of masks alone."""
    counts = spark.createDataFrame([(1, 64), (2, 40), (3, 8), (4, 9), (5, 0)], "doc_id long, n int")
    out = su.subsets(counts, (8, 16, 48), 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    got: dict = {}
    for r in out.collect():
        got.setdefault((r["doc_id"], r["draw"], r["calls"]), set()).add(r["k"])
    want = {(d, w, c): set(su.subset_order(d, w, n)[:c]) for d, n in ((1, 64), (2, 40), (4, 9)) for w in (0, 1) for c in (8, 16, 48) if c < n}
    assert got == want
    frame = spark.createDataFrame([(1, [0.5] * 20)], "doc_id long, y array<double>")
    assert "Window" not in su.mask_subsets(frame, (8, 16), 2)._jdf.queryExecution().executedPlan().toString()


def test_stacks_of_documents_equal_single_ones():
    """Refits, their held-out figures and labels of documents of one shape at once, against one by one in dual form."""
    rng = np.random.default_rng(31)
    masks = (rng.random((5, 24, 6)) < 0.5).astype(float)
    y = np.round(masks @ rng.normal(size=6) + 0.1 * rng.normal(size=(5, 24)), 9)
    ats = np.stack([[rng.permutation(24)[:9] for _ in range(4)] for _ in range(5)])
    gold, answers = np.zeros((5, 6), dtype=bool), np.zeros((5, 6), dtype=bool)
    gold[:4, 1], gold[2:4, 4], answers[1:, 3] = True, True, True
    full = np.stack([su.betas(m, v, 1.0) for m, v in zip(masks, y, strict=True)])
    got = su._drawn(masks, y, ats, full, 1.0, gold, answers)
    for k in range(5):
        each = su._refits(masks[k], y[k], masks[k] @ masks[k].T, np.sort(ats[k], axis=1), full[k], 1.0, np.flatnonzero(gold[k]).tolist(), np.flatnonzero(answers[k]).tolist())
        want = [[r[f] for r in each if r[f] is not None] for f in su._DRAWN]
        assert np.allclose(got[k], [np.mean(w) if w else np.nan for w in want], atol=1e-9, equal_nan=True)


def test_gains_below_rounding_are_no_gain(spark):
    """Without any pair the models are the additive one; what rounding leaves of the difference counts as no gain, and each document's errors are made once."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(12):
        m = np.eye(5, dtype=bool)[rng.integers(0, 5, 40)]
        rows.append((k, "a", m.tolist(), (m @ rng.normal(size=5) + 0.1 * rng.normal(size=40)).tolist(), [0, 1], [0]))
    frame = spark.createDataFrame(rows, SCHEMA)
    asked = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            asked.add(b.num_rows)
            yield b

    found = su.interaction_gain(frame.mapInArrow(counted, frame.schema)).collect()
    assert asked.value == 12
    assert {r["model"]: r["share_gaining"] for r in found} == {"additive": 0.0, "all_pairs": 0.0, "gold_pairs": 0.0, "top2_pair": 0.0}

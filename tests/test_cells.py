"""Figures of cells: draws equal to the joined bootstrap, wild bootstrap by explicit sign matrices, interpolation."""

import itertools

import numpy as np

from quillsieve.operators import statistics as st


def rows_of(spark, sizes, seed=1, effect=0.05):
    rng = np.random.default_rng(seed)
    rows = [(name, f"c{c:03d}", float(effect + 0.1 * rng.normal()), float(rng.random())) for name, k in sizes.items() for c in range(k) for _ in range(int(rng.integers(1, 5)))]
    return spark.createDataFrame([*rows, ("a", "c000", None, 1.0), ("a", "c001", float("nan"), 1.0)], "cell string, cluster string, d double, e double")


def test_draws_equal_the_joined_ones(spark):
    rows = rows_of(spark, {"a": 7, "b": 1, "c": 140})
    keep = lambda means, drawn: {"m": float(means[0]), "x": drawn[:, 0].tolist(), "y": drawn[:, 1].tolist()}
    schema = "m double, x array<double>, y array<double>"
    got = {r["cell"]: r for r in st.bootstrapped(rows, ["cell"], "cluster", ["d", "e"], schema, keep, draws=60).collect()}
    split = {r["cell"]: r for r in st.bootstrapped(rows, ["cell"], "cluster", ["d", "e"], schema, keep, draws=60, gathered=5).collect()}
    joined: dict = {}
    for r in st.bootstrap(rows, ["cell"], "cluster", ["d", "e"], 60).collect():
        joined.setdefault(r["cell"], {})[r["b"]] = (r["d"], r["e"])
    assert got.keys() == split.keys() == joined.keys() == {"a", "b", "c"}
    for cell, drawn in joined.items():
        for found in (got, split):
            assert np.allclose(found[cell]["x"], [drawn[b][0] for b in range(60)], atol=1e-12) and np.allclose(found[cell]["y"], [drawn[b][1] for b in range(60)], atol=1e-12)
        assert abs(got[cell]["m"] - split[cell]["m"]) < 1e-12
    assert st.bootstrapped(rows.limit(0), ["cell"], "cluster", ["d"], "m double", lambda m, d: {"m": 0.0}).count() == 0


def test_planted_effect_is_supported(spark):
    rows = rows_of(spark, {"with": 40}, effect=0.2).where("cell = 'with'").union(rows_of(spark, {"without": 40}, 2, 0.0).where("cell = 'without'"))
    found = {r["cell"]: r["p"] for r in st.bootstrapped(rows, ["cell"], "cluster", ["d"], "p double", lambda m, d: {"p": st.one_sided(d[:, 0], "superiority")}, draws=5000).collect()}
    assert found["with"] == 1 / 5001 and found["without"] > 0.01


def test_wild_against_sign_matrices(spark):
    rows = rows_of(spark, {"a": 6, "b": 2, "c": 12, "one": 1})
    got = {r["cell"]: r for r in st.wild(rows, ["cell"], "cluster", "d", 0.03).collect()}
    assert got.keys() == {"a", "b", "c"}
    data = [r for r in rows.collect() if r["d"] is not None and not np.isnan(r["d"])]
    for cell, r in got.items():
        clusters = sorted({x["cluster"] for x in data if x["cell"] == cell})
        s = np.array([sum(x["d"] for x in data if x["cell"] == cell and x["cluster"] == c) for c in clusters])
        n = np.array([sum(x["cell"] == cell and x["cluster"] == c for x in data) for c in clusters], dtype=float)
        w = np.array(list(itertools.product((1.0, -1.0), repeat=len(s))))
        mean = s.sum() / n.sum()
        lo, hi = np.quantile(mean + w @ (s - n * mean) / n.sum(), [0.025, 0.975])
        up, down = s + n * 0.03, s - n * 0.03
        above, below = (w @ up >= up.sum() - 1e-12).mean(), (w @ down <= down.sum() + 1e-12).mean()
        assert np.allclose([r["mean"], r["lo"], r["hi"], r["above_p"], r["equal_p"]], [mean, lo, hi, above, max(above, below)], atol=1e-9) and r["clusters"] == len(s)


def test_many_clusters_take_draws_and_twenty_fit(spark):
    got = {r["cell"]: r for r in st.wild(rows_of(spark, {"few": 20, "many": 200}), ["cell"], "cluster", "d").collect()}
    for r in got.values():
        assert r["lo"] < r["mean"] < r["hi"] and abs((r["hi"] - r["lo"]) / (2 * 1.96) - r["se"]) < 0.25 * r["se"]
    assert len(st.signed_sums(np.ones(20))) == 1 << 20 and len(st.signed_sums(np.ones(21))) == st.SIGN_DRAWS


def test_retentions():
    means = np.array([[0.4, 0.8, 0.3, 0.5], [0.4, 0.8, 0.5, 0.5]])
    got = st.retentions(means)
    assert abs(got[0] - 2.0) < 1e-12 and np.isnan(got[1]) and st.quantiles(got) == (got[0], got[0]) and st.quantiles(got[1:]) == (None, None)
    assert st.one_sided(got[1:], "superiority") is None
    boot = np.array([0.03, 0.04, 0.05, 0.06])
    assert [st.one_sided(boot, "superiority"), st.one_sided(boot, "noninferiority", 0.02), st.one_sided(boot, "equivalence", 0.05)] == [1 / 5, 1 / 5, 3 / 5]


def test_equal_compression(spark):
    points = [("s", "ref", 2.0, 0.8), ("s", "ref", 8.0, 0.2), ("s", "ours", 1.5, 0.9), ("s", "ours", 3.0, 0.6), ("s", "ours", 6.0, 0.5), ("s", "one", 4.0, 0.7), ("s", "void", 0.0, 0.1), ("s", "same", 2.0, 0.2), ("s", "same", 2.0, 0.4), ("t", "ours", 2.0, 0.5)]
    frame = spark.createDataFrame(points, "source string, arm string, x double, y double")
    got = {(r["arm"], r["target"]): (r["value"], r["extrapolated"]) for r in st.at_equal(frame, ["source"], "arm", "x", "y", "ref").collect()}
    between = lambda t, a, b: a[1] + (np.log(t) - np.log(a[0])) / (np.log(b[0]) - np.log(a[0])) * (b[1] - a[1])
    assert got["ref", 2.0] == (0.8, False) and abs(got["ref", 8.0][0] - 0.2) < 1e-12 and not got["ref", 8.0][1]
    assert abs(got["ours", 2.0][0] - between(2.0, (1.5, 0.9), (3.0, 0.6))) < 1e-12 and not got["ours", 2.0][1]
    assert abs(got["ours", 8.0][0] - between(8.0, (3.0, 0.6), (6.0, 0.5))) < 1e-12 and got["ours", 8.0][1]
    assert got["one", 2.0] == (0.7, True) and abs(got["same", 2.0][0] - 0.3) < 1e-12 and got["same", 2.0][1] is False and ("void", 2.0) not in got


def test_rows_are_made_once(spark):
    """Cells, draws and interpolation read their rows once, however many figures are made from them."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    frame = rows_of(spark, {"few": 20, "many": 30})
    rows, number = frame.mapInPandas(count, frame.schema), frame.count()
    st.wild(rows, ["cell"], "cluster", "d").collect()
    assert made.value == number
    st.bootstrapped(rows, ["cell"], "cluster", ["d"], "m double", lambda means, drawn: {"m": float(means[0])}, 10).collect()
    assert made.value == 2 * number

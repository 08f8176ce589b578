from pyspark.sql import functions as F

from quillsieve.operators import statistics as st


def test_planted_effect_is_supported_in_a_family_of_240(spark):
    rows = spark.range(240 * 3).select((F.col("id") % 240).alias("test"), F.floor(F.col("id") / 240).alias("cluster"))
    rows = rows.withColumn("d", F.lit(0.18) + F.col("cluster") / 1000)
    boot = st.bootstrap(rows, ["test"], "cluster", ["d"])
    tests = boot.groupBy("test").agg(st.directional_p("superiority", F.col("d")).alias("p")).withColumn("family", F.lit("H1"))
    found = st.adjusted(tests, "p", ["family"], "test").agg(F.count("*"), F.count_if(F.col("holm") <= 0.05)).first()
    assert tuple(found) == (240, 240)


def test_adjusted_in_many_pieces_against_plain_version(spark):
    """Families of 3,000 tests with ties and unknown p, one without a name; no frame runs towards a family's end, which would take time by the square."""
    rows = spark.range(6001).select(F.when(F.col("id") % 2 == 0, F.lit("a")).alias("family"), "id", F.when(F.col("id") % 7 != 3, F.round(F.pmod(F.xxhash64("id"), F.lit(900)) / 4000 + 1e-5, 6)).alias("p"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = st.adjusted(rows, "p", ["family"], "id")
        found = out.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower().replace(" ", "")
    assert "rowframe,currentrow$(),unboundedfollowing" not in plan and out.columns == ["family", "id", "p", "holm", "bh"] and len(found) == 6001
    for name in ("a", None):
        own = sorted((r for r in found if r["family"] == name and r["p"] is not None), key=lambda r: (r["p"], r["id"]))
        m, most, least = len(own), 0.0, 1.0
        for k, r in enumerate(own):
            most = max(most, min(1.0, (m - k) * r["p"]))
            assert r["holm"] == most
        for k in range(m - 1, -1, -1):
            least = min(least, 1.0, own[k]["p"] * m / (k + 1))
            assert own[k]["bh"] == least
    assert all(r["holm"] is None and r["bh"] is None for r in found if r["p"] is None)

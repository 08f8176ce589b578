from quillsieve.llm.base import checked_broadcast


def test_tables_above_the_bound_are_not_broadcast(spark):
    """Spark would broadcast them by the size of their files."""
    rows = spark.range(1000).selectExpr("id AS key", "id * 2 AS x")
    plan = lambda most: spark.range(2000).withColumnRenamed("id", "key").join(checked_broadcast(rows, most), "key", "left")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(1000)
    assert "BroadcastHashJoin" not in plan(999) and "SortMergeJoin" in plan(999)

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_planted_cases(spark, tmp_path):
    from tests.llm.test_toxicity import corpus

    docs, labels = corpus(500, 2)
    clean = [(i, x) for i, x in docs if not dict(labels)[i]]
    passage = " ".join(f"bench{k}" for k in range(30))
    copy = " ".join(f"copy{k % 41}x{k}" for k in range(120))
    planted = [(1000, copy), (1001, copy), (1002, "intro words\n" + passage + " and more"), (1003, "you grobnak fool"), (1004, "own line of this one\nshared line that stands in two documents of these"), (1005, "another line of its own\nshared line that stands in two documents of these"), (1006, ""), (1007, None)]
    rows = [(i, x, "en", f"s{i % 3}", len(x or "")) for i, x in docs + planted]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs_now, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    after = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        columns = docs_now.columns
        stage(spark, docs_now, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs_now = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < len(pipeline.STAGES) - 1:
            assert docs_now.columns == columns
        after[name] = {r["doc_id"]: r["text"] for r in docs_now.collect()}
    toxic, lined, near, decontaminated, mixed = after.values()
    assert 1003 not in toxic and len({i for i, _ in clean} - set(toxic)) <= 3
    assert lined[1004].endswith("of these") and lined[1005] == "another line of its own" and set(lined) == set(toxic)
    assert 1000 in near and 1001 not in near and (1006 in near) != (1007 in near) or 1001 in lined
    assert 1002 in near and 1002 not in decontaminated
    assert set(mixed) <= set(decontaminated) and len(mixed) > 0
    assert sorted(r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()) == sorted(mixed)


def test_stages_keep_rows_apart_and_columns(spark, tmp_path):
    """Repeated ids with unlike texts, rows without id, columns that clash with the operators' own; then an empty table."""
    from tests.llm.test_toxicity import corpus

    docs, labels = corpus(300, 3)
    passage = " ".join(f"bench{k}" for k in range(30))
    more = [(9001, "first text of a repeated id"), (9001, "second one is unlike the first"), (9001, passage), (None, "a row that has no id"), (None, "you grobnak fool"), (None, passage + " once more"), (None, None)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, _row string, n_lines string, size string, target string, gone string, key string"
    rows = [(i, x, "en", f"s{(i or 0) % 3}", len(x or ""), "r", "l", "z", "t", "g", "k") for i, x in docs + more]
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        found = now.collect()
        assert {(r["_row"], r["n_lines"], r["size"], r["target"], r["gone"], r["key"]) for r in found} == {("r", "l", "z", "t", "g", "k")}
        texts = {(r["doc_id"], r["text"]) for r in found}
        assert (None, "you grobnak fool") not in texts and (None, "a row that has no id") in texts
        if k < 4:
            assert now.columns == [c.split()[0] for c in ddl.split(", ")]
    assert {(9001, "first text of a repeated id"), (9001, "second one is unlike the first")} <= texts
    assert not any("bench7" in (x or "") for _, x in texts) and now.columns[-4:] == ["size_", "source_size", "target_", "taken"]
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
        assert none.count() == 0

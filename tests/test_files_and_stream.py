import json

import pytest
from pyspark.sql import functions as F

from quillsieve.operators import readers, training
from quillsieve.sources import files
from quillsieve.streaming import ingest


def test_torn_last_line(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"k": 1}\n{"k": 2}\n{"k": 3')
    assert sorted(r["k"] for r in files.read_jsonl(spark, str(path), "k int").collect()) == [1, 2]
    path.write_text('{"k": 1}\n{"k": 2\n{"k": 3}\n')
    with pytest.raises(ValueError):
        files.read_jsonl(spark, str(path), "k int")
    assert files.read_jsonl(spark, str(tmp_path / "none"), "k int").count() == 0


def test_documents_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("d0", "s", "vi", "single", "dev", "q", ["a"], ["c1", "c2"], [0], "d0", None)], files.DOCUMENT)
    files.write_documents(docs, str(tmp_path / "docs"))
    assert files.read_documents(spark, str(tmp_path / "docs")).collect() == docs.collect()


def test_stream_appends_each_key_once(spark, tmp_path):
    source, sink = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for turn, keys in enumerate(([1, 2, 2], [2, 3], [3, 4])):
        (source / f"{turn}.json").write_text("\n".join(json.dumps({"k": k, "v": turn}) for k in keys))
        ingest.ingest(spark, str(source), "k int, v int", sink, str(tmp_path / "ck"), ["k"]).awaitTermination(60)
    assert sorted(tuple(r) for r in spark.read.parquet(sink).collect()) == [(1, 0), (2, 0), (3, 1), (4, 2)]


def test_stream_reads_only_its_own_keys(spark, tmp_path):
    source, sink, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    source.mkdir()
    for turn in range(3):
        (source / f"{turn}.json").write_text("\n".join(json.dumps({"k": k, "v": turn}) for k in range(turn * 5, turn * 5 + 8)))
        ingest.ingest(spark, str(source), "k int, v int", sink, checkpoint, ["k"], buckets=16).awaitTermination(60)
    assert sorted(r["k"] for r in spark.read.parquet(sink).collect()) == list(range(18))
    index = f"{checkpoint}-keys/data"
    every = spark.read.parquet(index)
    bucket = every.where("k = 3").first()["_bucket"]
    seen = ingest.seen_keys(spark, index, [bucket])
    assert seen.where("k = 3").count() == 1
    scan = seen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "_bucket" in scan
    read = seen._jdf.queryExecution().executedPlan()
    seen.collect()
    files_read = read.collectLeaves().head().metrics().apply("numFiles").value()
    assert 0 < files_read < len(every.inputFiles())


def test_batch_written_again_after_a_failure(spark, tmp_path, monkeypatch):
    source, sink, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    source.mkdir()
    (source / "0.json").write_text('{"k": 1}\n{"k": 2}')
    ingest.ingest(spark, str(source), "k int", sink, checkpoint, ["k"]).awaitTermination(60)
    (source / "1.json").write_text('{"k": 2}\n{"k": 3}')
    # As if a first attempt of batch 1 had written its rows and then failed before its keys.
    spark.createDataFrame([(3,)], "k int").write.mode("append").parquet(sink)
    (tmp_path / "ck-keys" / "started-1").touch()
    ingest.ingest(spark, str(source), "k int", sink, checkpoint, ["k"]).awaitTermination(60)
    assert sorted(r["k"] for r in spark.read.parquet(sink).collect()) == [1, 2, 3]


def test_resume_and_guard(spark, tmp_path):
    planned = spark.createDataFrame([(d, a) for d in "xyz" for a in "pq"], "doc string, arm string")
    done = spark.createDataFrame([("x", "p")], "doc string, arm string")
    failed = spark.createDataFrame([("y", "q")], "doc string, arm string")
    assert ingest.pending(planned, done, ["doc", "arm"], failed).count() == 4
    ingest.guard(spark, str(tmp_path / "g"), {"n": 1})
    ingest.guard(spark, str(tmp_path / "g"), {"n": 1})
    with pytest.raises(ValueError):
        ingest.guard(spark, str(tmp_path / "g"), {"n": 2})
    with pytest.raises(ValueError):
        ingest.missing(planned, done, "doc")


def test_readers_and_training(spark):
    rows = spark.createDataFrame([(1, "The sky is blue. Paris is in France.", "where is Paris"), (2, None, "x")], "id int, context string, question string")
    got = {(r["id"], r["reader"]): r["answer"] for r in readers.answered(rows).collect()}
    assert got[1, "overlap"] == "Paris is in France." and got[1, "first"] == "The sky is blue." and got[2, "rare"] == ""
    made = spark.createDataFrame([([[float(i == j), 0.0, 0.0, 0.0] for j in range(4)], [2.0 if i == j else 0.0 for j in range(4)]) for i in range(4)], "x array<array<double>>, target array<double>")
    weights, history = training.train(made, epochs=10)
    assert weights[0] > 0.2 and history[-1] < history[0]
    scored = made.select(training.linear(F.col("x"), weights).alias("s"), "target").select(training.listnet(F.col("s"), F.col("target")).alias("l"), training.weighted_bce(F.col("s"), F.col("target")).alias("b")).first()
    assert 0 < scored["l"] < 2 and scored["b"] > 0
    labels = spark.createDataFrame([("d", [0.0, 0.5, -0.2, 1.0, 0.25], True, "loo", [0.0] * 5, [1])], "doc_id string, beta array<double>, informative boolean, estimator string, z array<double>, gold_chunks array<int>").withColumn("chunks", F.col("beta"))
    for threshold, want in ((0.0, [0, 1, 0, 1, 1]), (0.25, [0, 1, 0, 1, 0]), (-0.5, [1] * 5)):
        assert training.examples(labels, "loo_bin", threshold).first()["target"] == want
    assert training.group_size(4, 10, 9) == 2


def test_training_examples_by_source(spark):
    row = lambda d, chunks, gold, informative, estimator: (d, "q", ["Paris"], chunks, gold, [0.5, -0.1], [1.0, -1.0], informative, estimator)
    data = [row("a", ["in Paris", "x"], [1], True, "ridge"), row("b", ["y", "x"], [], True, "ridge"), row("c", ["in paris", "x"], [0], False, "ridge")]
    labels = spark.createDataFrame(data, "doc_id string, question string, answers array<string>, chunks array<string>, gold_chunks array<int>, beta array<double>, z array<double>, informative boolean, estimator string")
    found = lambda source, **more: {r["doc_id"]: (r["target"], r["gold"]) for r in training.examples(labels, source, **more).collect()}
    assert found("span") == {"a": ([0.0, 1.0], [1]), "b": ([0.0, 0.0], [])}
    assert found("answer") == {"a": ([1.0, 0.0], [0])}
    assert found("beta") == {"a": ([1.0, -1.0], [1]), "b": ([1.0, -1.0], [])}
    with pytest.raises(Exception, match="leave-one-out"):
        found("loo_bin")


def test_nfc_of_texts_and_lists(spark):
    from quillsieve.functions import text

    docs = spark.createDataFrame([("tie\u0302\u0301ng", ["Vie\u0323\u0302t", None]), (None, None)], "t string, xs array<string>")
    assert [tuple(r) for r in text.in_nfc(docs, "t", "xs").collect()] == [("tiếng", ["Việt", None]), (None, None)]

"""The measuring stage: masked contexts answered by a reader, each distinct prompt once, restartable."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.functions.text import token_f1
from quillsieve.operators.readers import Reader, answered
from quillsieve.streaming.ingest import guard

_ANSWERS = "key string, answer string, wave int, run string"


def context_of(chunks: Column, mask: Column) -> Column:
    """The chunks that a mask keeps, in order, a line each; all of them where the mask is null."""
    return F.array_join(F.when(mask.isNull(), chunks).otherwise(F.filter(chunks, lambda c, i: F.element_at(mask, i + 1))), "\n")


def prompt_key(question: Column, context: Column) -> Column:
    """What tells prompts apart: 128 bits of a digest of question and context, the question's length before both."""
    asked = F.coalesce(question, F.lit(""))
    return F.substring(F.sha2(F.concat(F.char_length(asked).cast("string"), F.lit(":"), asked, context), 256), 1, 32)


def planned(docs: DataFrame, waves: int, more: list[str] | None = None) -> DataFrame:
    """(doc_id, more columns, k, key, wave) for every mask of docs(doc_id, question, chunks, masks) and, as k = -1, the full context.

    Texts don't leave their rows: only digests do. A document without chunks has nothing to mask and gives no rows.
    """
    key = lambda m: prompt_key(F.col("question"), context_of(F.col("chunks"), m))
    keys = F.concat(F.array(key(F.lit(None).cast("array<boolean>"))), F.transform("masks", key))
    rows = docs.where(F.size("chunks") > 0).select("doc_id", *(more or []), F.posexplode(keys).alias("k", "key"))
    return rows.select("doc_id", *(more or []), (F.col("k") - 1).alias("k"), "key", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(waves)).cast("int").alias("wave"))


def queue(plan: DataFrame) -> DataFrame:
    """Each distinct prompt of a plan with the first row that asks it; counted before the shuffle, so that a prompt of many documents is one row."""
    return plan.groupBy("key").agg(F.min(F.struct("doc_id", "k")).alias("first")).select("key", "first.doc_id", "first.k")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def answers_in(spark: SparkSession, sink: str) -> DataFrame:
    """(key, answer, wave, run) of what a sink holds; no rows where there is none yet."""
    fs, at = _files(spark, f"{sink}/answers")
    return spark.read.schema(_ANSWERS).parquet(f"{sink}/answers") if fs.exists(at) else spark.createDataFrame([], _ANSWERS)


def ask(docs: DataFrame, plan: DataFrame, reader: Reader, sink: str, waves: int) -> None:
    """Answers the prompts of a plan that the sink doesn't hold, wave by wave.

    Contexts are built again beside the documents that first ask them, from lists of at most as many
    entries as a document has masks. A wave is written aside and moved into the sink whole, so what a
    failed run leaves is either a wave or nothing, and no prompt stands in the sink twice.
    """
    spark = docs.sparkSession
    for wave in range(waves):
        left = queue(plan.where(F.col("wave") == wave)).join(answers_in(spark, sink).where(F.col("wave") == wave).select("key"), "key", "left_anti")
        lists = left.groupBy("doc_id").agg(F.collect_list(F.struct("k", "key")).alias("asked"))
        rows = docs.select("doc_id", "question", "chunks", "masks").join(lists, "doc_id")
        mask = lambda a: F.when(a["k"] >= 0, F.get("masks", a["k"]))
        prompts = rows.select("question", F.inline(F.transform("asked", lambda a: F.struct(a["key"].alias("key"), context_of(F.col("chunks"), mask(a)).alias("context")))))
        run = uuid.uuid4().hex
        aside = f"{sink}/unfinished/{run}"
        answered(prompts, (reader,)).select("key", "answer").write.parquet(aside)
        fs, made = _files(spark, aside)
        _, folder = _files(spark, f"{sink}/answers/wave={wave}")
        fs.mkdirs(folder)
        if not fs.rename(made, _files(spark, f"{sink}/answers/wave={wave}/run={run}")[1]):
            raise OSError(f"could not move {aside} into the sink")


def measure(docs: DataFrame, reader: Reader, sink: str, settings: dict | None = None, waves: int = 4) -> DataFrame:
    """What a reader gets from every masked context of docs(doc_id, question, answers, chunks, masks).

    Returns doc_id, reader, masks, f1 (one for each mask, in order), full_f1 and full_answer. Equal
    prompts, of one document or of several, are answered once; a run on a sink that holds answers
    asks only what is missing, so a set of documents may grow. Other settings than the sink's first
    ones are refused. doc_id must be unique; question may be null; documents without chunks or
    masks give no row for what they lack. One run at a time may write to a sink.
    """
    spark = docs.sparkSession
    guard(spark, f"{sink}-settings", {"reader": reader.name, "waves": waves, **(settings or {})})
    at = f"{sink}/plans/{uuid.uuid4().hex}"
    docs = docs.select("doc_id", "question", "answers", "chunks", "masks")
    docs.write.parquet(f"{at}/docs")  # masks are drawn once, not again in each wave
    docs = spark.read.schema(docs.schema).parquet(f"{at}/docs")
    rows = planned(docs, waves)
    rows.write.partitionBy("wave").parquet(f"{at}/prompts")
    plan = spark.read.schema(rows.schema).parquet(f"{at}/prompts")
    ask(docs, plan, reader, sink, waves)
    return outcomes(docs, plan, answers_in(spark, sink), reader.name)


def outcomes(docs: DataFrame, plan: DataFrame, answers: DataFrame, reader: str) -> DataFrame:
    """Answers handed out to all who asked, by document, scored against the document's own answers."""
    said = plan.select("doc_id", "k", "key").join(answers.select("key", "answer"), "key").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "answer"))).alias("said"))
    rows = docs.select("doc_id", "answers", "masks").join(said, "doc_id")
    f1 = F.transform(F.filter("said", lambda s: s["k"] >= 0), lambda s: token_f1(s["answer"], F.col("answers")))
    full = F.element_at("said", 1)["answer"]
    return rows.select("doc_id", F.lit(reader).alias("reader"), "masks", f1.alias("f1"), token_f1(full, F.col("answers")).alias("full_f1"), full.alias("full_answer"))

"""Question-and-context documents derived from the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.functions.text import token_count
from quillsieve.operators import scoring


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files have fewer splits than that; larger tables are left as they are scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def doc_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two or more lines: chunks are lines, the middle one is gold; its first words ask, the next answer."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", lines.alias("chunks")).where(F.size("chunks") >= 2)
    gold = F.floor(F.size("chunks") / 2).cast("int")
    words = F.filter(F.split(F.element_at("chunks", F.col("gold") + 1), r"\s+"), lambda w: w != "")
    rows = rows.withColumn("gold", gold).withColumn("words", words).where(F.size("words") >= 10)
    return rows.select(
        "doc_id", F.col("lang").alias("language"), "source", F.lit("single").alias("hop"), F.array_join(F.slice("words", 1, 6), " ").alias("question"),
        F.array(F.array_join(F.slice("words", 7, 4), " ")).alias("answers"), "chunks", F.array("gold").alias("gold_chunks"), F.col("source").alias("cluster_id"),
    )


def qa_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows: the question, and the answer's lines as chunks."""
    turns = table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"), F.col("text").alias("answer"))
    pairs = turns.where("role = 'user'").join(after.where("next_role = 'assistant'"), ["conv_id", "turn"])
    lines = F.filter(F.split("answer", "\n"), lambda x: F.trim(x) != "")
    rows = pairs.select("conv_id", "turn", F.col("text").alias("question"), lines.alias("chunks")).where(F.size("chunks") >= 1)
    gold = F.floor(F.size("chunks") / 2).cast("int")
    rows = rows.withColumn("gold", gold)
    first = F.slice(F.filter(F.split(F.element_at("chunks", F.col("gold") + 1), r"\s+"), lambda w: w != ""), 1, 4)
    return rows.select(
        F.concat_ws("-", "conv_id", "turn").alias("doc_id"), (F.col("conv_id") % 5).cast("string").alias("source"), "question", "chunks",
        F.array(F.array_join(first, " ")).alias("answers"), F.array("gold").alias("gold_chunks"), F.col("conv_id").cast("string").alias("cluster_id"),
    )


def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_docs with word counts and BM25 scores of their chunks."""
    docs = doc_docs(spark, sf_dir)
    made = F.struct(F.transform("chunks", lambda c: token_count(c)).alias("lengths"), scoring.bm25(F.col("question"), F.col("chunks")).alias("bm25"))
    return docs.select("*", F.inline(F.array(made)))  # a generator of one row: made once, not at each use


#: The same derivations in SQL. d: documents; c: chunks; s: chunks with BM25.
DOCS_SQL = r"""
d AS MATERIALIZED (
  SELECT doc_id, language, source, question, [answer] AS answers, chunks, gold
  FROM (SELECT *, array_to_string(words[1:6], ' ') AS question, array_to_string(words[7:10], ' ') AS answer
        FROM (SELECT *, list_filter(string_split_regex(chunks[gold + 1], '\s+'), lambda w: w <> '') AS words
              FROM (SELECT *, (len(chunks) // 2)::INT AS gold
                    FROM (SELECT doc_id, lang AS language, source, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS chunks FROM documents)
                    WHERE len(chunks) >= 2))
        WHERE len(words) >= 10))"""
TERMS = r"list_filter(string_split_regex(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda t: t <> '')"
COUNT = r"len(list_filter(string_split_regex({}, '\s+'), lambda t: t <> ''))"
SCORED_SQL = (
    DOCS_SQL
    + rf""",
c AS MATERIALIZED (
  SELECT doc_id, language, source, gold, i, chunk, {TERMS.format("chunk")} AS terms, {COUNT.format("chunk")} AS tokens
  FROM (SELECT doc_id, language, source, gold, unnest(range(0, len(chunks)))::INT AS i, unnest(chunks) AS chunk FROM d)),
q AS (SELECT doc_id, unnest({TERMS.format("question")}) AS term FROM d),
sizes AS (SELECT doc_id, count(*) AS n, greatest(avg(len(terms)), 1e-9) AS mean FROM c GROUP BY 1),
tf AS (SELECT doc_id, i, term, count(*) AS tf FROM (SELECT doc_id, i, unnest(terms) AS term FROM c) GROUP BY ALL),
df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
bm AS (
  SELECT q.doc_id, tf.i, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(c.terms) / mean))) AS score
  FROM q JOIN tf USING (doc_id, term) JOIN df USING (doc_id, term) JOIN sizes USING (doc_id) JOIN c ON c.doc_id = q.doc_id AND c.i = tf.i GROUP BY ALL),
s AS MATERIALIZED (
  SELECT c.*, round(coalesce(bm.score, 0), 9) AS bm25, row_number() OVER (PARTITION BY c.doc_id ORDER BY round(coalesce(bm.score, 0), 9) DESC, c.i) AS rank
  FROM c LEFT JOIN bm ON bm.doc_id = c.doc_id AND bm.i = c.i)"""
)
HASH = "(('0x' || substr(sha1('{salt}:' || {key}), 1, 13))::BIGINT / pow(16, 13))"

"""Queries over the measuring stage: its queue of distinct prompts, and what a reader gets through it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.operators import attribution as at
from quillsieve.operators import measure
from quillsieve.operators.readers import LineReader
from quillsieve.plans.frames import DOCS_SQL, HASH, TERMS, doc_docs
from quillsieve.sources.scratch import scratch_folder

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def masked_docs(spark, sf_dir) -> DataFrame:
    n = F.size("chunks")
    return doc_docs(spark, sf_dir).withColumn("masks", at.random_masks(F.col("doc_id"), n, at.num_masks(n)))


#: qd: a row for each document and line; qz: its bits in each mask; qp: prompts, the full context's as mask -1.
QUEUE_SQL = (
    DOCS_SQL
    + rf""",
qk AS (SELECT doc_id, len(chunks) AS n, unnest(range(0, least(256, greatest(64, len(chunks) + 1)))) AS k FROM d),
qb AS (SELECT *, unnest(range(0, n)) AS c FROM qk),
qx AS (SELECT doc_id, n, k, c, {HASH.format(salt="mask", key="doc_id || chr(58) || k || chr(58) || c")} < CASE WHEN k % 2 = 0 THEN 0.5 ELSE 0.25 END AS bit, floor({HASH.format(salt="flip", key="doc_id || chr(58) || k")} * n) AS pick FROM qb),
qw AS (SELECT *, sum(bit::INT) OVER (PARTITION BY doc_id, k) AS s FROM qx),
qz AS MATERIALIZED (SELECT doc_id, k, c, CASE WHEN (s = 0 OR (n > 1 AND s = n)) AND c = pick THEN NOT bit ELSE bit END AS bit FROM qw UNION ALL SELECT doc_id, -1, unnest(range(0, len(chunks))), true FROM d),
qd AS MATERIALIZED (SELECT doc_id, source, question, answers[1] AS answer, unnest(range(0, len(chunks))) AS c, unnest(chunks) AS chunk FROM d)"""
)


@query(
    f"WITH {QUEUE_SQL}, qp AS (SELECT doc_id, k, any_value(source) AS source, any_value(question) AS question, string_agg(chunk, chr(10) ORDER BY c) AS context FROM qz JOIN qd USING (doc_id, c) WHERE bit GROUP BY doc_id, k) "
    "SELECT source, count(DISTINCT doc_id) AS docs, count(*) AS prompts, count(DISTINCT md5(length(question) || ':' || question || context)) AS calls FROM qp GROUP BY source"
)
def measure_queue(spark, sf_dir) -> DataFrame:
    """How many prompts the masks of each source make and how many calls of a reader answer them."""
    plan = measure.planned(masked_docs(spark, sf_dir), 1, ["source"])
    prompts = plan.groupBy("source", "key").agg(F.count("*").alias("n"), F.count_if(F.col("k") == -1).alias("full"))
    return prompts.groupBy("source").agg(F.sum("full").alias("docs"), F.sum("n").alias("prompts"), F.count("*").alias("calls"))


_NORMAL = "list_filter(" + TERMS + ", lambda t: t NOT IN ('a', 'an', 'the'))"
_SAID = r"array_to_string(list_filter(string_split_regex({}, '[ \t\n\f\r]+'), lambda w: w <> '')[7:10], ' ')"


@query(
    f"""WITH {QUEUE_SQL},
qh AS (SELECT *, len(list_filter(list_distinct({TERMS.format("question")}), lambda t: list_contains({TERMS.format("chunk")}, t))) AS hits, {_SAID.format("chunk")} AS said FROM qd),
qf AS (SELECT *, {_NORMAL.format("said")} AS p, {_NORMAL.format("answer")} AS r, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, c) AS place FROM qh),
qo AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(r, lambda y: y = t))))), 0) AS o FROM qf),
qs AS MATERIALIZED (SELECT *, CASE WHEN len(p) = 0 OR len(r) = 0 THEN (len(p) = len(r))::INT ELSE 2.0::DOUBLE * o / (len(p) + len(r)) END AS f1 FROM qo),
qy AS (SELECT doc_id, k, arg_min(f1, place) AS f1, arg_min(said, place) AS said FROM qz JOIN qs USING (doc_id, c) WHERE bit GROUP BY doc_id, k)
SELECT doc_id, (count(*) - 1)::INT AS masks, round(sum(f1 * (k + 1)), 6) AS mark, round(avg(f1) FILTER (k >= 0), 6) AS mean_f1, round(max(f1) FILTER (k = -1), 6) AS full_f1, max(said) FILTER (k = -1) AS full_answer FROM qy GROUP BY doc_id"""
)
def measured_answers(spark, sf_dir) -> DataFrame:
    """The measuring stage on all documents: a reader's outcomes through the queue and its sink."""
    found = measure.measure(masked_docs(spark, sf_dir), LineReader(), scratch_folder(spark, "measured"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    mark = total(F.transform("f1", lambda y, k: y * (k + 1)))
    return found.select(
        "doc_id", F.size("f1").alias("masks"), F.round(mark, 6).alias("mark"), F.round(total(F.col("f1")) / F.size("f1"), 6).alias("mean_f1"), F.round("full_f1", 6).alias("full_f1"), "full_answer"
    )

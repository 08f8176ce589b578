"""Queries over measured masks: outcomes of a reader on masked contexts, their determinism, surrogates with interactions, refits on fewer calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.functions.hashing import hash_unit
from quillsieve.functions.text import contains_answer, token_f1
from quillsieve.operators import attribution as at
from quillsieve.operators import scoring, surrogates
from quillsieve.plans.frames import HASH, TERMS
from quillsieve.plans.queries_arms import _WORDS, ROWS_SQL, arm_docs

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def measured(spark, sf_dir) -> DataFrame:
    """Documents with masks and what a reader gets from each masked context: it turns to the kept chunk that BM25 ranks first and says its seventh to tenth word."""
    docs = arm_docs(spark, sf_dir).withColumn("n", F.size("chunks"))
    said = F.transform("chunks", lambda c: F.array_join(F.slice(F.array_remove(F.split(c, r"\s+"), ""), 7, 4), " "))
    f1 = F.transform(said, lambda s: F.round(token_f1(s, F.col("answers")), 9))
    held = F.filter(F.transform("chunks", lambda c, i: F.when(contains_answer(c, F.col("answers")), i)), lambda i: i.isNotNull())
    made = F.struct(
        at.random_masks(F.col("doc_id"), F.col("n"), at.num_masks(F.col("n"))).alias("masks"), scoring.ranking(scoring.bm25(F.col("question"), F.col("chunks"))).alias("order"), f1.alias("f1"), held.alias("answers_in")
    )
    rows = docs.select("doc_id", "source", F.col("gold_chunks").alias("gold"), F.inline(F.array(made)))
    outcome = lambda m: F.element_at(F.col("f1"), F.element_at(F.filter("order", lambda i: F.element_at(m, i + 1)), 1) + 1)
    return rows.select("doc_id", "source", "gold", "answers_in", "masks", F.transform("masks", outcome).alias("y"))


_NORMAL = "list_filter(" + TERMS + ", lambda t: t NOT IN ('a', 'an', 'the'))"
MEASURED_SQL = (
    ROWS_SQL
    + rf""",
fc0 AS (SELECT kt.doc_id, kt.i, s.rb, {_NORMAL.format(f"array_to_string({_WORDS.format('kt.chunk')}[7:10], ' ')")} AS p, {_NORMAL.format('kt.answer')} AS r FROM kt JOIN s ON s.doc_id = kt.doc_id AND s.level = 'chunk' AND s.x = kt.i),
fc1 AS (SELECT doc_id, i, rb, p, r, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(r, lambda y: y = t))))), 0) AS o FROM fc0),
fc AS MATERIALIZED (SELECT doc_id, i, rb, round(CASE WHEN len(p) = 0 OR len(r) = 0 THEN (len(p) = len(r))::INT ELSE 2.0::DOUBLE * o / (len(p) + len(r)) END, 9) AS f1 FROM fc1),
mk AS (SELECT doc_id, source, len(chunks) AS n, unnest(range(0, least(256, greatest(64, len(chunks) + 1)))) AS k FROM d),
mb AS (SELECT *, unnest(range(0, n)) AS c FROM mk),
mx AS (SELECT doc_id, source, n, k, c, {HASH.format(salt="mask", key="doc_id || chr(58) || k || chr(58) || c")} < CASE WHEN k % 2 = 0 THEN 0.5 ELSE 0.25 END AS bit, floor({HASH.format(salt="flip", key="doc_id || chr(58) || k")} * n) AS pick FROM mb),
mw AS (SELECT *, sum(bit::INT) OVER (PARTITION BY doc_id, k) AS s FROM mx),
mz AS MATERIALIZED (SELECT doc_id, source, k, c, CASE WHEN (s = 0 OR (n > 1 AND s = n)) AND c = pick THEN NOT bit ELSE bit END AS bit FROM mw),
my AS MATERIALIZED (SELECT mz.doc_id, any_value(mz.source) AS source, mz.k::INT AS k, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (bit) AS mask, count(*) FILTER (bit) AS kept, arg_min(fc.f1, fc.rb) FILTER (bit) AS y FROM mz JOIN fc ON fc.doc_id = mz.doc_id AND fc.i = mz.c GROUP BY mz.doc_id, mz.k)"""
)


@query(f"WITH {MEASURED_SQL} SELECT doc_id, k, kept, round(y, 9) AS y FROM my")
def measured_outcomes(spark, sf_dir) -> DataFrame:
    """The outcome of every mask of every document."""
    rows = measured(spark, sf_dir).select("doc_id", F.posexplode(F.arrays_zip("masks", "y")).alias("k", "x"))
    return rows.select("doc_id", "k", F.size(F.filter("x.masks", lambda b: b)).cast("long").alias("kept"), F.round("x.y", 9).alias("y"))


def _noisy(y, doc, k):
    """An outcome that a reader without fixed draws would give: one in twenty is off by a tenth."""
    return F.when(hash_unit(F.concat_ws(":", doc, k), "jitter") < 0.05, y + 0.1).otherwise(y)


@query(
    f"WITH {MEASURED_SQL}, mj AS (SELECT doc_id, source, mask, y, CASE WHEN {HASH.format(salt='jitter', key='doc_id || chr(58) || k')} < 0.05 THEN y + 0.1::DOUBLE ELSE y END AS j FROM my), "
    "mg AS (SELECT doc_id, source, mask, count(*) AS n, (max(y) - min(y) > 1e-9)::INT AS y_differs, (max(j) - min(j) > 1e-9)::INT AS j_differs, max(j) - min(j) AS j_range FROM mj GROUP BY ALL) "
    "SELECT source, count(DISTINCT doc_id) AS docs, count(DISTINCT CASE WHEN n > 1 THEN doc_id END) AS docs_with_repeats, count(*) FILTER (n > 1) AS repeated, coalesce(sum(y_differs) FILTER (n > 1), 0)::BIGINT AS fixed_differ, "
    "coalesce(sum(j_differs) FILTER (n > 1), 0)::BIGINT AS drawn_differ, round(coalesce(avg(j_range) FILTER (n > 1), 0), 9) AS drawn_range FROM mg GROUP BY source"
)
def mask_determinism(spark, sf_dir) -> DataFrame:
    """Masks that a document holds several times: whether a fixed and a drawing reader say the same each time."""
    rows = measured(spark, sf_dir).select("doc_id", "source", F.posexplode(F.arrays_zip("masks", "y")).alias("k", "x"))
    rows = rows.select("doc_id", "source", F.col("x.masks").alias("mask"), F.col("x.y").alias("y"), _noisy(F.col("x.y"), F.col("doc_id"), F.col("k")).alias("j"))
    differ = lambda c: (F.max(c) - F.min(c) > 1e-9).cast("int")
    groups = rows.groupBy("doc_id", "source", "mask").agg(F.count("*").alias("n"), differ("y").alias("y_differs"), differ("j").alias("j_differs"), (F.max("j") - F.min("j")).alias("j_range"))
    several = lambda c: F.when(F.col("n") > 1, F.col(c))
    return groups.groupBy("source").agg(
        F.count_distinct("doc_id").alias("docs"), F.count_distinct(several("doc_id")).alias("docs_with_repeats"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum(several("y_differs")), F.lit(0)).cast("long").alias("fixed_differ"),
        F.coalesce(F.sum(several("j_differs")), F.lit(0)).cast("long").alias("drawn_differ"), F.round(F.coalesce(F.avg(several("j_range")), F.lit(0.0)), 9).alias("drawn_range"))


@query(
    f"""WITH {MEASURED_SQL}, sn AS (SELECT doc_id, count(*) AS n FROM my GROUP BY 1), so AS (SELECT my.doc_id, my.k, sn.n, unnest(range(0, {surrogates.DRAWS}))::INT AS draw FROM my JOIN sn USING (doc_id)),
sp1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, draw ORDER BY {HASH.format(salt='subset', key='draw || chr(58) || doc_id || chr(58) || k')}, k) AS place FROM so)
SELECT doc_id, draw, c.calls, k FROM sp1, (VALUES {', '.join(f'({c})' for c in surrogates.CALLS)}) AS c(calls) WHERE c.calls < n AND place <= c.calls"""
)
def mask_subsets(spark, sf_dir) -> DataFrame:
    """Which masks each refit on fewer calls takes; that depends on their number only, so no mask is made or answered."""
    return surrogates.subsets(arm_docs(spark, sf_dir).select("doc_id", at.num_masks(F.size("chunks")).alias("n")))


_FIGURES = 6


@query()
def interaction_gain(spark, sf_dir) -> DataFrame:
    """Held-out gain of pair interactions over the additive surrogate, by source."""
    found = surrogates.interaction_gain(measured(spark, sf_dir))
    return found.select("source", "model", "penalty", "n", *[F.round(c, _FIGURES).alias(c) for c in ("r2", "gain", "gain_se", "share_gaining", "gold_pair", "gold_main")])


@query()
def k_curve(spark, sf_dir) -> DataFrame:
    """Labels and fits from 8, 16, 32, 48 and all calls, and from sparse and dense masks at equal cost, by source."""
    found = surrogates.k_curve(measured(spark, sf_dir))
    return found.select("source", "fit", "calls", "n", *[F.round(c, _FIGURES).alias(c) for c in found.columns if c not in ("source", "fit", "calls", "n")])

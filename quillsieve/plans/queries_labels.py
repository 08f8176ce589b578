"""Queries over attributions: masks, leave-one-out labels, scores, surrogates, diagnostics of selections."""

from __future__ import annotations

import gc
import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.functions.hashing import hash_unit
from quillsieve.functions.text import gold_recall, jaccard, token_count, token_f1
from quillsieve.operators import attribution as at
from quillsieve.operators import documents as build
from quillsieve.operators import readers, scoring
from quillsieve.operators.statistics import freed, kept, spearman
from quillsieve.plans.frames import COUNT, DOCS_SQL, HASH, SCORED_SQL, doc_docs, scored_docs, table
from quillsieve.plans.queries_text import _GREEDY, selections

#: Documents of a wave of squad_documents.
WAVE = 100_000

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _masked(spark, sf_dir, *more) -> DataFrame:
    docs = doc_docs(spark, sf_dir).select("doc_id", F.size("chunks").alias("n"), *more)
    return docs.withColumn("masks", at.random_masks(F.col("doc_id"), F.col("n"), at.num_masks(F.col("n"))))


@query(f"""WITH {DOCS_SQL}, k AS (SELECT doc_id, len(chunks) AS n, least(256, greatest(64, len(chunks) + 1)) AS total FROM d),
m AS (SELECT doc_id, n, total, unnest(range(0, total)) AS k FROM k), b AS (SELECT *, unnest(range(0, n)) AS c FROM m),
x AS (SELECT doc_id, n, total, k, c, {HASH.format(salt="mask", key="doc_id || chr(58) || k || chr(58) || c")} < CASE WHEN k % 2 = 0 THEN 0.5 ELSE 0.25 END AS bit, floor({HASH.format(salt="flip", key="doc_id || chr(58) || k")} * n) AS pick FROM b),
w AS (SELECT *, sum(bit::INT) OVER (PARTITION BY doc_id, k) AS s FROM x),
z AS (SELECT doc_id, n, total, k, c, CASE WHEN (s = 0 OR (n > 1 AND s = n)) AND c = pick THEN NOT bit ELSE bit END AS bit FROM w)
SELECT doc_id, any_value(total)::INT AS masks, sum(bit::INT)::BIGINT AS kept, sum(bit::INT * (k + 1) * (c + 1))::BIGINT AS mark FROM z GROUP BY 1""")
def random_masks(spark, sf_dir) -> DataFrame:
    bits = lambda m, k: F.aggregate(F.transform(m, lambda b, c: F.when(b, (c + 1).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x) * (k + 1)
    kept = F.aggregate("masks", F.lit(0).cast("long"), lambda s, m: s + F.size(F.filter(m, lambda b: b)))
    mark = F.aggregate(F.transform("masks", bits), F.lit(0).cast("long"), lambda s, x: s + x)
    return _masked(spark, sf_dir).select("doc_id", F.size("masks").alias("masks"), kept.alias("kept"), mark.alias("mark"))


def _loo(spark, sf_dir) -> DataFrame:
    """Leave-one-out outcomes keyed by hash, and the full context's."""
    docs = doc_docs(spark, sf_dir).select("doc_id", "source", "gold_chunks", "chunks")
    y = F.transform("chunks", lambda c, i: F.round(hash_unit(F.concat_ws(":", F.col("doc_id").cast("string"), i.cast("string")), "loo"), 6))
    return docs.select("doc_id", "source", "gold_chunks", F.size("chunks").alias("n"), y.alias("y"), F.round(hash_unit(F.col("doc_id"), "full"), 6).alias("full"))


_LOO = DOCS_SQL + f""",
y AS MATERIALIZED (SELECT doc_id, source, gold, n, i, round({HASH.format(salt="full", key="doc_id")}, 6) - round({HASH.format(salt="loo", key="doc_id || chr(58) || i")}, 6) AS beta FROM (SELECT doc_id, source, gold, len(chunks) AS n, unnest(range(0, len(chunks))) AS i FROM d)),
z AS MATERIALIZED (SELECT *, CASE WHEN stddev_pop(beta) OVER w < 1e-12 THEN 0 ELSE (beta - avg(beta) OVER w) / stddev_pop(beta) OVER w END AS z, stddev_pop(beta) OVER w >= 1e-12 AS informative, row_number() OVER (PARTITION BY doc_id ORDER BY round(beta, 9) DESC, i) AS r FROM y WINDOW w AS (PARTITION BY doc_id))"""


def loo_labels_frame(spark, sf_dir) -> DataFrame:
    rows = _loo(spark, sf_dir).withColumn("beta", at.loo_utilities(F.col("y"), F.col("full")))
    return rows.withColumn("s", at.zscore(F.col("beta"))).select("doc_id", "source", "gold_chunks", "n", "full", "beta", "s.z", "s.informative")


@query(f"WITH {_LOO} SELECT doc_id, i::INT AS chunk, round(beta, 6) AS beta, round(z, 6) AS z, informative FROM z")
def loo_labels(spark, sf_dir) -> DataFrame:
    long = loo_labels_frame(spark, sf_dir).select("doc_id", "informative", F.posexplode(F.arrays_zip("beta", "z")).alias("chunk", "s"))
    return long.select("doc_id", "chunk", F.round("s.beta", 6).alias("beta"), F.round("s.z", 6).alias("z"), "informative")


@query(f"WITH {_LOO} SELECT doc_id, (r = 1)::INT::DOUBLE AS recall, round(1.0 / r, 9) AS mrr FROM z WHERE i = gold")
def gold_diagnostics(spark, sf_dir) -> DataFrame:
    rows = loo_labels_frame(spark, sf_dir).withColumn("order", scoring.ranking(F.transform("beta", lambda b: F.round(b, 9))))
    recall, mrr = at.gold_ranks(F.col("order"), F.col("gold_chunks"))
    return rows.select("doc_id", recall.alias("recall"), F.round(mrr, 9).alias("mrr"))


@query(f"WITH {_LOO}, p AS (SELECT least(9, floor(10 * i / greatest(1, n)))::INT AS bin, avg(z) AS prior, count(*) AS n FROM z WHERE informative GROUP BY 1) SELECT b.bin::INT AS bin, round(coalesce(prior, 0), 6) AS prior, coalesce(n, 0) AS n FROM range(0, 10) b(bin) LEFT JOIN p USING (bin)")
def position_prior(spark, sf_dir) -> DataFrame:
    return at.position_prior(loo_labels_frame(spark, sf_dir)).select("bin", F.round("prior", 6).alias("prior"), "n")


@query(f"""WITH {_LOO}, e AS (SELECT doc_id, i, (z + CASE WHEN i % 2 = 0 THEN z ELSE -z END) / 2 AS m FROM z WHERE informative)
SELECT doc_id, i::INT AS chunk, round(CASE WHEN stddev_pop(m) OVER w < 1e-12 THEN 0 ELSE (m - avg(m) OVER w) / stddev_pop(m) OVER w END, 6) AS z FROM e WINDOW w AS (PARTITION BY doc_id)""")
def ensemble_labels(spark, sf_dir) -> DataFrame:
    """The ensemble of two readers, the second one's labels being the first's with signs changed at odd chunks."""
    rows = loo_labels_frame(spark, sf_dir).select("doc_id", F.lit("a").alias("reader"), "z", "informative", F.col("full").alias("full_f1"))
    other = rows.withColumn("reader", F.lit("b")).withColumn("z", F.transform("z", lambda z, i: F.when(i % 2 == 0, z).otherwise(-z)))
    joint = at.ensemble(rows.union(other))
    return joint.select("doc_id", F.posexplode("z").alias("chunk", "z")).withColumn("z", F.round("z", 6))


@query(f"""WITH {SCORED_SQL}, k AS (SELECT doc_id, rank() OVER (PARTITION BY doc_id ORDER BY bm25) + (count(*) OVER (PARTITION BY doc_id, bm25) - 1) / 2.0 AS a, i + 1 AS b FROM s)
SELECT doc_id, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 6) END AS rho FROM k GROUP BY 1""")
def spearman_scores(spark, sf_dir) -> DataFrame:
    long = scored_docs(spark, sf_dir).select("doc_id", F.posexplode("bm25").alias("i", "score"))
    return spearman(long, ["doc_id"], "score", "i").select("doc_id", F.round("rho", 6).alias("rho"))


@query(f"""WITH {SCORED_SQL}, g AS (SELECT doc_id, rank, CASE WHEN i = gold THEN 1.0 WHEN i % 3 = 0 THEN 0.25 ELSE 0 END AS gain FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gain DESC) AS ideal FROM g)
SELECT doc_id, round(sum(CASE WHEN rank <= 5 THEN gain / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN ideal <= 5 THEN gain / log2(ideal + 1) ELSE 0 END), 6) AS ndcg FROM o GROUP BY 1""")
def ndcg_scores(spark, sf_dir) -> DataFrame:
    docs = scored_docs(spark, sf_dir)
    gains = F.transform("chunks", lambda c, i: F.when(F.array_contains("gold_chunks", i), F.lit(1.0)).when(i % 3 == 0, F.lit(0.25)).otherwise(F.lit(0.0)))
    return docs.withColumn("order", scoring.ranking(F.col("bm25"))).withColumn("gains", gains).select("doc_id", F.round(at.ndcg(F.col("order"), F.col("gains"), 5), 6).alias("ndcg"))


def _outcomes(spark, sf_dir) -> DataFrame:
    """A row for each random mask of each document: the share of the gold chunk's and the first chunk's weight that it keeps, with noise."""
    rows = _masked(spark, sf_dir, F.element_at("gold_chunks", 1).alias("gold"))
    long = rows.select("doc_id", "gold", F.posexplode("masks").alias("k", "mask"))
    noise = hash_unit(F.concat_ws(":", "doc_id", "k"), "noise") * 0.02
    y = F.when(F.element_at("mask", F.col("gold") + 1), 0.6).otherwise(0.0) + F.when(F.element_at("mask", 1), 0.2).otherwise(0.0) + noise
    return long.select("doc_id", "k", F.transform("mask", lambda b: b.cast("double")).alias("mask"), y.alias("y"))


def _listed_outcomes(spark, sf_dir) -> DataFrame:
    """_outcomes() with a document's masks in one row."""
    rows = _masked(spark, sf_dir, F.element_at("gold_chunks", 1).alias("gold"))

    def outcome(m, k):
        noise = hash_unit(F.concat_ws(":", "doc_id", k), "noise") * 0.02
        return F.when(F.element_at(m, F.col("gold") + 1), 0.6).otherwise(0.0) + F.when(F.element_at(m, 1), 0.2).otherwise(0.0) + noise

    made = rows.select("doc_id", "gold", F.explode(F.array("masks")).alias("masks"))  # a generator of one row: masks are made once
    return made.select("doc_id", "masks", F.transform("masks", outcome).alias("y"))


@query(f"WITH {DOCS_SQL} SELECT doc_id, len(chunks)::INT AS n, 0.0::DOUBLE AS violation FROM d")
def ridge_certificate(spark, sf_dir) -> DataFrame:
    """Ridge surrogates with how far they are from their normal equations."""
    fits = at.fit_ridge(_outcomes(spark, sf_dir), 1.0)
    return fits.select("doc_id", F.size("beta").alias("n"), (F.round("residual", 6) + 0.0).alias("violation"))


@query()
def ridge_alpha(spark, sf_dir) -> DataFrame:
    """The held-out error of each penalty, least first."""
    return at.select_alpha_of(_listed_outcomes(spark, sf_dir)).select("alpha", F.round("cv_mse", 9).alias("cv_mse"))


@query(f"""WITH {_GREEDY}, l AS (SELECT doc_id, ratio, any_value(kept) AS kept FROM sel GROUP BY ALL), x AS (SELECT a.doc_id, a.ratio, list_intersect(a.kept, b.kept) AS i, list_distinct(list_concat(a.kept, b.kept)) AS u FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.ratio = 2.0 WHERE a.ratio <> 2.0)
SELECT ratio, count(*) AS n, round(avg(CASE WHEN len(u) = 0 THEN 1 ELSE len(i) / len(u) END), 6) AS overlap FROM x GROUP BY 1""")
def overlap_jaccard(spark, sf_dir) -> DataFrame:
    rows = selections(spark, sf_dir).select("doc_id", "ratio", "kept")
    base = rows.where("ratio = 2.0").select("doc_id", F.col("kept").alias("other"))
    return rows.where("ratio <> 2.0").join(base, "doc_id").groupBy("ratio").agg(F.count("*").alias("n"), F.round(F.avg(jaccard(F.col("kept"), F.col("other"))), 6).alias("overlap"))


@query(f"""WITH {_GREEDY} SELECT source, ratio, count(*) AS n, round(avg(list_contains(kept, gold)::INT), 6) AS answer_in_context, round(avg(kept_tokens / budget), 6) AS budget_use, round(avg(len(kept)), 6) AS chunks FROM sel GROUP BY ALL""")
def coverage(spark, sf_dir) -> DataFrame:
    rows = selections(spark, sf_dir)
    held = F.avg(gold_recall(F.col("kept"), F.col("gold_chunks")))
    return rows.groupBy("source", "ratio").agg(F.count("*").alias("n"), F.round(held, 6).alias("answer_in_context"), F.round(F.avg(F.col("kept_tokens") / F.col("budget")), 6).alias("budget_use"), F.round(F.avg(F.size("kept")), 6).alias("chunks"))


@query()
def lexical_answers(spark, sf_dir) -> DataFrame:
    """Answers of the lexical readers on BM25 selections at a quarter of the tokens, scored; by reader and language."""
    docs = selections(spark, sf_dir, ratios=(4.0,)).join(doc_docs(spark, sf_dir).select("doc_id", "question"), "doc_id")
    said = readers.answered(docs.select("doc_id", "language", "answers", "question", F.col("text").alias("context")))
    return said.groupBy("reader", "language").agg(F.count("*").alias("n"), F.round(F.avg(token_f1(F.col("answer"), F.col("answers"))), 6).alias("f1"))


#: Lines in digest order, draws of each needle, and lines taken up to the first that overflows; {pool} and {needles} are SELECTs.
_HAYSTACK = r"""
hp AS (SELECT DISTINCT chunk FROM ({pool})), hl AS MATERIALIZED (SELECT chunk, row_number() OVER (ORDER BY sha1(chunk), chunk) - 1 AS i FROM hp),
hn AS (SELECT count(*) AS n, 4 * ceil(30000 / avg(length(chunk)))::BIGINT + 16 AS most FROM hl), ha AS MATERIALIZED ({needles}),
hd AS (SELECT doc_id, needle, answer, n, unnest(range(0, most)) AS j FROM ha, hn),
hi AS (SELECT doc_id, any_value(needle) AS needle, any_value(answer) AS answer, min(j) AS j, i FROM (SELECT *, floor(n * {unit})::BIGINT AS i FROM hd) GROUP BY doc_id, i),
hu AS (SELECT doc_id, chunk, j, length(needle) + sum(length(chunk)) OVER w AS total, row_number() OVER w AS r FROM hi JOIN hl USING (i) WHERE chunk <> needle AND NOT contains(lower(regexp_replace(chunk, '^\s+|\s+$', '', 'g')), lower(regexp_replace(answer, '^\s+|\s+$', '', 'g'))) WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
hk AS (SELECT * FROM (SELECT *, min(CASE WHEN total > 30000 AND r > 1 THEN r END) OVER (PARTITION BY doc_id) AS cut FROM hu) WHERE r < cut),
ho AS (SELECT doc_id, list(chunk ORDER BY r) AS others FROM hk GROUP BY doc_id),
hg AS (SELECT doc_id, others, floor({gap} * (len(others) + 1))::INT AS gold FROM ho)"""
_DRAW, _GAP = HASH.format(salt="draw", key="doc_id || chr(58) || j"), HASH.format(salt="gap", key="doc_id")


@query(
    "WITH "
    + _HAYSTACK.format(
        pool="SELECT chunk FROM (SELECT unnest(string_split(text, chr(10))) AS chunk FROM documents) WHERE trim(chunk, ' ') <> ''",
        needles="SELECT item_id AS doc_id, text AS needle, array_to_string(string_split(text, ' ')[1:5], ' ') AS answer FROM benchmark", unit=_DRAW, gap=_GAP)
    + " SELECT doc_id, (len(others) + 1)::INT AS n_chunks, gold, md5(array_to_string(list_concat(list_concat(others[1 : gold], [needle]), others[gold + 1 :]), chr(10))) AS chunks_md5 FROM hg JOIN ha USING (doc_id)"
)
def haystacks(spark, sf_dir) -> DataFrame:
    """Benchmark passages hidden among 30,000 characters of document lines, drawn from all of them."""
    pool = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("chunk")).where(F.trim("chunk") != "").distinct()
    needles = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("needle"), F.array(F.substring_index("text", " ", 5)).alias("answers"))
    docs = build.haystacks(needles, pool)
    return docs.select("doc_id", F.size("chunks").alias("n_chunks"), "gold", F.md5(F.array_join("chunks", "\n")).alias("chunks_md5"))


@query(
    "WITH "
    + DOCS_SQL
    + ", "
    + _HAYSTACK.format(
        pool="SELECT chunks[gold + 1] AS chunk FROM d", needles="SELECT 'web_test_' || doc_id AS doc_id, chunks[gold + 1] AS needle, answers[1] AS answer, language AS title, source AS cluster FROM d", unit=_DRAW, gap=_GAP)
    + " SELECT doc_id, cluster AS cluster_id, title, (len(others) + 1)::INT AS n_chunks, gold, round(gold / greatest(1, len(others)), 9) AS needle_relpos, md5(array_to_string(list_concat(list_concat(others[1 : gold], [needle]), others[gold + 1 :]), chr(10))) AS chunks_md5 FROM hg JOIN ha USING (doc_id)"
)
def squad_documents(spark, sf_dir) -> DataFrame:
    """Documents from question rows: each document's asked line among those of all others, up to 30,000 characters.

    A document becomes 30,000 characters long, many times its own text, so large tables go in waves of
    WAVE documents, each among the lines of all: only a wave's lines lie on disk at a time.
    """
    docs = doc_docs(spark, sf_dir)
    rows = docs.select(F.col("doc_id").alias("id"), F.col("language").alias("title"), F.element_at("chunks", F.element_at("gold_chunks", 1) + 1).alias("context"), "question", "answers", F.col("source").alias("cluster"))
    rows = kept(rows)
    waves = math.ceil(rows.count() / WAVE)
    if waves <= 1:
        return _digests(build.squad_documents(rows, rows, "web", "test", "en"))
    done = []
    for wave in range(waves):
        scratch: list = []
        chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == wave)
        done.append(kept(_digests(build.squad_documents(rows, chosen, "web", "test", "en", scratch=scratch))))
        for x in scratch:
            freed(x)
        # Spark deletes shuffle files once nothing on the driver refers to them.
        del scratch, chosen
        gc.collect()
        spark._jvm.System.gc()
    return reduce(DataFrame.union, done)


def _digests(built: DataFrame) -> DataFrame:
    gold = F.element_at("gold_chunks", 1)
    return built.select(
        "doc_id", "cluster_id", F.col("metadata.title").alias("title"), F.size("chunks").alias("n_chunks"), gold.alias("gold"), F.round("metadata.needle_relpos", 9).alias("needle_relpos"), F.md5(F.array_join("chunks", "\n")).alias("chunks_md5")
    )


@query(f"""WITH {DOCS_SQL}, c AS (SELECT doc_id, list_transform(chunks, lambda c: least(512, {COUNT.format("c")}))::INT[] AS n FROM d),
w AS (SELECT doc_id, list_reduce(list_transform(n, lambda x: {{'used': x, 'w': [0]}}), lambda a, x: CASE WHEN a.used + x.used <= 256 OR len(a.w) = 0 THEN {{'used': a.used + x.used, 'w': list_append(a.w, CASE WHEN len(a.w) = 0 THEN 0 ELSE a.w[len(a.w)] END)}} ELSE {{'used': x.used, 'w': list_append(a.w, a.w[len(a.w)] + 1)}} END, {{'used': 0, 'w': []::INT[]}}) AS a FROM c)
SELECT doc_id, len(a.w)::INT AS chunks, (a.w[len(a.w)] + 1)::INT AS windows FROM w""")
def window_packing(spark, sf_dir) -> DataFrame:
    """Chunks packed in order into windows of 256 tokens, the next opened where one doesn't fit."""
    docs = doc_docs(spark, sf_dir).select("doc_id", F.transform("chunks", lambda c: F.least(F.lit(512), token_count(c))).alias("n"))
    packed = docs.select("doc_id", build.packed(F.col("n"), 256).alias("w"))
    return packed.select("doc_id", F.size("w").alias("chunks"), (F.element_at("w", -1) + 1).alias("windows"))

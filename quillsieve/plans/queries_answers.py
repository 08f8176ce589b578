"""Queries over answers to real selections: cells, pre-registered families, retention of reader upgrades, wild intervals, equal compression.

The readers are lexical: each looks for the question in the part of the context that it reads and
says the four words after it, or the first four words if it isn't there. They differ in how far they
read, so compression and order of a context decide what they find.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.functions.text import answer_scores, contains_answer, normalize_answer
from quillsieve.operators import statistics as st
from quillsieve.plans.frames import HASH, TERMS
from quillsieve.plans.queries_arms import _WORDS, LABELS, RATIOS, ROWS_SQL, selected

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Characters of a context that each reader reads; the last one is held out from label readers.
READERS = (("short", 400), ("long", 100_000_000), ("held", 1500))
HELD_OUT = "held"
#: Limits from here on read any context whole.
WHOLE = 100_000_000
DRAWS = 1000
#: What takes the roles of the registered arms.
OURS, ENSEMBLE, SPAN = "bm25", "fused", "oracle_span"
RIVALS = ("lead", "random", "embed", "llmlingua2")
#: Least gap between readers on full contexts for an upgrade, and the margin of equivalence.
LEAST_GAP, MARGIN = 0.05, 0.05


def answers(spark, sf_dir, arms: list[str] | None = None, where: str = "true", readers: tuple = READERS) -> DataFrame:
    """Answer rows: a selection row and a reader, with answer, em, f1 and recall, and whether an answer stands in the context.

    arms, where and readers leave out, before anything is selected, what a query doesn't read.
    """
    docs = selected(spark, sf_dir, arms, where)
    # A text is searched once for all readers, an alias split once a row.
    rows = docs.withColumn("held", contains_answer(F.col("text"), F.col("answers"))).select("*", F.inline(F.array(F.struct(F.regexp_replace("text", r"\s+", " ").alias("plain"), F.transform("answers", lambda a: normalize_answer(a)).alias("normal")))))
    place = F.position(F.concat(F.lit(" "), F.col("question"), F.lit(" ")), F.concat(F.lit(" "), F.col("plain"), F.lit(" ")))

    def words_from(c: Column, start: Column) -> Column:
        """The first four words; single spaces part them, so of five pieces one at most is empty."""
        return F.array_join(F.slice(F.array_remove(F.slice(F.split(F.substring("plain", start, F.length("plain")) if c is None else c, " ", 6), 1, 5), ""), 1, 4), " ")

    rows = rows.select("*", F.inline(F.array(F.struct(place.alias("at"), words_from(F.col("plain"), F.lit(1)).alias("first")))))
    rows = rows.select("*", F.inline(F.array(F.struct(F.when(F.col("at") > 0, words_from(None, F.col("at") + F.length("question"))).alias("after")))))

    def said(limit: int):
        # Found where the whole question is read.
        found = (F.col("at") > 0) & (F.col("at") + F.length("question") <= limit + 1)
        head = F.col("first") if limit >= WHOLE else words_from(F.substring("plain", 1, limit), F.lit(1))
        return F.when(found, F.col("after")).otherwise(head)

    # Readers mostly say the same: each different answer of a row is scored once.
    told = F.array(*[said(limit) for _, limit in readers])
    rows = rows.select(*[c for c in rows.columns if c not in ("text", "plain", "at", "first", "after")], F.inline(F.array(F.struct(told.alias("told")))))
    scored = F.transform(F.array_distinct("told"), lambda t: answer_scores(t, F.col("normal")))
    rows = rows.select("*", F.inline(F.array(F.struct(F.array_distinct("told").alias("each"), scored.alias("scored")))))
    of = lambda i: F.element_at("scored", F.array_position("each", F.get("told", F.lit(i))).cast("int"))
    made = F.array(*[F.struct(F.lit(name).alias("reader"), of(i)["em"].alias("em"), F.round(of(i)["f1"], 9).alias("f1"), F.round(of(i)["recall"], 9).alias("recall")) for i, (name, _) in enumerate(readers)])
    return rows.select(
        F.inline(made), "doc_id", "arm", F.coalesce(F.col("ratio").cast("string"), F.lit("full")).alias("ratio"), "source", "language", "hop", "cluster_id", "n_gold", "full_tokens", "budget", "kept_tokens", "truncated", "kept", "partial",
        "gold_recall", "gold_chunks", "held")


_NORMAL = "list_filter(" + TERMS + ", lambda t: t NOT IN ('a', 'an', 'the'))"
ANSWERS_SQL = (
    ROWS_SQL
    + rf""",
rd AS (SELECT *, regexp_replace(text, '\s+', ' ', 'g') AS plain FROM arm_rows),
re1 AS (SELECT rd.*, r.reader, r.most, position(' ' || question || ' ' IN ' ' || plain || ' ') AS found_at FROM rd, (VALUES {', '.join(f"('{n}', {m})" for n, m in READERS)}) AS r(reader, most)),
re2 AS (SELECT *, array_to_string({_WORDS.format("CASE WHEN found_at > 0 AND found_at + length(question) <= most + 1 THEN substr(plain, found_at + length(question)) ELSE left(plain, most) END")}[1:4], ' ') AS said FROM re1),
re3 AS (SELECT *, {_NORMAL.format('said')} AS p, {_NORMAL.format('answer')} AS r FROM re2),
re4 AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(r, lambda y: y = t))))), 0) AS o FROM re3),
an AS MATERIALIZED (
  SELECT reader, doc_id, arm, coalesce(ratio::VARCHAR, 'full') AS ratio, source, language, hop, cluster_id, n_gold, full_tokens, budget, kept_tokens, truncated, kept, partial, gold, gold_recall, contains(lower(text), lower(answer)) AS held,
    (p = r)::INT::DOUBLE AS em, round(CASE WHEN len(p) = 0 OR len(r) = 0 THEN (len(p) = len(r))::INT ELSE 2.0::DOUBLE * o / (len(p) + len(r)) END, 9) AS f1, round(CASE WHEN len(r) > 0 THEN o / len(r) ELSE 0 END, 9) AS recall FROM re4)"""
)


@query(f"WITH {ANSWERS_SQL} SELECT reader, doc_id, arm, ratio, em, f1, recall, held FROM an")
def answer_rows(spark, sf_dir) -> DataFrame:
    return answers(spark, sf_dir).select("reader", "doc_id", "arm", "ratio", "em", "f1", "recall", "held")


CELL = ["reader", "source", "ratio", "arm"]


def figure(value: Column | str) -> Column:
    """A figure with nine digits. Means of values that have nine often lie between two ninth digits; a shift, here and in SQL, keeps sums in another order from rounding apart."""
    return F.round((F.col(value) if isinstance(value, str) else value) + 3e-11, 9)




def _draws_sql(rows: str, keys: str, values: tuple[str, ...], draws: int = DRAWS) -> str:
    """bo: means of values in each cell for each draw of clusters with replacement."""
    sums = ", ".join(f"sum({v}) AS {v}" for v in values)
    means = ", ".join(f"sum({v} * times) / sum(size * times) AS {v}" for v in values)
    return (
        f"cs AS (SELECT {keys}, cluster_id, count(*) AS size, {sums}, (row_number() OVER (PARTITION BY {keys} ORDER BY cluster_id)) - 1 AS j FROM {rows} GROUP BY {keys}, cluster_id), "
        f"cells AS (SELECT {keys}, count(*) AS k FROM cs GROUP BY {keys}), "
        f"dr AS MATERIALIZED (SELECT k, b, j, count(*) AS times FROM (SELECT k, b, floor(k * {HASH.format(salt='boot', key='b || chr(58) || s')})::BIGINT AS j FROM (SELECT *, unnest(range(0, k)) AS s FROM (SELECT *, unnest(range(0, {draws})) AS b FROM (SELECT DISTINCT k FROM cells)))) GROUP BY ALL), "
        f"bo AS MATERIALIZED (SELECT {keys}, b, {means} FROM cs JOIN cells USING ({keys}) JOIN dr USING (k, j) GROUP BY {keys}, b)"
    )


@query(
    f"WITH {ANSWERS_SQL}, {_draws_sql('an', 'reader, source, ratio, arm', ('f1',))}, ci AS (SELECT reader, source, ratio, arm, quantile_cont(f1, 0.025) AS lo, quantile_cont(f1, 0.975) AS hi FROM bo GROUP BY ALL) "
    "SELECT reader, source, ratio, arm, count(*) AS n, count(DISTINCT cluster_id) AS n_clusters, round(avg(f1) + 3e-11::DOUBLE, 9) AS f1, round(any_value(lo) + 3e-11::DOUBLE, 9) AS f1_lo, round(any_value(hi) + 3e-11::DOUBLE, 9) AS f1_hi, round(median(f1) + 3e-11::DOUBLE, 9) AS f1_median, round(avg(em) + 3e-11::DOUBLE, 9) AS em, "
    "round(avg(recall) + 3e-11::DOUBLE, 9) AS recall, round(avg(gold_recall) + 3e-11::DOUBLE, 9) AS gold_recall, round(avg(full_tokens / greatest(1, kept_tokens)) + 3e-11::DOUBLE, 9) AS compression, round(avg(kept_tokens / greatest(1, budget)) + 3e-11::DOUBLE, 9) AS budget_use, round(avg(truncated::INT) + 3e-11::DOUBLE, 9) AS truncated, "
    "round(avg(held::INT) + 3e-11::DOUBLE, 9) AS answer_in, round(avg(f1) FILTER (held) + 3e-11::DOUBLE, 9) AS f1_answer_in, round(avg(f1) FILTER (NOT held) + 3e-11::DOUBLE, 9) AS f1_answer_out, round(avg(len(kept) + len(partial)) FILTER (len(kept) + len(partial) > 0) + 3e-11::DOUBLE, 9) AS touched, "
    "round(avg((len(list_intersect(kept, gold)) = len(gold))::INT) FILTER (gold_recall IS NOT NULL) + 3e-11::DOUBLE, 9) AS all_gold FROM an JOIN ci USING (reader, source, ratio, arm) GROUP BY ALL"
)
def arm_cells(spark, sf_dir) -> DataFrame:
    """Every cell of reader, source, ratio and arm: answer metrics with a cluster-bootstrap interval, what was kept, and F1 where the answer stands in the context and where not."""
    touched = F.size("kept") + F.size("partial")
    each = {
        "f1": F.col("f1"), "em": F.col("em"), "recall": F.col("recall"), "gold_recall": F.col("gold_recall"), "compression": F.col("full_tokens") / F.greatest(F.lit(1), "kept_tokens"), "budget_use": F.col("kept_tokens") / F.greatest(F.lit(1), "budget"),
        "truncated": F.col("truncated").cast("int"), "answer_in": F.col("held").cast("int"), "f1_answer_in": F.when(F.col("held"), F.col("f1")), "f1_answer_out": F.when(~F.col("held"), F.col("f1")), "touched": F.when(touched > 0, touched),
        "all_gold": F.when(F.col("gold_recall").isNotNull(), (F.size(F.array_except("gold_chunks", "kept")) == 0).cast("int"))}
    # One pass over the rows: sums of each cluster and value of F1, of which there are few; the median needs no more.
    sums = answers(spark, sf_dir).select(*CELL, "cluster_id", F.col("f1").alias("value"), *[c.cast("double").alias(k) for k, c in each.items()])
    sums = st.kept(sums.groupBy(*CELL, "cluster_id", "value").agg(F.count("*").alias("n"), *[x for k in each for x in (F.sum(k).alias(k), F.count(k).alias(f"n_{k}"))]))
    ends = lambda means, drawn: dict(zip(("f1_lo", "f1_hi"), st.quantiles(drawn[:, 0]), strict=True))
    clusters = st.kept(sums.groupBy(*CELL, "cluster_id").agg(F.sum("n").alias("size"), F.sum("f1").alias("f1")))
    interval = st.bootstrapped_sums(clusters, CELL, "cluster_id", ["f1"], "f1_lo double, f1_hi double", ends, DRAWS)
    cells = sums.groupBy(*CELL).agg(F.sum("n").alias("n"), figure(F.percentile("value", F.lit(0.5), F.col("n"))).alias("f1_median"), *[figure(F.try_divide(F.sum(k), F.sum(f"n_{k}"))).alias(k) for k in each])
    found = cells.join(clusters.groupBy(*CELL).agg(F.count("*").alias("n_clusters")), CELL).join(interval, CELL)
    return found.withColumn("f1_lo", figure("f1_lo")).withColumn("f1_hi", figure("f1_hi"))


def pairs(rows: DataFrame, ours: str, others: tuple[str, ...]) -> DataFrame:
    """reader, source, hop, cluster_id, doc_id, ratio, vs, d, tokens, other_tokens: ours minus each other arm at each ratio, the full context at all of them. A document's rows meet in one aggregation instead of a self-join."""
    own = F.map_from_entries(F.collect_list(F.struct(F.struct("arm", "ratio"), F.struct("f1", "kept_tokens", "n_gold"))))
    each = rows.where(F.col("arm").isin(ours, *others)).groupBy("reader", "source", "hop", "cluster_id", "doc_id").agg(own.alias("m"))
    get = lambda arm, ratio: F.try_element_at("m", F.struct(F.lit(arm).alias("arm"), F.lit(ratio).alias("ratio")))
    listed = F.array(*[F.struct(F.lit(str(r)).alias("ratio"), F.lit(o).alias("vs"), get(ours, str(r)).alias("a"), get(o, "full" if o == "full" else str(r)).alias("b")) for r in RATIOS for o in others])
    long = each.select("reader", "source", "hop", "cluster_id", "doc_id", F.inline(listed)).where("a IS NOT NULL AND b IS NOT NULL")
    return long.select("reader", "source", "hop", "cluster_id", "doc_id", "ratio", "vs", F.round(F.col("a.f1") - F.col("b.f1"), 9).alias("d"), F.col("a.kept_tokens").alias("tokens"), F.col("b.kept_tokens").alias("other_tokens"), F.col("a.n_gold").alias("n_gold"))


_OTHERS = (*RIVALS, SPAN, ENSEMBLE, "full")
PAIRS_SQL = (
    ANSWERS_SQL
    + f""",
pr AS MATERIALIZED (SELECT a.reader, a.source, a.hop, a.cluster_id, a.doc_id, a.ratio, b.arm AS vs, round(a.f1 - b.f1, 9) AS d, a.kept_tokens AS tokens, b.kept_tokens AS other_tokens, a.n_gold
  FROM an a JOIN an b ON a.reader = b.reader AND a.doc_id = b.doc_id AND (b.ratio = a.ratio OR b.ratio = 'full') WHERE a.arm = '{OURS}' AND b.arm IN ({', '.join(f"'{o}'" for o in _OTHERS)}))"""
)
PAIR = ["reader", "source", "ratio", "vs"]


@query(
    f"""WITH {PAIRS_SQL}, cl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY reader, source, ratio, vs ORDER BY cluster_id) - 1 AS j FROM (SELECT reader, source, ratio, vs, cluster_id, sum(d) AS s, count(*) AS m FROM pr GROUP BY ALL)),
ce AS (SELECT reader, source, ratio, vs, count(*) AS k, sum(s) AS t, sum(m) AS n, sum(s) / sum(m) AS mean FROM cl GROUP BY ALL HAVING count(*) > 1),
x AS (SELECT *, unnest(range(0, 1::BIGINT << k::INT)) AS x FROM ce),
v AS MATERIALIZED (SELECT x.reader, x.source, x.ratio, x.vs, x.x, any_value(mean) AS mean, any_value(k) AS k, any_value(n) AS n, any_value(t) AS t, sum(CASE WHEN (x.x >> j::INT) & 1 = 1 THEN -1 ELSE 1 END * (s - m * mean)) AS r,
  sum(CASE WHEN (x.x >> j::INT) & 1 = 1 THEN -1 ELSE 1 END * (s + m * {MARGIN}::DOUBLE)) AS up, sum(CASE WHEN (x.x >> j::INT) & 1 = 1 THEN -1 ELSE 1 END * (s - m * {MARGIN}::DOUBLE)) AS down FROM x JOIN cl USING (reader, source, ratio, vs) GROUP BY ALL),
p AS (SELECT reader, source, ratio, vs, any_value(mean) AS mean, any_value(k)::INT AS clusters, quantile_cont(mean + r / n, 0.025) AS lo, quantile_cont(mean + r / n, 0.975) AS hi, avg((up >= t + n * {MARGIN}::DOUBLE - 1e-12)::INT) AS above, avg((down <= t - n * {MARGIN}::DOUBLE + 1e-12)::INT) AS below FROM v GROUP BY ALL),
e AS (SELECT cl.reader, cl.source, cl.ratio, cl.vs, sqrt(any_value(k) / (any_value(k) - 1) * sum(pow(s - m * mean, 2))) / any_value(n) AS se FROM cl JOIN ce USING (reader, source, ratio, vs) GROUP BY ALL)
SELECT reader, source, ratio, vs, clusters, round(mean + 3e-11::DOUBLE, 9) AS mean, round(lo + 3e-11::DOUBLE, 9) AS lo, round(hi + 3e-11::DOUBLE, 9) AS hi, round(above + 3e-11::DOUBLE, 9) AS above_p, round(greatest(above, below) + 3e-11::DOUBLE, 9) AS equal_p, round(se + 3e-11::DOUBLE, 9) AS se, round(se * (1.6448536269514722::DOUBLE + 0.8416212335729143::DOUBLE) + 3e-11::DOUBLE, 9) AS mde FROM p JOIN e USING (reader, source, ratio, vs)"""
)
def wild_ci(spark, sf_dir) -> DataFrame:
    """Wild cluster-bootstrap intervals, sign-flip tests against the margin, robust errors and least detectable effects of every comparison."""
    found = st.wild(pairs(answers(spark, sf_dir, [OURS, *_OTHERS]), OURS, _OTHERS), PAIR, "cluster_id", "d", MARGIN)
    return found.select(*PAIR, "clusters", *[figure(c).alias(c) for c in ("mean", "lo", "hi", "above_p", "equal_p", "se", "mde")])


def families(rows: DataFrame) -> DataFrame:
    """family, reader, source, ratio, vs, n, diff, p, budget_mismatch of the paired families: H1 over rivals, H1-oracle near the full context, H2a over the span oracle on multi-hop documents and H2b as good as it on others, H2a-support with two or more gold chunks."""
    long = pairs(rows, OURS, _OTHERS)
    rivals, multi = F.col("vs").isin(*RIVALS), F.col("hop") == "multi"
    of = F.array_compact(F.array(
        F.when(rivals, F.lit("H1")), F.when(F.col("vs") == "full", F.lit("H1-oracle")), F.when((F.col("vs") == SPAN) & multi, F.lit("H2a")), F.when((F.col("vs") == SPAN) & ~multi, F.lit("H2b")),
        F.when((F.col("vs") == SPAN) & multi & (F.col("n_gold") >= 2), F.lit("H2a-support"))))
    long = long.withColumn("family", F.explode(of))
    keys = ["family", *PAIR]
    every = lambda means, drawn: {"diff": float(means[0]), "superiority": st.one_sided(drawn[:, 0], "superiority"), "noninferiority": st.one_sided(drawn[:, 0], "noninferiority", MARGIN), "equivalence": st.one_sided(drawn[:, 0], "equivalence", MARGIN)}
    sums = st.cluster_table(long, keys, "cluster_id", ["d"], ("tokens", "other_tokens"))
    tests = st.bootstrapped_sums(sums, keys, "cluster_id", ["d"], "diff double, superiority double, noninferiority double, equivalence double", every, DRAWS)
    share = lambda c: F.sum(c) / F.sum("size")
    tokens = sums.groupBy(*keys).agg(F.sum("size").alias("n"), (share("tokens") / F.greatest(F.lit(1.0), share("other_tokens"))).alias("t")).where("n > 1")
    p = F.when(F.col("family") == "H1-oracle", F.col("noninferiority")).when(F.col("family") == "H2b", F.col("equivalence")).otherwise(F.col("superiority"))
    return tests.join(tokens, keys).select(*keys, "n", "diff", p.alias("p"), (F.abs(F.col("t") - 1) > 0.1).alias("budget_mismatch"))


_FAMILY = (
    PAIRS_SQL
    + f""",
fm AS MATERIALIZED (SELECT *, unnest(list_filter([CASE WHEN vs IN ({', '.join(f"'{o}'" for o in RIVALS)}) THEN 'H1' END, CASE WHEN vs = 'full' THEN 'H1-oracle' END, CASE WHEN vs = '{SPAN}' AND hop = 'multi' THEN 'H2a' END, CASE WHEN vs = '{SPAN}' AND hop <> 'multi' THEN 'H2b' END,
  CASE WHEN vs = '{SPAN}' AND hop = 'multi' AND n_gold >= 2 THEN 'H2a-support' END], lambda x: x IS NOT NULL)) AS family FROM pr),
{_draws_sql('fm', 'family, reader, source, ratio, vs', ('d',))},
tk AS (SELECT family, reader, source, ratio, vs, count(*) AS n, avg(d) AS diff, avg(tokens) / greatest(1.0::DOUBLE, avg(other_tokens)) AS t FROM fm GROUP BY ALL HAVING count(*) > 1),
ts AS (SELECT family, reader, source, ratio, vs, (CASE WHEN family = 'H1-oracle' THEN count(*) FILTER (d <= -{MARGIN}::DOUBLE) WHEN family = 'H2b' THEN greatest(count(*) FILTER (d <= -{MARGIN}::DOUBLE), count(*) FILTER (d >= {MARGIN}::DOUBLE)) ELSE count(*) FILTER (d <= 0) END + 1) / (count(*) + 1) AS p FROM bo GROUP BY family, reader, source, ratio, vs),
tt AS (SELECT ts.*, tk.n, tk.diff, abs(t - 1.0::DOUBLE) > 0.1::DOUBLE AS budget_mismatch FROM ts JOIN tk USING (family, reader, source, ratio, vs)),
h AS (SELECT *, max(least(1.0::DOUBLE, (m - r + 1) * p)) OVER (PARTITION BY family ORDER BY r) AS holm FROM (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, reader || source || ratio || vs) AS r FROM tt))"""
)


@query(f"WITH {_FAMILY} SELECT family, reader, source, ratio, vs, n, round(diff + 3e-11::DOUBLE, 9) AS diff, round(p + 3e-11::DOUBLE, 9) AS p, round(holm + 3e-11::DOUBLE, 9) AS holm, budget_mismatch FROM h")
def family_tests(spark, sf_dir) -> DataFrame:
    """Every pre-registered test on real selections, Holm-adjusted within its family."""
    tests = families(answers(spark, sf_dir, [OURS, *_OTHERS])).withColumn("tie", F.concat("reader", "source", "ratio", "vs"))
    found = st.adjusted(tests, "p", ["family"], "tie")
    return found.select("family", *PAIR, "n", figure("diff").alias("diff"), figure("p").alias("p"), figure("holm").alias("holm"), "budget_mismatch")


@query(f"WITH {_FAMILY} SELECT family, count(*) AS n_tests, count(*) FILTER (holm < 0.05) AS n_supported, count(*) FILTER (budget_mismatch) AS n_budget_mismatch FROM h GROUP BY 1")
def family_summary(spark, sf_dir) -> DataFrame:
    """Tests, supported tests and tests with unlike budgets of each family."""
    tests = families(answers(spark, sf_dir, [OURS, *_OTHERS])).withColumn("tie", F.concat("reader", "source", "ratio", "vs"))
    found = st.adjusted(tests, "p", ["family"], "tie")
    return found.groupBy("family").agg(F.count("*").alias("n_tests"), F.count_if(F.col("holm") < 0.05).alias("n_supported"), F.count_if("budget_mismatch").alias("n_budget_mismatch"))


@query(
    f"WITH {ANSWERS_SQL}, bg AS (SELECT source, ratio, arm, avg(f1) FILTER (gold_recall = 1) AS f1_all, count(*) FILTER (gold_recall = 1) AS n_all, avg(f1) FILTER (gold_recall < 1) AS f1_missing, count(*) FILTER (gold_recall < 1) AS n_missing "
    "FROM an WHERE reader = 'long' AND hop = 'multi' AND arm NOT LIKE 'oracle%' AND arm <> 'full' AND gold_recall IS NOT NULL AND list_contains(kept, gold[len(gold)]) GROUP BY ALL) SELECT source, ratio, arm, n_all, n_missing, round(f1_all + 3e-11::DOUBLE, 9) AS f1_all_gold, round(f1_missing + 3e-11::DOUBLE, 9) AS f1_gold_missing FROM bg"
)
def bridge_effect(spark, sf_dir) -> DataFrame:
    """F1 of the whole-context reader on multi-hop documents whose answer chunk is kept, where every gold chunk is kept and where one is missing."""
    arms = [a for a in LABELS if not a.startswith("oracle") and a != "full"]
    rows = answers(spark, sf_dir, arms, "hop = 'multi'", tuple(r for r in READERS if r[0] == "long")).where("gold_recall IS NOT NULL")
    rows = rows.where(F.array_contains("kept", F.element_at("gold_chunks", -1)))
    whole = F.col("gold_recall") == 1
    return rows.groupBy("source", "ratio", "arm").agg(
        F.count_if(whole).alias("n_all"), F.count_if(~whole).alias("n_missing"), figure(F.avg(F.when(whole, F.col("f1")))).alias("f1_all_gold"), figure(F.avg(F.when(~whole, F.col("f1")))).alias("f1_gold_missing")
    )


_UPGRADES = [(weak, strong) for weak, _ in READERS for strong, _ in READERS if weak != strong]


def upgrades(rows: DataFrame, arms: tuple[str, ...]) -> DataFrame:
    """source, cluster_id, doc_id, weak, strong, ratio and, for each document under each two readers, w and s (F1 of each arm, in order), wf and sf (in the full context). Documents lacking one of them are left out."""
    own = F.map_from_entries(F.collect_list(F.struct(F.struct("reader", "arm", "ratio"), "f1")))
    each = rows.where(F.col("arm").isin("full", *arms)).groupBy("source", "cluster_id", "doc_id").agg(own.alias("m"))
    get = lambda reader, arm, ratio: F.try_element_at("m", F.struct(F.lit(reader).alias("reader"), F.lit(arm).alias("arm"), F.lit(ratio).alias("ratio")))
    listed = F.array(*[
        F.struct(F.lit(weak).alias("weak"), F.lit(strong).alias("strong"), F.lit(str(r)).alias("ratio"), *[get(x, a, str(r)).alias(f"{c}{i}") for i, a in enumerate(arms) for c, x in (("w", weak), ("s", strong))],
                 get(weak, "full", "full").alias("wf"), get(strong, "full", "full").alias("sf"))
        for weak, strong in _UPGRADES for r in RATIOS])
    return each.select("source", "cluster_id", "doc_id", F.inline(listed))


def _upgrades_sql(arms: tuple[str, ...]) -> str:
    pairs_of = ", ".join(f"('{w}', '{s}')" for w, s in _UPGRADES)
    columns = ", ".join(f"{c}{i}.f1 AS {c}{i}" for i in range(len(arms)) for c in ("w", "s"))
    joins = " ".join(f"JOIN an {c}{i} ON {c}{i}.doc_id = wf.doc_id AND {c}{i}.reader = {x} AND {c}{i}.arm = '{a}' AND {c}{i}.ratio = q.ratio" for i, a in enumerate(arms) for c, x in (("w", "u.weak"), ("s", "u.strong")))
    return (
        f"up AS MATERIALIZED (SELECT wf.source, wf.cluster_id, wf.doc_id, u.weak, u.strong, q.ratio, {columns}, wf.f1 AS wf, sf.f1 AS sf FROM (VALUES {pairs_of}) AS u(weak, strong) JOIN an wf ON wf.reader = u.weak AND wf.arm = 'full' "
        f"JOIN an sf ON sf.doc_id = wf.doc_id AND sf.reader = u.strong AND sf.arm = 'full' CROSS JOIN (VALUES {', '.join(f"('{r}')" for r in RATIOS)}) AS q(ratio) {joins})"
    )


UPGRADE = ["source", "weak", "strong", "ratio"]


@query(
    f"WITH {ANSWERS_SQL}, {_upgrades_sql((OURS,))}, {_draws_sql('up', 'source, weak, strong, ratio', ('w0', 's0', 'wf', 'sf'))}, pt AS (SELECT source, weak, strong, ratio, count(*) AS n, avg(w0) AS w0, avg(s0) AS s0, avg(wf) AS wf, avg(sf) AS sf FROM up GROUP BY ALL), "
    "iv AS (SELECT source, weak, strong, ratio, quantile_cont((s0 - w0) / (sf - wf), 0.025) FILTER (abs(sf - wf) >= 1e-9) AS lo, quantile_cont((s0 - w0) / (sf - wf), 0.975) FILTER (abs(sf - wf) >= 1e-9) AS hi FROM bo GROUP BY ALL) "
    f"SELECT source, weak, strong, ratio, round(sf - wf + 3e-11::DOUBLE, 9) AS gap, round((s0 - w0) / (sf - wf) + 3e-11::DOUBLE, 9) AS retention, round(lo + 3e-11::DOUBLE, 9) AS lo, round(hi + 3e-11::DOUBLE, 9) AS hi FROM pt JOIN iv USING (source, weak, strong, ratio) WHERE sf - wf >= {LEAST_GAP}::DOUBLE"
)
def retention_ci(spark, sf_dir) -> DataFrame:
    """The share of each reader upgrade that compression leaves, with a joint bootstrap interval of the ratio of means."""

    def of(means, drawn) -> dict | None:
        gap = means[3] - means[2]
        if gap < LEAST_GAP:
            return None
        lo, hi = st.quantiles(st.retentions(drawn))
        return {"gap": float(gap), "retention": float(st.retentions(means)), "lo": lo, "hi": hi}

    rows = upgrades(answers(spark, sf_dir, ["full", OURS]), (OURS,))
    found = st.bootstrapped(rows, UPGRADE, "cluster_id", ["w0", "s0", "wf", "sf"], "gap double, retention double, lo double, hi double", of, DRAWS)
    return found.select(*UPGRADE, *[figure(c).alias(c) for c in ("gap", "retention", "lo", "hi")])


@query(
    f"WITH {ANSWERS_SQL}, {_upgrades_sql((ENSEMBLE, OURS))}, {_draws_sql('up', 'source, weak, strong, ratio', ('w0', 's0', 'w1', 's1', 'wf', 'sf'))}, pt AS (SELECT source, weak, strong, ratio, avg(w0) AS w0, avg(s0) AS s0, avg(w1) AS w1, avg(s1) AS s1, avg(wf) AS wf, avg(sf) AS sf FROM up GROUP BY ALL), "
    "dv AS (SELECT source, weak, strong, ratio, ((s0 - w0) - (s1 - w1)) / (sf - wf) AS v, round((s0 - w0) / (sf - wf) - (s1 - w1) / (sf - wf), 12) AS d FROM bo WHERE abs(sf - wf) >= 1e-9), "
    "pv AS (SELECT source, weak, strong, ratio, (count(*) FILTER (d <= 0) + 1) / (count(*) + 1) AS p, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM dv GROUP BY ALL), "
    f"tt AS (SELECT CASE WHEN weak = '{HELD_OUT}' OR strong = '{HELD_OUT}' THEN 'H3-heldout' ELSE 'H3' END AS family, source, weak, strong, ratio, (s0 - w0) / (sf - wf) - (s1 - w1) / (sf - wf) AS diff, lo, hi, p FROM pt JOIN pv USING (source, weak, strong, ratio) WHERE sf - wf >= {LEAST_GAP}::DOUBLE), "
    "h AS (SELECT *, max(least(1.0::DOUBLE, (m - r + 1) * p)) OVER (PARTITION BY family ORDER BY r) AS holm FROM (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, source || weak || strong || ratio) AS r FROM tt)) "
    "SELECT family, source, weak, strong, ratio, round(diff + 3e-11::DOUBLE, 9) AS diff, round(lo + 3e-11::DOUBLE, 9) AS lo, round(hi + 3e-11::DOUBLE, 9) AS hi, round(p + 3e-11::DOUBLE, 9) AS p, round(holm + 3e-11::DOUBLE, 9) AS holm FROM h"
)
def retention_family(spark, sf_dir) -> DataFrame:
    """H3: the fused arm retains more of an upgrade than ours, for pairs of label readers and, apart, pairs with the held-out one; one joint bootstrap of six means each."""

    def of(means, drawn) -> dict | None:
        if means[5] - means[4] < LEAST_GAP:
            return None
        diff = lambda m: st.retentions(m[..., [0, 1, 4, 5]]) - st.retentions(m[..., [2, 3, 4, 5]])
        each = np.round(diff(drawn), 12)  # sums in another order leave what is 0 at 0
        lo, hi = st.quantiles(each)
        return {"diff": float(diff(means)), "lo": lo, "hi": hi, "p": st.one_sided(each, "superiority")}

    rows = upgrades(answers(spark, sf_dir, ["full", ENSEMBLE, OURS]), (ENSEMBLE, OURS))
    tests = st.bootstrapped(rows, UPGRADE, "cluster_id", ["w0", "s0", "w1", "s1", "wf", "sf"], "diff double, lo double, hi double, p double", of, DRAWS)
    tests = tests.withColumn("family", F.when((F.col("weak") == HELD_OUT) | (F.col("strong") == HELD_OUT), F.lit("H3-heldout")).otherwise(F.lit("H3"))).withColumn("tie", F.concat(*UPGRADE))
    found = st.adjusted(tests, "p", ["family"], "tie")
    return found.select("family", *UPGRADE, *[figure(c).alias(c) for c in ("diff", "lo", "hi", "p", "holm")])


@query(
    f"WITH {ANSWERS_SQL}, pt0 AS (SELECT reader, source, arm, ratio, avg(full_tokens / greatest(1, kept_tokens)) AS x, avg(f1) AS y FROM an WHERE arm <> 'full' GROUP BY ALL), pt AS (SELECT reader, source, arm, ln(x) AS x, avg(y) AS y FROM pt0 GROUP BY reader, source, arm, pt0.x), "
    "ln1 AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY reader, source, arm) AS n, lead(x) OVER w AS x2, lead(y) OVER w AS y2, min(x) OVER (PARTITION BY reader, source, arm) AS least_x, max(x) OVER (PARTITION BY reader, source, arm) AS most_x FROM pt WINDOW w AS (PARTITION BY reader, source, arm ORDER BY x)), "
    "tg AS (SELECT DISTINCT reader, source, x AS target, ln(x) AS t FROM pt0 WHERE arm = 'sent+bm25'), "
    "mt AS (SELECT l.*, target, t, row_number() OVER (PARTITION BY l.reader, l.source, l.arm, target ORDER BY CASE WHEN l.x <= t THEN 0 ELSE 1 END, CASE WHEN l.x <= t THEN -l.i ELSE l.i END) AS pick FROM ln1 l JOIN tg ON l.reader = tg.reader AND l.source = tg.source WHERE l.i < l.n OR l.n = 1) "
    "SELECT reader, source, arm, round(target + 3e-11::DOUBLE, 9) AS target, round(CASE WHEN n = 1 THEN y ELSE y + (t - x) / (x2 - x) * (y2 - y) END, 7) AS f1, t < least_x - 1e-12 OR t > most_x + 1e-12 AS extrapolated FROM mt WHERE pick = 1"
)
def equal_compression(spark, sf_dir) -> DataFrame:
    """F1 of every arm at the compression that sentence selection realises, interpolated on its logarithm."""
    rows = answers(spark, sf_dir, [a for a in LABELS if a != "full"])
    points = rows.groupBy("reader", "source", "arm", "ratio").agg(F.avg(F.col("full_tokens") / F.greatest(F.lit(1), "kept_tokens")).alias("x"), F.avg("f1").alias("y"))
    found = st.at_equal(points, ["reader", "source"], "arm", "x", "y", "sent+bm25")
    return found.select("reader", "source", "arm", figure("target").alias("target"), F.round("value", 7).alias("f1"), "extrapolated")

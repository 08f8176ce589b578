"""Queries over outcomes: cells, paired differences, bootstrap, families, retention, diagnostics.

Outcomes are keyed by (reader, source, ratio, arm, doc_id); here their F1 derives from hashes of the
key, so that every statistic has the same input in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsieve.functions.hashing import hash_unit
from quillsieve.operators import statistics as st
from quillsieve.plans.frames import HASH, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


READERS = (("weak", 0.1), ("strong", 0.3), ("held", 0.25))
ARMS = (("full", 0.2), ("ours", 0.18), ("rival", 0.1), ("lead", 0.0), ("abl_s1", 0.05), ("abl_s2", 0.06), ("abl_s3", 0.04))
RATIOS = ("4.0", "8.0")


def facts(spark, sf_dir) -> DataFrame:
    """Outcomes of every document under every reader, arm and ratio; the full arm has the one ratio 'full'."""
    cells = [(r, rw, a, aw, x) for r, rw in READERS for a, aw in ARMS for x in (("full",) if a == "full" else RATIOS)]
    made = F.array(*[F.named_struct(F.lit("reader"), F.lit(r), F.lit("arm"), F.lit(a), F.lit("ratio"), F.lit(x), F.lit("base"), F.lit(rw + aw)) for r, rw, a, aw, x in cells])
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.floor(F.col("doc_id") / 20) % 10).alias("cluster"), F.explode(made).alias("c"))
    unit = hash_unit(F.concat_ws(":", "c.reader", "c.arm", "c.ratio", "doc_id"), "f1")
    return docs.select("doc_id", "source", "cluster", "c.reader", "c.arm", "c.ratio", F.round(F.col("c.base") + 0.4 * unit, 6).alias("f1"))


_CELLS = ", ".join(f"('{r}', '{a}', '{x}', {rw + aw!r}::DOUBLE)" for r, rw in READERS for a, aw in ARMS for x in (("full",) if a == "full" else RATIOS))
FACTS = (
    f"f AS MATERIALIZED (SELECT doc_id, source, (doc_id // 20) % 10 AS cluster, reader, arm, ratio, round(base + 0.4::DOUBLE * {HASH.format(salt='f1', key='reader || chr(58) || arm || chr(58) || ratio || chr(58) || doc_id')}, 6) AS f1 "
    f"FROM documents, (VALUES {_CELLS}) AS c(reader, arm, ratio, base))"
)
KEYS = ["reader", "source", "ratio", "arm"]
#: Draws of the registered queries and their SQL: Holm's least p, tests / (draws + 1), stays under 0.05 up to 250 tests.
DRAWS = 5000


@query(f"WITH {FACTS} SELECT reader, source, ratio, arm, count(*) AS n, count(DISTINCT cluster) AS clusters, round(avg(f1), 9) AS f1, round(median(f1), 9) AS median, round(avg((f1 > 0.5)::INT), 9) AS over FROM f GROUP BY ALL")
def cell_report(spark, sf_dir) -> DataFrame:
    over = F.avg((F.col("f1") > 0.5).cast("int"))
    return facts(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"), F.round(F.avg("f1"), 9).alias("f1"), F.round(F.median("f1"), 9).alias("median"), F.round(over, 9).alias("over"))


def paired(spark, sf_dir) -> DataFrame:
    """ours minus each other arm at its ratio, and minus the full context."""
    f = facts(spark, sf_dir)
    ours = f.where("arm = 'ours'").select("reader", "source", "ratio", "doc_id", "cluster", F.col("f1").alias("a"))
    other = f.where("arm <> 'ours'")
    # The full cell stands for every ratio, so the join stays an equality.
    spread = other.withColumn("ratio", F.explode(F.when(F.col("arm") == "full", F.array(*[F.lit(r) for r in RATIOS])).otherwise(F.array("ratio"))))
    joined = ours.join(spread.select("reader", "source", "ratio", "doc_id", "arm", F.col("f1").alias("b")), ["reader", "source", "ratio", "doc_id"])
    return joined.select("reader", "source", "ratio", F.col("arm").alias("vs"), "doc_id", "cluster", (F.col("a") - F.col("b")).alias("d"))


PAIRED = FACTS + ", p AS MATERIALIZED (SELECT a.reader, a.source, a.ratio, b.arm AS vs, a.doc_id, a.cluster, a.f1 - b.f1 AS d FROM f a JOIN f b USING (reader, source, doc_id) WHERE a.arm = 'ours' AND b.arm <> 'ours' AND (b.ratio = a.ratio OR b.ratio = 'full'))"
PKEYS = ["reader", "source", "ratio", "vs"]


@query(f"WITH {PAIRED} SELECT reader, source, ratio, vs, count(*) AS n, round(avg(d), 9) AS diff FROM p GROUP BY ALL")
def paired_diff(spark, sf_dir) -> DataFrame:
    return paired(spark, sf_dir).groupBy(*PKEYS).agg(F.count("*").alias("n"), F.round(F.avg("d"), 9).alias("diff"))


def _boot_sql(rows: str, keys: str, value: str, draws: int = DRAWS) -> str:
    unit = HASH.format(salt="boot", key="b || chr(58) || s")
    return (
        f"cs AS (SELECT {keys}, cluster, count(*) AS size, sum({value}) AS v, (row_number() OVER (PARTITION BY {keys} ORDER BY cluster)) - 1 AS j FROM {rows} GROUP BY {keys}, cluster), "
        f"cells AS (SELECT {keys}, count(*) AS k FROM cs GROUP BY {keys}), "
        f"dr AS MATERIALIZED (SELECT k, b, j, count(*) AS times FROM (SELECT k, b, floor(k * {unit})::BIGINT AS j FROM (SELECT *, unnest(range(0, k)) AS s FROM (SELECT *, unnest(range(0, {draws})) AS b FROM (SELECT DISTINCT k FROM cells)))) GROUP BY ALL), "
        f"bo AS MATERIALIZED (SELECT {keys}, b, sum(v * times) / sum(size * times) AS v FROM cs JOIN cells USING ({keys}) JOIN dr USING (k, j) GROUP BY {keys}, b)"
    )


@query(f"WITH {FACTS}, {_boot_sql('f', 'reader, source, ratio, arm', 'f1')} SELECT reader, source, ratio, arm, round(quantile_cont(v, 0.025), 12) AS lo, round(quantile_cont(v, 0.975), 12) AS hi FROM bo GROUP BY ALL")
def cluster_bootstrap_ci(spark, sf_dir) -> DataFrame:
    ends = lambda means, drawn: dict(zip(("lo", "hi"), st.quantiles(drawn[:, 0]), strict=True))
    found = st.bootstrapped(facts(spark, sf_dir), KEYS, "cluster", ["f1"], "lo double, hi double", ends, DRAWS)
    return found.select(*KEYS, F.round("lo", 12).alias("lo"), F.round("hi", 12).alias("hi"))


@query(
    f"WITH {PAIRED}, {_boot_sql('p', 'reader, source, ratio, vs', 'd')} SELECT reader, source, ratio, vs, round((count(*) FILTER (v <= 0) + 1) / (count(*) + 1), 9) AS superiority, "
    "round((count(*) FILTER (v <= -0.02) + 1) / (count(*) + 1), 9) AS noninferiority, round((greatest(count(*) FILTER (v <= -0.05), count(*) FILTER (v >= 0.05)) + 1) / (count(*) + 1), 9) AS equivalence, "
    "round(least(1.0, 2 * (least(count(*) FILTER (v <= 0), count(*) FILTER (v >= 0)) + 1) / (count(*) + 1)), 9) AS two_sided FROM bo GROUP BY ALL"
)
def directional_tests(spark, sf_dir) -> DataFrame:
    def tests(means, drawn) -> dict:
        d = drawn[:, 0]
        return {"superiority": st.one_sided(d, "superiority"), "noninferiority": st.one_sided(d, "noninferiority", 0.02), "equivalence": st.one_sided(d, "equivalence", 0.05), "two_sided": st.two_sided(d)}

    names = ("superiority", "noninferiority", "equivalence", "two_sided")
    found = st.bootstrapped(paired(spark, sf_dir), PKEYS, "cluster", ["d"], ", ".join(f"{n} double" for n in names), tests, DRAWS)
    return found.select(*PKEYS, *[F.round(n, 9).alias(n) for n in names])


_P = f"CASE WHEN doc_id % 11 = 3 THEN NULL ELSE round({HASH.format(salt='p', key='doc_id')} * 0.2, 9) END"


@query(f"""WITH t AS (SELECT source AS family, doc_id, {_P} AS p FROM documents),
k AS (SELECT *, count(p) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, doc_id) AS r FROM t WHERE p IS NOT NULL),
a AS (SELECT family, doc_id, p, max(least(1.0, (m - r + 1) * p)) OVER (PARTITION BY family ORDER BY r) AS holm, min(least(1.0, p * m / r)) OVER (PARTITION BY family ORDER BY r DESC) AS bh FROM k)
SELECT t.family, t.doc_id, t.p, round(holm, 9) AS holm, round(bh, 9) AS bh FROM t LEFT JOIN a USING (family, doc_id)""")
def holm_bh(spark, sf_dir) -> DataFrame:
    p = F.when(F.col("doc_id") % 11 != 3, F.round(hash_unit(F.col("doc_id"), "p") * 0.2, 9))
    tests = table(spark, sf_dir, "documents").select(F.col("source").alias("family"), "doc_id", p.alias("p"))
    return st.adjusted(tests, "p", ["family"], "doc_id").select("family", "doc_id", "p", F.round("holm", 9).alias("holm"), F.round("bh", 9).alias("bh"))


@query(f"""WITH {FACTS}, m AS (SELECT source, arm, ratio, avg(f1) FILTER (reader = 'weak') AS w, avg(f1) FILTER (reader = 'strong') AS s FROM f GROUP BY ALL)
SELECT a.source, a.arm, a.ratio, round((a.s - a.w) / (b.s - b.w), 6) AS retention FROM m a JOIN m b ON a.source = b.source AND b.arm = 'full' WHERE a.arm <> 'full'""")
def upgrade_retention(spark, sf_dir) -> DataFrame:
    """Conditional means instead of a join for each reader."""
    of = lambda r: F.avg(F.when(F.col("reader") == r, F.col("f1")))
    means = facts(spark, sf_dir).groupBy("source", "arm", "ratio").agg(of("weak").alias("w"), of("strong").alias("s"))
    full = means.where("arm = 'full'").select("source", F.col("w").alias("wf"), F.col("s").alias("sf"))
    share = st.retention(F.col("w"), F.col("s"), F.col("wf"), F.col("sf"))
    return means.where("arm <> 'full'").join(full, "source").select("source", "arm", "ratio", F.round(share, 6).alias("retention"))


@query(f"""WITH {FACTS}, m AS (SELECT source, ratio, avg(f1) FILTER (reader = 'strong' AND arm = 'ours') - avg(f1) FILTER (reader = 'weak' AND arm = 'ours') AS a, avg(f1) FILTER (reader = 'strong' AND arm = 'rival') - avg(f1) FILTER (reader = 'weak' AND arm = 'rival') AS b FROM f WHERE ratio <> 'full' GROUP BY ALL),
g AS (SELECT source, avg(f1) FILTER (reader = 'strong') - avg(f1) FILTER (reader = 'weak') AS gap FROM f WHERE arm = 'full' GROUP BY 1)
SELECT source, ratio, round((a - b) / gap, 6) AS diff FROM m JOIN g USING (source)""")
def retention_diff(spark, sf_dir) -> DataFrame:
    f = facts(spark, sf_dir)
    of = lambda r, a: F.avg(F.when((F.col("reader") == r) & (F.col("arm") == a), F.col("f1")))
    cells = f.where("ratio <> 'full'").groupBy("source", "ratio").agg(*[of(r, a).alias(f"{r}_{a}") for r in ("weak", "strong") for a in ("ours", "rival")])
    gaps = f.where("arm = 'full'").groupBy("source").agg(of("strong", "full").alias("sf"), of("weak", "full").alias("wf"))
    both = cells.join(gaps, "source")
    ours = st.retention(F.col("weak_ours"), F.col("strong_ours"), F.col("wf"), F.col("sf"))
    rival = st.retention(F.col("weak_rival"), F.col("strong_rival"), F.col("wf"), F.col("sf"))
    return both.select("source", "ratio", F.round(ours - rival, 6).alias("diff"))


@query(f"WITH {FACTS} SELECT reader, arm, ratio, least(4, floor(pos * 5))::INT AS quintile, count(*) AS n, round(avg(f1), 9) AS f1 FROM (SELECT *, {HASH.format(salt='pos', key='doc_id')} AS pos FROM f) GROUP BY ALL")
def depth_quintiles(spark, sf_dir) -> DataFrame:
    place = F.least(F.lit(4), F.floor(hash_unit(F.col("doc_id"), "pos") * 5)).cast("int")
    return facts(spark, sf_dir).withColumn("quintile", place).groupBy("reader", "arm", "ratio", "quintile").agg(F.count("*").alias("n"), F.round(F.avg("f1"), 9).alias("f1"))


@query(f"WITH {FACTS}, m AS (SELECT reader, source, ratio, regexp_extract(arm, '^(.*)_s([0-9]+)$', 1) AS base, arm, avg(f1) AS f1 FROM f WHERE regexp_matches(arm, '_s[0-9]+$') GROUP BY ALL) SELECT reader, source, ratio, base, count(*) AS seeds, round(avg(f1), 9) AS mean, round(stddev_samp(f1), 9) AS sd FROM m GROUP BY ALL HAVING count(*) >= 2")
def seed_table(spark, sf_dir) -> DataFrame:
    seeded = facts(spark, sf_dir).where(F.col("arm").rlike(r"_s[0-9]+$")).withColumn("base", F.regexp_extract("arm", r"^(.*)_s([0-9]+)$", 1))
    means = seeded.groupBy("reader", "source", "ratio", "base", "arm").agg(F.avg("f1").alias("f1"))
    out = means.groupBy("reader", "source", "ratio", "base").agg(F.count("*").alias("seeds"), F.round(F.avg("f1"), 9).alias("mean"), F.round(F.stddev_samp("f1"), 9).alias("sd"))
    return out.where("seeds >= 2")


@query(f"""WITH {PAIRED}, m AS (SELECT reader, source, ratio, vs, avg(d) AS d FROM p WHERE vs LIKE 'abl%' GROUP BY ALL) SELECT reader, source, ratio, bool_and(d > 0) AS agreed, count(*) AS seeds FROM m GROUP BY ALL""")
def seed_agreement(spark, sf_dir) -> DataFrame:
    means = paired(spark, sf_dir).where("vs LIKE 'abl%'").groupBy(*PKEYS).agg(F.avg("d").alias("d"))
    return means.groupBy("reader", "source", "ratio").agg(F.bool_and(F.col("d") > 0).alias("agreed"), F.count("*").alias("seeds"))


@query(
    f"""WITH {PAIRED}, {_boot_sql('p', 'reader, source, ratio, vs', 'd')},
t AS (SELECT CASE WHEN vs = 'full' THEN 'H1-oracle' ELSE 'H1' END AS family, reader, source, ratio, vs, (count(*) FILTER (v <= CASE WHEN vs = 'full' THEN -0.05 ELSE 0 END) + 1) / (count(*) + 1) AS p FROM bo WHERE vs NOT LIKE 'abl%' GROUP BY ALL),
h AS (SELECT *, max(least(1.0, (m - r + 1) * p)) OVER (PARTITION BY family ORDER BY r) AS holm FROM (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, reader || source || ratio || vs) AS r FROM t))
SELECT family, count(*) AS n_tests, count(*) FILTER (holm <= 0.05) AS n_supported FROM h GROUP BY 1"""
)
def family_rollup(spark, sf_dir) -> DataFrame:
    """Pre-registered families: superiority over other arms, noninferiority to the full context; Holm inside each."""
    both = lambda means, drawn: {"over": st.one_sided(drawn[:, 0], "superiority"), "near": st.one_sided(drawn[:, 0], "noninferiority", 0.05)}
    found = st.bootstrapped(paired(spark, sf_dir).where("vs NOT LIKE 'abl%'"), PKEYS, "cluster", ["d"], "over double, near double", both, DRAWS)
    tests = found.select(*PKEYS, F.when(F.col("vs") == "full", F.col("near")).otherwise(F.col("over")).alias("p"))
    tests = tests.withColumn("family", F.when(F.col("vs") == "full", F.lit("H1-oracle")).otherwise(F.lit("H1"))).withColumn("tie", F.concat("reader", "source", "ratio", "vs"))
    return st.adjusted(tests, "p", ["family"], "tie").groupBy("family").agg(F.count("*").alias("n_tests"), F.count_if(F.col("holm") <= 0.05).alias("n_supported"))


@query(f"""WITH {PAIRED}, s AS (SELECT reader, source, ratio, vs, cluster, sum(d) AS s, count(*) AS m FROM p GROUP BY ALL), t AS (SELECT reader, source, ratio, vs, count(*) AS g, sum(s) / sum(m) AS mean, sum(m) AS n FROM s GROUP BY ALL)
SELECT t.reader, t.source, t.ratio, t.vs, round(any_value(mean), 9) AS mean, round(sqrt(any_value(g) / (any_value(g) - 1) * sum(pow(s.s - s.m * mean, 2))) / any_value(n), 9) AS se FROM t JOIN s USING (reader, source, ratio, vs) WHERE g > 1 GROUP BY ALL""")
def cr1_se(spark, sf_dir) -> DataFrame:
    out = st.cr1(paired(spark, sf_dir), PKEYS, "cluster", "d").where("se IS NOT NULL")
    return out.select(*PKEYS, F.round("mean", 9).alias("mean"), F.round("se", 9).alias("se"))


@query(f"""WITH {PAIRED}, s AS (SELECT reader, source, ratio, vs, cluster, sum(d) AS s FROM p GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY reader, source, ratio, vs ORDER BY cluster) - 1 AS j FROM s), k AS (SELECT reader, source, ratio, vs, count(*) AS k, sum(s) AS t FROM n GROUP BY ALL),
x AS (SELECT reader, source, ratio, vs, t, unnest(range(0, 1::BIGINT << k::INT)) AS x FROM k),
v AS (SELECT reader, source, ratio, vs, x.x, any_value(t) AS t, sum(CASE WHEN (x.x >> j::INT) & 1 = 1 THEN -s ELSE s END) AS f FROM x JOIN n USING (reader, source, ratio, vs) GROUP BY ALL)
SELECT reader, source, ratio, vs, round(avg((abs(f) >= abs(t) - 1e-12)::INT), 9) AS p FROM v GROUP BY ALL""")
def sign_flip(spark, sf_dir) -> DataFrame:
    """The exact sign-flip test of every comparison: every choice of signs of its clusters."""
    rows = paired(spark, sf_dir)
    flips = st.sign_flips(rows, PKEYS, "cluster", "d")
    seen = rows.groupBy(*PKEYS).agg(F.sum("d").alias("t"))
    return flips.join(seen, PKEYS).groupBy(*PKEYS).agg(F.round(F.avg((F.abs("flipped") >= F.abs("t") - 1e-12).cast("int")), 9).alias("p"))


@query(f"WITH {FACTS} SELECT source, arm, ratio, weak, strong FROM (SELECT a.source, a.arm, a.ratio, a.reader AS weak, b.reader AS strong FROM (SELECT reader, source, arm, ratio, avg(f1) AS m FROM f GROUP BY ALL) a JOIN (SELECT reader, source, arm, ratio, avg(f1) AS m FROM f GROUP BY ALL) b USING (source, arm, ratio) WHERE a.m < b.m AND arm = 'full')")
def reader_pairs(spark, sf_dir) -> DataFrame:
    means = facts(spark, sf_dir).where("arm = 'full'").groupBy("reader", "source", "arm", "ratio").agg(F.avg("f1").alias("m"))
    weak, strong = means.withColumnRenamed("reader", "weak").withColumnRenamed("m", "mw"), means.withColumnRenamed("reader", "strong").withColumnRenamed("m", "ms")
    return weak.join(strong, ["source", "arm", "ratio"]).where("mw < ms").select("source", "arm", "ratio", "weak", "strong")


@query(f"WITH {FACTS} SELECT reader, doc_id, arm, ratio FROM f EXCEPT SELECT reader, doc_id, arm, ratio FROM f WHERE doc_id IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir) -> DataFrame:
    """What remains of planned work once finished keys are taken out: the outcomes of labelled documents are finished."""
    planned = facts(spark, sf_dir).select("reader", "doc_id", "arm", "ratio")
    finished = planned.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return planned.join(finished, ["reader", "doc_id", "arm", "ratio"], "left_anti").distinct()


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_row_wins(spark, sf_dir) -> DataFrame:
    """Of rows with one key the last stays."""
    last = Window.partitionBy("user_id", "event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, sf_dir, "events").withColumn("r", F.row_number().over(last)).where("r = 1").select("user_id", "event_type", "event_id", "value")


_RUN = "(SELECT source, count(*) AS n, avg(n_chars) AS m FROM documents WHERE doc_id {} (SELECT doc_id FROM labels) GROUP BY 1)"


@query(f"SELECT coalesce(a.source, b.source) AS source, a.n AS n_first, b.n AS n_second, round(coalesce(b.m, 0) - coalesce(a.m, 0), 6) AS change FROM {_RUN.format('IN')} a FULL JOIN {_RUN.format('NOT IN')} b ON a.source IS NOT DISTINCT FROM b.source")
def compare_runs(spark, sf_dir) -> DataFrame:
    """Labelled documents as the first run, all others as the second."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    done = table(spark, sf_dir, "labels").select("doc_id")
    run = lambda how, n, m: docs.join(done, "doc_id", how).groupBy("source").agg(F.count("*").alias(n), F.avg("n_chars").alias(m))
    first, second = run("left_semi", "n_first", "a"), run("left_anti", "n_second", "b").withColumnRenamed("source", "other")
    both = first.join(second, F.col("source").eqNullSafe(F.col("other")), "full")
    return both.select(F.coalesce("source", "other").alias("source"), "n_first", "n_second", F.round(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)), 6).alias("change"))


@query("SELECT source, lang, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, round(avg(n_chars), 6) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def label_agreement(spark, sf_dir) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("source", "lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"), F.round(F.avg("n_chars"), 6).alias("chars"))


@query(f"WITH {FACTS} SELECT reader, arm, count(DISTINCT doc_id) AS docs, round(sum(f1 * 10) / 3600, 9) AS total_hours, round(avg(f1 * 1000), 9) AS mean_ms, round(avg(65), 9) AS calls FROM f WHERE ratio <> 'full' GROUP BY ALL")
def cost_table(spark, sf_dir) -> DataFrame:
    f = facts(spark, sf_dir).where("ratio <> 'full'")
    return f.groupBy("reader", "arm").agg(F.count_distinct("doc_id").alias("docs"), F.round(F.sum(F.col("f1") * 10) / 3600, 9).alias("total_hours"), F.round(F.avg(F.col("f1") * 1000), 9).alias("mean_ms"), F.round(F.avg(F.lit(65)), 9).alias("calls"))

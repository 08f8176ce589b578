"""Reports: pre-registered families, and small frames as Markdown, LaTeX and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.operators import statistics as st

FAMILIES = (
    "families array<struct<name: string, claim: string, reader: string, ours: string, vs: array<string>, kind: string, margin: double, alpha: double, sources: array<string>, ratios: array<double>>>"
)


def read_families(spark: SparkSession, path: str) -> DataFrame:
    """The tests that a pre-registration file names: one row for each family, source, ratio and opponent."""
    one = spark.read.schema(FAMILIES).option("multiLine", True).json(path).select(F.explode("families").alias("f")).select("f.*")
    rows = one.withColumn("vs", F.explode("vs")).withColumn("source", F.explode("sources")).withColumn("ratio", F.explode(F.transform("ratios", lambda r: r.cast("string"))))
    return rows.select(F.col("name").alias("family"), "claim", "reader", "ours", "vs", "kind", F.coalesce("margin", F.lit(0.0)).alias("margin"), F.coalesce("alpha", F.lit(0.05)).alias("alpha"), "source", "ratio")


def family_tests(answers: DataFrame, tests: DataFrame, draws: int = 1000) -> DataFrame:
    """tests with n, diff, p, holm and supported, from answers(reader, source, ratio, arm, doc_id, cluster, f1).

    The opponent's cell at the same ratio counts, or its one of ratio 'full'. Tests without a pair of
    cells keep NULL and take no part in Holm's adjustment, which is within each family.
    """
    keys = ["family", "reader", "source", "ratio", "ours", "vs"]
    ours = answers.select("reader", "source", "ratio", F.col("arm").alias("ours"), "doc_id", "cluster", F.col("f1").alias("a"))
    other = answers.select("reader", "source", F.col("ratio").alias("r2"), F.col("arm").alias("vs"), "doc_id", F.col("f1").alias("b"))
    pairs = F.broadcast(tests).join(ours, ["reader", "source", "ratio", "ours"]).join(other, ["reader", "source", "vs", "doc_id"])
    pairs = pairs.where((F.col("r2") == F.col("ratio")) | (F.col("r2") == "full")).withColumn("d", F.col("a") - F.col("b"))
    means = pairs.groupBy(*keys).agg(F.count("d").alias("n"), F.avg("d").alias("diff"))
    boot = st.bootstrap(pairs, keys, "cluster", ["d"], draws).join(F.broadcast(tests.select(*keys, "kind", "margin")), keys)
    d, m, n = F.col("d"), F.col("margin"), F.count("*") + 1
    below, above = F.count_if(d <= F.when(F.col("kind") == "superiority", F.lit(0.0)).otherwise(-m)), F.count_if((F.col("kind") == "equivalence") & (d >= m))
    p = boot.groupBy(*keys).agg(((F.greatest(below, above) + 1) / n).alias("p"))
    done = tests.join(means, keys, "left").join(p, keys, "left").withColumn("_tie", F.concat_ws("|", *keys))
    adjusted = st.adjusted(done.withColumn("p", F.when(F.col("n") >= 2, F.col("p"))), "p", ["family"], "_tie")
    return adjusted.withColumn("supported", F.col("holm") <= F.col("alpha")).drop("_tie", "bh")


def roll_up(results: DataFrame) -> DataFrame:
    return results.groupBy("family").agg(F.count("*").alias("registered"), F.count("p").alias("run"), F.count_if("supported").alias("supported"))


def outside(arms: list[str], tests: DataFrame) -> list[str]:
    """Arms that no family names."""
    named = {r[0] for c in ("ours", "vs") for r in tests.select(c).distinct().collect()}
    return sorted(set(arms) - named)


def _cell(value) -> str:
    return "–" if value is None or value != value else f"{value:.3f}" if isinstance(value, float) else str(value)


def _all(rows: DataFrame, limit: int) -> list:
    """The rows of a small frame; a larger one is an error, never cut."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    return found


def markdown(rows: DataFrame, limit: int = 2000) -> str:
    """A small frame as a Markdown table; bars in cells are escaped."""
    found = _all(rows, limit)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(_cell(v).replace("|", "\\|") for v in r) + " |" for r in found])


#: Characters that LaTeX gives a meaning to.
_TEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def tex(text: str) -> str:
    return "".join(_TEX.get(c, c) for c in text)


def pivot(cells: DataFrame, rows: str, columns: str, value: str, names: list[str] | None = None) -> DataFrame:
    """One line for each value of `rows`, one column for each of `columns`."""
    return cells.groupBy(rows).pivot(columns, names).agg(F.round(F.first(value), 3)).orderBy(rows)


def latex(frame: DataFrame, limit: int = 2000) -> str:
    head = " & ".join(tex(c) for c in frame.columns) + r" \\"
    body = [" & ".join(tex(_cell(v)) for v in r) + r" \\" for r in _all(frame, limit)]
    return "\n".join([r"\begin{tabular}{l" + "r" * (len(frame.columns) - 1) + "}", head, r"\hline", *body, r"\end{tabular}"])

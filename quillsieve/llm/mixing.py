"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsieve.llm.base import checked_broadcast, free_name, stored, table, word_count

#: Weights of the sources in code-point order, null last, over and over.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix holds.
SHARE = 1.5
#: Times that a source may be repeated.
REPEATS = 2
#: Rows of a source that share a slice of the shuffled order, on average.
SLICE_ROWS = 4096
#: Bins of virtual time.
BINS = 4096


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) from per-source sums (source, source_size): a row for each source.

    Targets share `share` of all words by weight and stop at `repeats` times the source; what is
    above goes to the others by weight until none is above. The level where that ends follows from
    sources ordered by the level at which each is full, so it needs no rounds. A null source is
    ordered last; empty sources get 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    every = full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    turn = (F.row_number().over(order) - 1) % len(weights)
    ranked = (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * float(repeats))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
    )
    # The level if all sources that fill earlier are full; a source is full if it fills at or below that.
    levelled = (
        ranked.withColumn("budget", F.sum("source_size").over(every) * float(share))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("is_full", F.col("full_at") <= F.col("level"))
    )
    # Past the first source that isn't full these levels only fall, so the largest is the final one.
    final = F.max(F.when(~F.col("is_full"), F.col("level"))).over(every)
    return (
        levelled.withColumn("final", final)
        .withColumn("target", F.when(F.col("is_full"), F.col("cap")).otherwise(F.col("weight") * F.col("final")))
        .select("source", "source_size", "target")
    )


def _threshold(times: DataFrame, budget: float) -> float:
    """The latest finish time up to which the sizes of times(v, size) sum to the budget or less.

    Narrows the range of v by BINS a round with sums per bin, so no task sees more than the last bin.
    """
    lo, hi, left = 0.0, float(REPEATS) + 1.0, float(budget)
    rows = times
    for _ in range(5):
        width = (hi - lo) / BINS
        bins = rows.groupBy(F.least(F.floor((F.col("v") - lo) / width), F.lit(BINS - 1)).alias("bin")).agg(
            F.sum("size").alias("size"), F.count("*").alias("n")
        )
        order = Window.orderBy("bin")
        ahead = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = bins.withColumn("ahead", ahead).where(F.col("ahead") + F.col("size") > left).orderBy("bin").first()
        if at is None:
            return hi
        left -= at["ahead"]
        lo, hi = lo + at["bin"] * width, lo + (at["bin"] + 1) * width
        rows = rows.where((F.col("v") >= lo) & (F.col("v") < hi))
        if at["n"] <= BINS:
            break
    order = Window.orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    kept = rows.withColumn("upto", F.sum("size").over(order)).where(F.col("upto") <= left).agg(F.max("v")).first()[0]
    return lo - (hi - lo) * 1e-9 if kept is None else kept


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of each row of docs, its source and a digest of its text (_text).

    Documents of a source are shuffled by a digest of doc_id. Each copy gets a virtual finish time,
    the words of its source up to and including it divided by the source's target, and the mix takes
    copies in order of that time until the budget is reached: so each source comes near its target
    and no document is taken more than `repeats` times. Running sums go over slices of the shuffled
    order, so a source with most rows is never in one task.

    Null or empty texts have size 0 and are never taken; rows with equal doc_id are ordered by a
    digest of their text; an empty table gives no rows; other columns are ignored.
    """
    number = docs.count()
    digits = max(2, 1 + math.ceil(math.log(max(1.0, number / 65536), 16)))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = stored(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("_size"), key.alias("_key"), F.md5(F.coalesce("text", F.lit(""))).alias("_text")
        )
    )
    per_source = sized.groupBy("source").agg(F.sum("_size").alias("source_size"))
    targets = source_targets(per_source, weights, share, repeats)
    slot = F.substring("_key", 1, digits)
    rows = sized.select("*", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_from"), slot.alias("_slot"))
    slots = rows.groupBy("_from", "_slot").agg(F.sum("_size").alias("_in_slot"))
    upto = Window.partitionBy("_from").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slots.select("_from", "_slot", F.coalesce(F.sum("_in_slot").over(upto), F.lit(0)).alias("_offset"))
    named = targets.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_from"), "source_size", "target")
    offsets = stored(offsets.join(named, "_from"))
    inside = Window.partitionBy("_from", "_slot").orderBy("_key", "_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.withColumn("_sum", F.sum("_size").over(inside))
    timed = stored(
        running.join(checked_broadcast(offsets), ["_from", "_slot"]).select(
            "doc_id", "source", "_key", "_text", "_size", "source_size", "target", (F.col("_offset") + F.col("_sum")).alias("_upto")
        )
    )
    total = timed.agg(F.sum("_size")).first()[0] or 0
    finish = F.array(*[((F.col("source_size") * float(c) + F.col("_upto")) / F.col("target")) for c in range(repeats)])
    times = timed.where("_size > 0").select(F.explode(finish).alias("v"), F.col("_size").alias("size"))
    last = _threshold(times, share * total) if total else 0.0
    copies = sum((F.when(((F.col("source_size") * float(c) + F.col("_upto")) / F.col("target")) <= last, F.lit(1)).otherwise(F.lit(0)) for c in range(repeats)), F.lit(0))
    return timed.select(
        "doc_id",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        F.when(F.col("_size") > 0, F.col("_size") * copies).otherwise(F.lit(0)).cast("long").alias("taken"),
        "source",
        "_text",
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, with size, source_size, target and taken added.

    Rows are told apart by doc_id and text; of equal rows each is joined with the largest taken. All
    columns of docs stay as they are; where one has the name of an added one, that gets an underscore more.
    """
    added = {c: free_name(docs, c) for c in ("size", "source_size", "target", "taken")}
    name = free_name(docs, "_row")
    found = mix(docs).where("taken > 0").withColumn("_of", F.xxhash64("doc_id", "_text")).groupBy("_of")
    found = stored(found.agg(*[F.max(c).alias(f"_{c}") for c in added]).select(F.col("_of").alias(name), *[F.col(f"_{c}").alias(f"{c}{name}") for c in added]))
    rows = docs.withColumn(name, F.xxhash64("doc_id", F.md5(F.coalesce("text", F.lit("")))))
    return rows.join(checked_broadcast(found), name).select(*docs.columns, *[F.col(f"{c}{name}").alias(as_) for c, as_ in added.items()])


#: The same mix in SQL, written plainly: one running sum for each source, one over all finish times.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS k, md5(coalesce(text, '')) AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
           - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
g AS (
  SELECT source, source_size, CASE WHEN cap / w <= level THEN cap
    ELSE w * (max(CASE WHEN cap / w > level THEN level END) OVER ()) END AS target
  FROM l),
r AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.t ROWS UNBOUNDED PRECEDING)::DOUBLE AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
v AS (
  SELECT c.c, r.size, (r.source_size::DOUBLE * c.c + upto) / target AS v FROM r, (VALUES (0), (1)) AS c(c) WHERE r.size > 0),
x AS (
  SELECT max(v) AS last FROM (SELECT v, sum(size) OVER (ORDER BY v RANGE UNBOUNDED PRECEDING) AS upto FROM v)
  WHERE upto <= 1.5 * (SELECT sum(size) FROM d))
SELECT doc_id, size, source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE size * ((upto / target <= last)::INT + ((source_size + upto) / target <= last)::INT) END)::BIGINT AS taken
FROM r, x
"""


def op10(spark, sf_dir) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken."""
    return mix(table(spark, sf_dir, "documents")).drop("source", "_text")

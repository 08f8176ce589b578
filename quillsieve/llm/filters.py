"""Audit of how quality filters interact: what each removes, alone and after others, in every order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsieve.llm import scan
from quillsieve.llm.base import table

#: The filters, in the order of their bits: few words, repeated words, capitals, symbols, copy of an earlier text.
FILTERS = "ABCDE"
#: Fewest words; least percentage of different words; largest percentage of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS = b"#$%&*|"
ORDERS = ["".join(p) for p in permutations(FILTERS)]

_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
#: Bytes that begin a code point.
_POINT = np.ones(256, dtype=bool)
_POINT[0x80:0xC0] = False


def failures(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each text a number with bits 0 to 3 set if it fails filter A to D; data and ends as from scan.slices()."""
    starts, lengths = scan.word_spans(data, ends)
    owner = np.searchsorted(ends, starts, side="right") - 1
    texts = len(ends) - 1
    words = np.bincount(owner, minlength=texts)
    distinct = scan.distinct_words(data, scan.eights(data), starts, lengths, owner, texts)
    capitals, symbols, points = (scan.sums(kind[data], ends) for kind in (_CAPITAL, _SYMBOL, _POINT))
    fails = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, symbols > 0)
    return sum(x.astype(np.int64) << k for k, x in enumerate(fails))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails, high, low) of each row of docs: its language, the filters A to D that it fails, and a 128-bit digest of its text."""
    kind = dict(docs.dtypes)["doc_id"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, ends in scan.slices(batch.column("text")):
                digests = b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:], strict=True))
                marks = np.frombuffer(digests, "<i8").reshape(-1, 2)
                rows = batch.slice(first, last - first)
                columns = [rows.column("doc_id"), rows.column("part"), pa.array(failures(data, ends), pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "fails", "high", "low"])

    given = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInArrow(look, f"doc_id {kind}, part string, fails long, high long, low long")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): rows of docs by language and set of failed filters, and how many of these are labelled.

    Filter E fails rows whose text a smaller doc_id has. Copies are counted by doc_id first, then by
    text, language and label, so a text that most rows share is a few sums before its rows meet.
    """
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = scanned(docs).join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    same = ["high", "low", "part", "fails", "good", "toxic"]
    each = rows.groupBy("doc_id", *same).agg(F.count("*").alias("n"))
    texts = each.groupBy(*same).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless")
    )
    first = F.when(F.col("least") == F.min("least").over(Window.partitionBy("high", "low")), F.col("at_least")).otherwise(0) + F.col("nameless")
    split = texts.withColumn("first", first).select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("fails"), F.col("first").alias("n")), F.struct(F.col("fails").bitwiseOR(F.lit(16)).alias("fails"), (F.col("n") - F.col("first")).alias("n")))).alias("x"))
    return split.groupBy("part", F.col("x.fails").alias("fails")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic")
    )


def _masks() -> dict[str, np.ndarray]:
    """For each order and step, and each set of failed filters, whether its rows are kept, removed, redundant or failed by this filter alone."""
    sets = np.arange(1 << len(FILTERS))
    out = {k: [] for k in ("kept", "removed", "redundant", "unique_fails")}
    for order in ORDERS:
        gone = np.zeros(len(sets), dtype=bool)
        for letter in order:
            bit = 1 << FILTERS.index(letter)
            fails = (sets & bit) > 0
            out["removed"].append(fails & ~gone)
            out["redundant"].append(fails & gone)
            out["unique_fails"].append(sets == bit)
            gone = gone | fails
            out["kept"].append(~gone)
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does in every order: 600 rows for each language of docs(doc_id, text, lang).

    part, filter_order, step and counts of rows: kept after the step, removed in it, redundant
    (failing its filter, removed earlier), unique_fails (failing its filter only), good_lost and
    toxic_lost (removed rows labelled so), shapley (the filter's removed, over all orders).

    Null texts are empty and null languages are the part ''. A row without doc_id is no copy, and
    its text makes no other row one; rows that repeat a doc_id and its text are each counted, and
    neither is a copy of the other. Of several labels of a doc_id any that says so counts. Very long
    texts are scanned whole. Other columns are ignored; an empty table gives no rows.
    """
    found = combinations(docs, labels)
    lists = [F.array(*[F.sum(F.when(F.col("fails") == k, F.col(c)).otherwise(0)) for k in range(1 << len(FILTERS))]).alias(c) for c in ("n", "good", "toxic")]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _masks()
        orders, steps = np.repeat(ORDERS, len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS))
        letters = np.array([FILTERS.index(order[step - 1]) for order, step in zip(orders, steps, strict=True)])
        for batch in batches:
            for row in batch.to_pylist():
                n, good, toxic = (np.array(row[c], dtype=np.int64) for c in ("n", "good", "toxic"))
                count = {k: m @ n for k, m in masks.items()} | {"good_lost": masks["removed"] @ good, "toxic_lost": masks["removed"] @ toxic}
                count["shapley"] = np.bincount(letters, weights=count["removed"]).astype(np.int64)[letters]
                columns = [pa.array([row["part"]] * len(orders)), pa.array(orders), pa.array(steps, pa.int32()), *[pa.array(count[k], pa.int64()) for k in names]]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *names])

    counts = ", ".join(f"{k} long" for k in names)
    return found.groupBy("part").agg(*lists).mapInArrow(reduce, f"part string, filter_order string, step int, {counts}")


#: The same counts in SQL, each from the rows themselves.
SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
least AS (SELECT coalesce(text, '') AS text, min(doc_id) AS first FROM documents GROUP BY 1),
f AS (
  SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    map(['A', 'B', 'C', 'D', 'E'], [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
      100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 10 * length(w.text), regexp_matches(w.text, '[#$%&*|]'), coalesce(w.doc_id > first, false)]) AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id JOIN least ON w.text = least.text),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o),
t AS (SELECT *, filter_order[step] AS letter, string_split(filter_order[1 : step - 1], '') AS earlier FROM s),
p AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails[letter] AS failed,
    list_bool_or([fails[e] FOR e IN earlier IF e <> '']) AS gone,
    len([v FOR v IN map_values(fails) IF v]) AS failures
  FROM c, t),
q AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT failed AND NOT coalesce(gone, false) THEN n ELSE 0 END) AS kept, sum(CASE WHEN failed AND NOT coalesce(gone, false) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed AND failures = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed AND NOT coalesce(gone, false) THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN failed AND NOT coalesce(gone, false) THEN toxic ELSE 0 END) AS toxic_lost
  FROM p GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM q
"""


def op13(spark, sf_dir) -> DataFrame:
    """The audit of all documents."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

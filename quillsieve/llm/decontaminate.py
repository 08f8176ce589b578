"""Benchmark decontamination by spaced seeds: hashes of word patterns that skip fixed places."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.base import checked_broadcast, free_name, row_hash, stored, table

#: Fixed masks: words at 1 are hashed, words at 0 may differ. Any two substitutions in 13 words, all that the share
#: allows, leave one mask whole somewhere; most sets of three do as well. Items of fewer words have masks by length.
MASKS = ("1101011", "110010101", "1110011")
#: Words of a window, and the share of them that must agree place by place.
WINDOW, SIMILARITY = 13, 0.8
#: Words of benchmark items that may be broadcast, of about ten bytes each.
BROADCAST_WORDS = 4_000_000

_WORDS = r"filter(split(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), x -> x <> '')"


def _words() -> Column:
    return F.expr(_WORDS)


def short_masks(n: int, similarity: float = SIMILARITY) -> list[tuple[int, str]]:
    """(place, mask) for an item of n words that is compared whole: however the substitutions fall that the share allows, one mask stays whole.

    The words form two groups more than there may be substitutions; each mask leaves out as many groups
    as there may be substitutions. An item that allows none has one mask of all its words.
    """
    gone = n - math.ceil(n * similarity)
    groups = min(gone + 2, n)
    out = set()
    for left in itertools.combinations(range(groups), gone):
        bits = "".join("0" if k * groups // n in left else "1" for k in range(n))
        out.add((bits.index("1"), bits.strip("0")))
    return sorted(out)


def _hash(mask: str, at: str) -> str:
    return f"xxhash64('{mask}', " + ", ".join(f"get(w, {at} + {k})" for k, c in enumerate(mask) if c == "1") + ")"


def _hashed_words(rows: DataFrame, id_column: str) -> DataFrame:
    # The words pass through a generator of one row, or they would be split again at each place.
    return rows.selectExpr(f"{id_column} AS id", f"inline(array(named_struct('w', transform({_WORDS}, x -> xxhash64(x)))))")


def _at_each_place(rows: DataFrame, masks: Iterable[str]) -> DataFrame:
    masks = sorted(set(masks))
    hashed = [f"if(pos + {len(m)} <= size(w), {_hash(m, 'pos')}, null)" for m in masks]
    least = min(map(len, masks))
    return (
        rows.selectExpr("id", "w", f"explode(if(size(w) < {least}, cast(array() AS array<int>), sequence(0, size(w) - {least}))) AS pos")
        .selectExpr("id", "pos", f"explode(array({', '.join(hashed)})) AS h")
        .where("h IS NOT NULL")
    )


def seeds(rows: DataFrame, id_column: str, masks: Iterable[str] = MASKS) -> DataFrame:
    """(id, pos, h): the hash of each mask at each place of each text where it fits."""
    return _at_each_place(_hashed_words(rows, id_column), masks)


def item_seeds(items: DataFrame, short: dict[int, list[tuple[int, str]]], masks: tuple = MASKS, window: int = WINDOW) -> DataFrame:
    """(id, pos, h): seeds of benchmark items, of whole windows by masks at each place, of shorter ones by the masks of their length."""
    rows = _hashed_words(items, "item_id")
    out = _at_each_place(rows.where(F.size("w") >= window), masks)
    for n, placed in short.items():
        made = ", ".join(f"named_struct('pos', {at}, 'h', {_hash(m, str(at))})" for at, m in placed)
        out = out.union(rows.where(F.size("w") == n).selectExpr("id", f"inline(array({made}))"))
    return out


def overlap(doc: Column, item: Column, diagonal: Column, window: int = WINDOW, similarity: float = SIMILARITY) -> Column:
    """The most agreeing words in a window of item words laid on doc words at a diagonal; null if no window reaches the share.

    A window has `window` words, or all of a shorter item.
    """
    n = F.least(F.lit(window), F.size(item))
    need = F.ceil(n * F.lit(similarity))
    same = F.transform(item, lambda x, k: F.when((k + diagonal >= 0) & (F.get(doc, k + diagonal) == x), F.lit(1)).otherwise(F.lit(0)))
    sums = F.transform(
        F.sequence(F.lit(0), F.size(item) - n), lambda s: F.aggregate(F.slice(same, s + 1, n), F.lit(0), lambda a, x: a + x)
    )
    best = F.array_max(sums)
    return F.when(best >= need, best)


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple = MASKS, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, n_matched) for each document and benchmark item that overlap.

    They overlap if, laid on each other at a place where a spaced seed of both agrees, some window of
    words agrees in the share asked for. n_matched is the best window's agreeing words. Words are
    runs of letters and digits in lower case. An item shorter than a window is compared whole, so one
    of up to four words must occur as it is. Texts without words match nothing; very long ones are
    searched whole; rows without an id are reported without it; repeated rows give one; other
    columns are ignored; an empty table on either side gives no rows.

    The masks of short items are only sought in documents if the benchmark has items of that length:
    at most `window` different lengths come to the driver. The benchmark's seeds are broadcast if
    there are few enough, its items if they hold few enough words; else both sides are shuffled.
    """
    items = stored(benchmark.select("item_id", _words().alias("item")))
    lengths = items.where(F.size("item").between(1, window - 1)).select(F.size("item").alias("n")).distinct().collect()
    short = {r["n"]: short_masks(r["n"], similarity) for r in lengths}
    theirs = stored(item_seeds(benchmark, short, masks, window).select(F.col("id").alias("item_id"), F.col("pos").alias("at"), "h").distinct())
    ours = seeds(docs, "doc_id", [*masks, *(m for placed in short.values() for _, m in placed)])
    hits = ours.join(checked_broadcast(theirs), "h").select(F.col("id").alias("doc_id"), "item_id", (F.col("pos") - F.col("at")).alias("diagonal"))
    hits = stored(hits.distinct())
    size = items.agg(F.sum(F.size("item") + 1)).first()[0] or 0
    asked = items.withColumnRenamed("item_id", "_item")
    asked = F.broadcast(asked) if size <= BROADCAST_WORDS else asked
    found = stored(hits.select(F.col("doc_id").alias("_id")).distinct())
    texts = docs.select("doc_id", "text").join(checked_broadcast(found), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    laid = (
        hits.alias("h")
        .join(texts.select(F.col("doc_id").alias("_id"), _words().alias("doc")), F.col("h.doc_id").eqNullSafe(F.col("_id")))
        .join(asked, F.col("h.item_id").eqNullSafe(F.col("_item")))
    )
    matched = laid.select("doc_id", "item_id", overlap(F.col("doc"), F.col("item"), F.col("diagonal"), window, similarity).alias("n_matched"))
    return matched.where("n_matched IS NOT NULL").groupBy("doc_id", "item_id").agg(F.max("n_matched").cast("long").alias("n_matched"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that overlap no benchmark item, told apart by doc_id and text; all columns stay as they are."""
    found = contaminated(docs.select(row_hash().alias("doc_id"), "text"), benchmark)
    name = free_name(docs, "_row")
    found = stored(found.select(F.col("doc_id").alias(name)).distinct())
    return docs.withColumn(name, row_hash()).join(checked_broadcast(found), name, "left_anti").select(docs.columns)


def op7(spark, sf_dir) -> DataFrame:
    """All documents against the whole benchmark."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _seed_sql(source: str) -> str:
    parts = []
    for m, mask in enumerate(MASKS):
        at = " || ' ' || ".join(f"w[pos + {k + 1}]" for k, c in enumerate(mask) if c == "1")
        parts.append(f"SELECT id, pos, '{m} ' || {at} AS h FROM (SELECT id, w, unnest(range(0, len(w) - {len(mask) - 1})) AS pos FROM {source})")
    return " UNION ALL ".join(parts)


#: The same by joining the patterns' words instead of their hashes; items shorter than a window wherever one word agrees.
SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
b AS MATERIALIZED (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS ({_seed_sql("d")}),
bs AS ({_seed_sql(f"b WHERE len(w) >= {WINDOW}")}),
dw AS (SELECT id, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM d WHERE EXISTS (SELECT 1 FROM b WHERE len(w) < {WINDOW})),
bw AS (SELECT id, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM b WHERE len(w) < {WINDOW}),
hits AS (SELECT DISTINCT ds.id AS doc_id, bs.id AS item_id, ds.pos - bs.pos AS diagonal FROM ds JOIN bs USING (h)
  UNION SELECT dw.id, bw.id, dw.pos - bw.pos FROM dw JOIN bw USING (word)),
laid AS (
  SELECT h.doc_id, h.item_id, least({WINDOW}, len(b.w)) AS n,
         list_transform(range(0, len(b.w)), lambda k: CASE WHEN k + h.diagonal >= 0 AND d.w[k + h.diagonal + 1] = b.w[k + 1] THEN 1 ELSE 0 END) AS same
  FROM hits h JOIN d ON d.id = h.doc_id JOIN b ON b.id = h.item_id),
best AS (
  SELECT doc_id, item_id, n, list_max(list_transform(range(0, len(same) - n + 1), lambda s: list_sum(same[s + 1:s + n]))) AS n_matched FROM laid)
SELECT doc_id, item_id, max(n_matched)::BIGINT AS n_matched FROM best WHERE n_matched >= ceil(n * {SIMILARITY}) GROUP BY ALL
"""

"""SimHash near-dedup: 64-bit fingerprints compared at the anchors of a covering code.

Anchors are the words of the perfect Hamming code on the low 63 bits, with the top bit free: a
binary code of covering radius 1. Fingerprints at 2 or fewer differing bits have a point between
them, at most 1 bit from each; its anchor is within 1 of it, so both lie within radius + 1 of that
anchor. Replicating both sides to the 33 anchors within that distance therefore meets every link,
as replicating one side to all within radius + 2 does with 650. A ball of that radius holds at most
2,081 fingerprints, which bounds the work at an anchor however many copies there are.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.llm import setjoin
from quillsieve.llm.base import checked_broadcast, dropped, free_name, row_hash, stored, table, words
from quillsieve.llm.components import connected_components

#: Words of a shingle, and differing bits of linked fingerprints, under the query's contract.
SHINGLE, DISTANCE = 3, 2
#: Words of a shingle in the pipeline, as for other near-duplicate stages on word shingles.
PIPELINE_SHINGLE = 5
#: Hashes unpacked at once.
CHUNK = 100_000


def shingle_hashes(w: Column, size: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of each shingle of some words; fewer words than a shingle make one, none none."""
    n = F.size(w)
    many = F.transform(
        F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.concat_ws(" ", *[F.element_at(w, (i + k).cast("int")) for k in range(size)]))
    )
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < size, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(many)


def majority(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each run of 64-bit values the number whose bits are set in over half of the run; 0 for an empty run."""
    counts = np.zeros((len(offsets) - 1, 64), dtype=np.int64)
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    for at in range(0, len(values), CHUNK):
        part, own = values[at : at + CHUNK], owner[at : at + CHUNK]
        bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        counts[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    over = (counts * 2 > lengths[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view(np.int64).reshape(-1)


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row of docs; a null or empty text has fingerprint 0."""
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    listed = docs.select("doc_id", words(lowered).alias("w")).select("doc_id", shingle_hashes(F.col("w"), size).alias("h"))
    return folded(listed, "doc_id").select("doc_id", "fp")


def folded(listed: DataFrame, key: str) -> DataFrame:
    """(key, fp, h) of each row of listed(key, h): the fingerprint of its hashes, repeats included, beside them."""
    kind = dict(listed.dtypes)[key]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h")
            offsets = h.offsets.to_numpy()
            found = majority(h.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False), offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.int64()), h], names=[key, "fp", "h"])

    return listed.select(key, "h").mapInArrow(fold, f"{key} {kind}, fp long, h array<long>")


def _replicas(distinct: DataFrame) -> DataFrame:
    """(anchor, fp): each fingerprint at every anchor within radius + 1."""
    masks = [sum(1 << (i - 1) for i in range(1, 64) if i >> k & 1) for k in range(6)]
    parity = " + ".join(f"shiftleft(bit_count(fp & {m}L) & 1, {k})" for k, m in enumerate(masks))
    flip = "if(i = 0, 0L, shiftleft(1L, i - 1))"
    other = "if((i ^ s) = 0, 0L, shiftleft(1L, (i ^ s) - 1))"
    top = "shiftleft(1L, 63)"
    return (
        distinct.selectExpr("fp", f"cast({parity} as int) AS s")
        # Flipping positions i and i ^ s (0: none) makes a word of the code.
        .selectExpr("fp", "s", "explode(if(s = 0, array(0), filter(sequence(0, 63), i -> i < (i ^ s)))) AS i")
        .selectExpr("fp", "s", "i", f"if(s = 0, fp, fp ^ {flip} ^ {other}) AS near")
        # The nearest word (i = 0) also with the top bit flipped.
        .selectExpr("fp", f"explode(if(i = 0, array(near, near ^ {top}), array(near))) AS anchor")
    )


def linked(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The pairs (u, v), u < v, of distinct fingerprints fp at `distance` (2 at most) or fewer differing bits."""
    if distance > 2:
        raise ValueError("the replicas meet links of at most 2 bits")
    copies = _replicas(distinct)
    left, right = copies.select("anchor", F.col("fp").alias("u")), copies.select("anchor", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    # Spark takes the copies for as small as the fingerprints they come from, and would broadcast 33 rows of each.
    return left.hint("merge").join(right, "anchor").where((F.col("u") < F.col("v")) & near).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs(doc_id, text): component_id is the smallest doc_id reachable by links.

    Rows with equal fingerprints are one vertex, so exact copies are never compared. Texts without
    words (null, empty) have fingerprint 0 and are linked like others; texts with fewer words than a
    shingle have one; a null doc_id counts in no minimum; repeated rows appear once each; other
    columns are ignored; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, size))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(linked(classes.select("fp"), distance))
    joined = classes.join(parts, classes["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    whole = stored(joined)
    roots = whole.where("component <> fp").groupBy("component").agg(F.min("least").alias("other"))
    # A component's least id is that of its root's class or of another class; classes alone keep their own.
    heads = whole.where("component = fp").join(roots, "component", "left").select("component", F.least("least", "other").alias("component_id"))
    ids = stored(whole.join(checked_broadcast(heads), "component").select("fp", "component_id"))
    return prints.join(checked_broadcast(ids), "fp").select("doc_id", "fp", "component_id")


def close_pairs(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (u, v) of keys of prints(key, fp) that join all whose fingerprints link: each key with the least of its fingerprint, and these with each other."""
    least = stored(prints.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")))
    of = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"k_{c}"))
    between = stored(linked(least.select("fp"), distance)).join(of("u"), "u").join(of("v"), "v").select(F.col("k_u").alias("u"), F.col("k_v").alias("v"))
    same = prints.join(checked_broadcast(least.where("n > 1").select("fp", "least")), "fp").where("key <> least").select(F.col("key").alias("u"), F.col("least").alias("v"))
    return between.union(same)


def near_copies(docs: DataFrame, size: int = PIPELINE_SHINGLE, similarity: float = setjoin.SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of every row of docs(doc_id, text): component_id is the smallest doc_id reachable by links.

    Texts are linked if the sets of their shingles of `size` words have that Jaccard similarity or
    more, compared exactly. Texts whose fingerprints are at 2 or fewer differing bits are compared
    first; near copies whose fingerprints are further apart are found by prefixes of their sets. Texts of the same words are one vertex, those without words another one.
    """
    found = _components(docs, size, similarity)
    least = stored(found.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return found.join(checked_broadcast(least), "component").select("doc_id", "component_id")


def _components(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(doc_id, row, component) of every row of docs(doc_id, text)."""
    rows = docs.select("doc_id", row_hash().alias("row"), setjoin.normal(F.col("text")).alias("t"))
    ids = stored(rows.select("doc_id", "row", F.xxhash64("t").alias("key")))
    # Of the rows of one key any will do: they are the same words.
    chosen = stored(ids.groupBy("key").agg(F.min("row").alias("row")))
    each = rows.select("row", words(F.col("t")).alias("w")).join(checked_broadcast(chosen), "row")
    listed = each.select("key", shingle_hashes(F.col("w"), size).alias("h"))
    sets = stored(folded(listed, "key").select("key", "fp", F.array_distinct("h").alias("h")))
    close = stored(close_pairs(sets.where("size(h) > 0").select("key", "fp").distinct()))
    parts = stored(setjoin.similar_sets(sets, similarity, close))
    dropped(sets)
    return stored(ids.join(checked_broadcast(parts), ids["key"] == parts["node"], "left").select("doc_id", "row", F.coalesce("component", "key").alias("component")))


def keep_one(docs: DataFrame, size: int = PIPELINE_SHINGLE, similarity: float = setjoin.SIMILARITY) -> DataFrame:
    """The rows of docs but for near copies: of each group the row with the smallest doc_id stays.

    Rows are told apart by doc_id and text: of rows of a group that share the smallest doc_id one
    stays, the same in every run, and rows that repeat a doc_id with unlike texts all stay. Rows
    without doc_id come after all others of their group. An empty table stays empty; other columns
    are kept as they are.
    """
    found = _components(docs.select("doc_id", "text"), size, similarity)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    kept = stored(found.groupBy("component").agg(first).select(F.col("first.row").alias("row")))
    repeated = found.groupBy("row").count().where("count > 1").limit(1).count()
    name = free_name(docs, "_row")
    out = docs.withColumn(name, row_hash()).join(checked_broadcast(kept.withColumnRenamed("row", name)), name, "left_semi")
    return (out.dropDuplicates([name]) if repeated else out).select(docs.columns)


def op3(spark, sf_dir) -> DataFrame:
    """Fingerprint and component of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

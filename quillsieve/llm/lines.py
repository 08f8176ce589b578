"""Line dedup: near-equal lines found by MinHash over character shingles, one line kept of each component.

Everything here is DataFrame operations. Lines are told apart by two 64-bit hashes of their normal
form (lower case, outer white space trimmed), so exact copies cost one signature each only until the
first shuffle, where they combine.

A bucket first costs two candidates a line, whatever its size: each line is compared with the
bucket's first and last line in an order of the bucket's own (`key XOR bucket`). As the orders of
different buckets have nothing to do with each other, most lines that one bucket's ends leave apart
meet through the ends of another. Buckets that still hold several components are then compared
whole: every two of their lines in different components, in blocks of lines of bounded size. So
two lines that share a bucket end in one component or are compared; nothing is capped.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.base import checked_broadcast, dropped, free_name, stored, table
from quillsieve.llm.components import connected_components

#: Characters (UTF-16 units) of a shingle; lines as similar as this or more, by Jaccard of shingle sets, are linked.
SHINGLE, SIMILARITY = 8, 0.8
#: Minima of a signature.
MINIMA = 12
#: Bands: triples of minima, each minimum in three of them. Lines at similarity 0.8 meet in one with
#: probability 0.992, at 0.85 with 0.998, at 0.9 with 0.9996.
BANDS = ((0, 4, 8), (1, 5, 9), (2, 6, 10), (3, 7, 11), (0, 5, 10), (1, 6, 11), (2, 7, 8), (3, 4, 9), (0, 6, 9), (1, 7, 10), (2, 4, 11), (3, 5, 8))
#: Share of minima in which lines must agree for their sets to be compared; at similarity 0.8 one pair in 250 agrees in fewer.
LEAST_AGREEING = 0.5
#: Lines of a block, when a bucket that still holds several components is compared whole.
BLOCK = 512
#: 64-bit words of a bitmap of a line's shingles.
WORDS = 16
#: Shingles hashed in one row, and rows listed at once, so that a line of any length stays in bounded memory.
STRIDE, STRETCH = 4, 2048

_LINES = r"split(lower(coalesce(text, '')), '\n')"
_ROW = "xxhash64(doc_id, text)"
_NORMAL = r"btrim(l, ' \t\r\f\u000b')"


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row, pos, line, key, key2): the normal form of each line that isn't blank and its hashes, pos counting all lines from 0; row tells rows apart."""
    each = docs.selectExpr("doc_id", f"{_ROW} AS row", f"posexplode({_LINES}) AS (pos, l)").selectExpr("doc_id", "row", "pos", f"{_NORMAL} AS line")
    return each.where("line <> ''").selectExpr("doc_id", "row", "pos", "line", "xxhash64(line) AS key", "xxhash64(line, 2) AS key2")


def signatures(docs: DataFrame, shingle: int = SHINGLE, minima: int = MINIMA) -> DataFrame:
    """(key, key2, m0, m1, ...): for each different line its minima.

    Each minimum is of a half of the shingle's hash times a fixed odd number, its low 32 bits, which
    orders the hashes anew. All shingles of a line count; they never leave the task before they are minima.
    """
    fixed = random.Random(20)
    size = 2 * shingle
    rows = line_rows(docs).selectExpr("key", "key2", "encode(line, 'UTF-16BE') AS units")
    rows = rows.selectExpr("key", "key2", "units", f"greatest(0, length(units) div 2 - {shingle}) AS last")
    rows = rows.selectExpr("key", "key2", "units", "last", f"explode(sequence(0L, last div {STRIDE * STRETCH})) AS stretch")
    listed = f"sequence(cast(stretch * {STRETCH} AS int), cast(least(last div {STRIDE}, stretch * {STRETCH} + {STRETCH - 1}) AS int))"
    rows = rows.selectExpr("key", "key2", "units", "cast(last AS int) AS last", f"explode({listed}) AS at")
    hashed = [f"xxhash64(substring(units, 2 * least(last, at * {STRIDE} + {j}) + 1, {size})) AS h{j}" for j in range(STRIDE)]
    halves = [f"shiftrightunsigned(h{j}, 32) AS p{j}" for j in range(STRIDE)] + [f"h{j} & 4294967295L AS q{j}" for j in range(STRIDE)]
    rows = rows.selectExpr("key", "key2", *hashed).selectExpr("key", "key2", *halves)
    least = []
    for k in range(minima):
        factor = fixed.getrandbits(31) | 1  # of 31 bits: the product stays within 63
        each = ", ".join(f"({'p' if k % 2 else 'q'}{j} * {factor}L) & 4294967295L" for j in range(STRIDE))
        least.append(F.min(F.expr(f"least({each})")).alias(f"m{k}"))
    signed = rows.groupBy("key", "key2").agg(*least)
    return signed.select("key", "key2", *[(F.col(f"m{k}") - F.lit(1 << 31)).cast("int").alias(f"m{k}") for k in range(minima)])


def buckets(signed: DataFrame, bands: tuple = BANDS) -> DataFrame:
    """(key, bucket): the hash of each band of a line's minima."""
    return signed.select("key", F.explode(F.array(*[F.xxhash64(F.lit(b), *[f"m{k}" for k in band]) for b, band in enumerate(bands)])).alias("bucket"))


def candidates(members: DataFrame) -> DataFrame:
    """The different pairs (u, v), u < v, of each line of members(key, bucket) and its buckets' first and last line."""
    order = F.col("key").bitwiseXOR(F.col("bucket"))
    ends = stored(members.groupBy("bucket").agg(F.min(order).alias("a"), F.max(order).alias("z")).where("a <> z"))
    with_ends = members.join(checked_broadcast(ends), "bucket").select("key", F.explode(F.array(F.col("bucket").bitwiseXOR(F.col("a")), F.col("bucket").bitwiseXOR(F.col("z")))).alias("end"))
    return with_ends.where("key <> end").select(F.least("key", "end").alias("u"), F.greatest("key", "end").alias("v")).distinct()


def shared(members: DataFrame) -> DataFrame:
    """Those of members(key, bucket) in buckets of several lines."""
    several = stored(members.groupBy("bucket").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z").select("bucket"))
    return members.join(checked_broadcast(several), "bucket", "left_semi").select("key", "bucket")


def _agree(left: list[str], right: list[str], share: float) -> Column:
    """Whether the minima in two lists of columns agree in that share or more."""
    same = sum((F.when(F.col(a) == F.col(b), F.lit(1)).otherwise(F.lit(0)) for a, b in zip(left, right, strict=True)), F.lit(0))
    return same >= share * len(left)


def bitmaps(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(key, n, b0, b1, ...): how many different shingles each line of texts(key, line) has, and a bitmap of their hashes."""
    each = texts.select("key", F.explode(F.array_distinct(shingle_hashes(F.col("line"), shingle))).alias("h"))
    word = F.col("h").bitwiseAND(F.lit(WORDS - 1))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 32) & 63 AS int))")
    return each.groupBy("key").agg(F.count("*").alias("n"), *[F.bit_or(F.when(word == k, bit).otherwise(F.lit(0))).alias(f"b{k}") for k in range(WORDS)])


def fitting(left: str, right: str, similarity: float = SIMILARITY) -> Column:
    """Whether sets of which bitmaps() are in columns with these prefixes can be as similar as asked for. Says yes to every two that are.

    Each bit in which the bitmaps differ is one of another shingle that only one of the sets has.
    """
    n, m = F.col(f"{left}n"), F.col(f"{right}n")
    differ = sum((F.bit_count(F.col(f"{left}b{k}").bitwiseXOR(F.col(f"{right}b{k}"))) for k in range(WORDS)), F.lit(0))
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9) & (differ * (1 + similarity) <= (n + m) * (1 - similarity) + 1e-9)


def apart(members: DataFrame, parts: DataFrame, signed: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, share: float = LEAST_AGREEING, block: int = BLOCK) -> DataFrame:
    """The different pairs (u, v), u < v, of lines that share a bucket of members(key, bucket), are in different components of parts(node, component), agree in enough minima and are fitting().

    A bucket is cut into blocks of about `block` lines, and each two blocks meet under a key of their
    own, so a large bucket is compared all over the cluster.
    """
    names = [c for c in signed.columns if c.startswith("m")]
    placed = members.join(checked_broadcast(parts), F.col("key") == F.col("node"), "left").select("bucket", "key", F.coalesce("component", "key").alias("part"))
    cut = placed.groupBy("bucket").agg(F.min("part").alias("a"), F.max("part").alias("z"), F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("a <> z")
    rest = stored(placed.join(checked_broadcast(stored(cut.select("bucket", "blocks"))), "bucket").withColumn("block", F.pmod(F.xxhash64("key", "bucket"), F.col("blocks")).cast("int")))
    wanted = checked_broadcast(stored(rest.select("key").distinct()))
    marks = stored(signed.join(wanted, "key", "left_semi").join(bitmaps(texts.join(wanted, "key", "left_semi"), shingle), "key"))
    held = rest.join(marks, "key")
    of = lambda side: [F.col(c).alias(f"{side}{c}") for c in ("key", "part", *marks.columns[1:])]
    left = held.select("bucket", F.col("block").alias("low"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("high"), *of("x"))
    right = held.select("bucket", F.explode(F.sequence(F.lit(0), "block")).alias("low"), F.col("block").alias("high"), *of("y"))
    met = left.join(right, ["bucket", "low", "high"]).where("xpart <> ypart AND (low < high OR xkey < ykey)")
    met = met.where(_agree([f"x{c}" for c in names], [f"y{c}" for c in names], share)).where(fitting("x", "y", similarity))
    return met.select(F.least("xkey", "ykey").alias("u"), F.greatest("xkey", "ykey").alias("v")).distinct()


def ends_of(pairs: DataFrame) -> DataFrame:
    """(key): every line of pairs(u, v)."""
    return pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()


def agreeing(pairs: DataFrame, signed: DataFrame, share: float = LEAST_AGREEING) -> DataFrame:
    """Those of pairs(u, v) whose minima agree in that share or more."""
    names = [c for c in signed.columns if c.startswith("m")]
    held = stored(signed.join(checked_broadcast(stored(ends_of(pairs))), "key", "left_semi").select("key", *names))
    left = held.select(F.col("key").alias("u"), *[F.col(c).alias(f"a{c}") for c in names])
    right = held.select(F.col("key").alias("v"), *[F.col(c).alias(f"b{c}") for c in names])
    return pairs.join(left, "u").join(right, "v").where(_agree([f"a{c}" for c in names], [f"b{c}" for c in names], share)).select("u", "v")


def shingle_hashes(line: Column, shingle: int = SHINGLE) -> Column:
    """The hashes of a line's shingles, repeats included. Its UTF-16 form passes through a list of one, or it would be made for each shingle."""
    size = 2 * shingle

    def of(units: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(units) - (size - 1)), F.lit(2)), lambda i: F.xxhash64(F.substring(units, i, F.lit(size))))

    return F.flatten(F.transform(F.array(F.encode(line, "UTF-16BE")), of))


def verified(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Those of pairs(u, v) whose lines in texts(key, line) are as similar as asked for, by exact Jaccard of their shingle sets."""
    both = pairs.join(texts.select(F.col("key").alias("u"), F.col("line").alias("a")), "u").join(texts.select(F.col("key").alias("v"), F.col("line").alias("b")), "v")
    # Sets pass through a generator of one row, or they would be made for each use.
    sets = F.array(F.struct(shingle_hashes(F.col("a"), shingle).alias("x"), shingle_hashes(F.col("b"), shingle).alias("y")))
    return both.select("u", "v", F.inline(sets)).where(F.size(F.array_intersect("x", "y")) >= similarity * F.size(F.array_union("x", "y")) - 1e-9).select("u", "v")


def placed_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, place, pos, key, key2, line) of all lines; place orders them by doc_id, then pos; line only of the keys of wanted(key)."""
    place = "cast(cast(coalesce(doc_id, 9223372036854775807) AS decimal(20, 0)) * cast(2147483648 AS decimal(11, 0)) + pos AS decimal(38, 0)) AS place"
    side = checked_broadcast(wanted.select("key", F.lit(True).alias("asked")))
    return line_rows(docs).selectExpr("row", place, "pos", "key", "key2", "line").join(side, "key", "left").selectExpr("row", "place", "pos", "key", "key2", "if(asked, line, null) AS line")


def similar_lines(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(node, component) of each line, by key, that is linked to another one; and all lines, as placed_lines() has them."""
    all_signed = stored(signatures(docs, shingle))
    members = stored(shared(buckets(all_signed)))
    keys = stored(members.select("key").distinct())
    signed = stored(all_signed.join(checked_broadcast(keys), "key", "left_semi"))
    dropped(all_signed)
    likely = stored(agreeing(stored(candidates(members)), signed))
    lines = stored(placed_lines(docs, keys))
    texts = stored(lines.where("line IS NOT NULL").groupBy("key").agg(F.min("line").alias("line")))
    links = stored(verified(likely, texts, shingle, similarity))
    parts = stored(connected_components(links))
    more = stored(verified(stored(apart(members, parts, signed, texts, shingle, similarity)), texts, shingle, similarity))
    dropped(members)
    dropped(signed)
    dropped(texts)
    if not more.limit(1).count():
        return parts, lines
    return stored(connected_components(links.union(more))), lines


def removals(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(row, gone): for each row of docs that loses lines the places of these."""
    parts, lines = similar_lines(docs, shingle, similarity)
    # Lines outside all links are told apart by both hashes.
    named = lines.join(checked_broadcast(parts), F.col("key") == F.col("node"), "left").select(
        "row", "pos", "place", F.coalesce("component", "key").alias("component"), F.when(F.col("component").isNull(), F.col("key2")).otherwise(F.lit(0)).alias("second")
    )
    firsts = named.groupBy("component", "second").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last")
    firsts = stored(firsts.select("component", "second", "first"))
    gone = named.join(checked_broadcast(firsts), ["component", "second"]).where("place > first")
    out = stored(gone.groupBy("row").agg(F.collect_set("pos").alias("gone")))
    dropped(lines)
    return out


def dedup_lines(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, counts: bool = True) -> DataFrame:
    """docs with text cut down to the first line of each component and, if counts, n_lines and n_removed added.

    First is the line with the smallest doc_id, then the smallest place. Blank lines stay; null
    texts stay null; a document all of whose lines are removed keeps an empty text; lines of any
    length are compared whole. Rows equal in doc_id and text keep the same lines; rows that repeat a
    doc_id with another text are rows of their own; rows without doc_id come after all others and do
    not remove lines of each other at the same place. An empty table gives no rows. All other columns
    stay as they are; where docs has one named n_lines or n_removed the added one gets an underscore more.
    """
    removed = removals(docs.select("doc_id", "text"), shingle, similarity)
    row, gone = free_name(docs, "_row"), free_name(docs, "_gone")
    number = removed.agg(F.sum(F.size("gone"))).first()[0] or 0  # the rows hold lists: both are bounded
    side = removed.select(F.col("row").alias(row), F.col("gone").alias(gone))
    joined = docs.join(checked_broadcast(side) if number <= 2_000_000 else side.hint("merge"), F.expr(_ROW) == F.col(row), "left")
    split = F.split("text", "\n")

    def cut(parts: Column) -> Column:
        """What is left of the lines, joined; the parts are bound once, not made again for each line."""
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
        return F.array_join(F.transform(left, lambda i: F.element_at(parts, i + 1)), "\n")

    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.element_at(F.transform(F.array(split), cut), 1))
    added = [
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(split)).cast("long").alias(free_name(docs, "n_lines")),
        F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long").alias(free_name(docs, "n_removed")),
    ]
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], *(added if counts else []))


def op1(spark, sf_dir) -> DataFrame:
    """All documents without lines that an earlier line stands for."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")

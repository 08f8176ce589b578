"""Near-dedup by SetSketch registers: banded for candidates, estimated by likelihood, confirmed on full sets.

Each of REGISTERS hashes gives a text's shingles values of an exponential distribution. A register
holds the logarithm to BASE of their minimum, rounded and cut to a byte, so registers of parts of a
set merge by maximum. Two sets of Jaccard similarity J and sizes u and v agree in a register, or
one has the larger value, with probabilities that J, u and v alone decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.llm import scan
from quillsieve.llm.base import checked_broadcast, dropped, stored, table
from quillsieve.llm.components import connected_components

#: Words of a shingle, and percentage of the union that linked sets share, under the query's contract.
SHINGLE, PERCENT = 2, 80
#: Bands and registers of a band. At similarity 0.8 two sets agree in a register with probability 0.8156, in no band with 0.0002.
BANDS, ROWS = 24, 6
REGISTERS = BANDS * ROWS
#: Base of the registers, rate of the exponential values, largest register.
BASE, RATE, TOP = 1.2, 20.0, 255
#: By how much the logarithm of the likelihood of PERCENT may lie below the best one of a pair that is compared; a pair at PERCENT itself lies lower once in 250,000.
SURPRISE = 10.0
#: Rounds in which one node stands for its component in a bucket.
TURNS = 2
#: Nodes of a bucket that is compared pair by pair; members of sets in a block of a larger one; columns of the matrix that compares blocks.
SMALL, ELEMENTS, COLUMNS = 8, 1 << 18, 4096
#: Shingles whose values are made together.
CHUNK = 1 << 17
_ODD = np.random.default_rng(11).integers(1 << 62, 1 << 63, REGISTERS, dtype=np.uint64) | np.uint64(1)
_GRID = np.linspace(0.005, 0.995, 199)


def shingle_sets(data: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different hashes of each text's shingles, one text after the other, and len + 1 offsets; A-Z count as a-z."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)
    starts, lengths = scan.word_spans(data, ends)
    words = scan.word_hashes(scan.eights(data), starts, lengths)
    upto = np.searchsorted(starts, ends)
    out, sizes = [], []
    for a, b in zip(upto[:-1], upto[1:], strict=True):
        own = words[a:b]
        width = min(size, len(own))
        h = np.full(len(own) - width + 1 if width else 0, width, dtype=np.uint64)
        for k in range(width):
            h = scan.mixed(h ^ own[k : len(own) - width + 1 + k])
        h.sort()
        h = h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h
        out.append(h)
        sizes.append(len(h))
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.r_[0, np.cumsum(sizes)].astype(np.int64)


def registers(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of REGISTERS bytes for each set between neighbouring offsets; the empty set has zeros. Parts merge by maximum."""
    least = np.full((len(offsets) - 1, REGISTERS), np.iinfo(np.uint64).max, dtype=np.uint64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for at in range(0, len(h), CHUNK):
        part, own = h[at : at + CHUNK], owner[at : at + CHUNK]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        who = own[starts]
        for k, odd in enumerate(_ODD):
            least[who, k] = np.minimum(least[who, k], np.minimum.reduceat(part * odd, starts))
    value = -np.log1p(-((least >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
    out = np.clip(np.floor(1.0 - np.log(value / RATE) / math.log(BASE)), 0, TOP).astype(np.uint8)
    out[np.diff(offsets) == 0] = 0
    return out


def _larger(x: np.ndarray) -> np.ndarray:
    """The probability that a register of one set exceeds the other's, x being the share of the union that only the one has."""
    return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1.0) / BASE) / math.log(BASE)


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether pairs of register rows a[i], b[i] of sets of n_a[i] and n_b[i] members may reach `percent`, by joint likelihood."""
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - above - below

    def likelihood(j: np.ndarray) -> np.ndarray:
        both = j * (n_a + n_b)[:, None] / (1.0 + j)
        union = (n_a + n_b)[:, None] - both
        over, under = _larger((n_a[:, None] - both) / union), _larger((n_b[:, None] - both) / union)
        log = lambda p: np.log(np.maximum(p, 1e-12))
        return above * log(over) + below * log(under) + equal * log(1.0 - over - under)

    # More than the smaller set can't be shared.
    grid = np.minimum(_GRID[None, :], (np.minimum(n_a, n_b) / np.maximum(n_a, n_b))[:, None])
    found = likelihood(grid)
    best = found.argmax(axis=1)
    at = np.arange(len(best))
    asked = likelihood(np.full((len(best), 1), percent / 100))[:, 0]
    fits = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return fits & ((grid[at, best] >= percent / 100) | (found[at, best] - asked <= SURPRISE))


def _binary(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows)
    ends = np.arange(0, data.size + 1, data.shape[1], dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _rows(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column whose values all have REGISTERS bytes."""
    flat = column.cast(pa.binary())
    first = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset] if len(flat) else 0
    return np.frombuffer(flat.buffers()[2] or b"", np.uint8)[first : first + len(flat) * REGISTERS].reshape(-1, REGISTERS)


def _marks(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart, as two sums over their members."""
    total = lambda x: np.diff(np.r_[np.uint64(0), np.cumsum(x, dtype=np.uint64)][offsets]).view(np.int64)
    return total(scan.mixed(h ^ _ODD[0])), total(scan.mixed(h ^ _ODD[1]))


def sketched(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n, a, b, regs) of each row of docs: how many shingles it has, what tells its set from others, its registers."""
    kind = dict(docs.dtypes)["doc_id"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, ends in scan.slices(batch.column("text")):
                h, offsets = shingle_sets(data, ends, size)
                a, b = _marks(h, offsets)
                columns = [batch.column("doc_id").slice(first, last - first), pa.array(np.diff(offsets)), pa.array(a), pa.array(b), _binary(registers(h, offsets))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "a", "b", "regs"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(look, f"doc_id {kind}, n long, a long, b long, regs binary")


def full_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(a, b, h) of each row of docs(text): its set and what tells it from others."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, ends in scan.slices(batch.column("text")):
                h, offsets = shingle_sets(data, ends, size)
                a, b = _marks(h, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(h.view(np.int64)))], names=["a", "b", "h"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(look, "a long, b long, h array<long>")


def _may_link(percent: int) -> Column:
    """Whether sets u and v can share enough: they share at most the members that each has in common with any other set."""
    return F.least("met_u", "met_v") * (100 + percent) >= (F.col("n_u") + F.col("n_v")) * percent


def _likely(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(u, v) that may link and whose registers in marks(node, n, met, regs) make the similarity plausible."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [batch.column(c).to_numpy() for c in ("n_u", "n_v")]
            fit = plausible(_rows(batch.column("r_u")), _rows(batch.column("r_v")), *n, percent)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(fit)) for c in ("u", "v")], names=["u", "v"])

    for c in ("u", "v"):
        pairs = pairs.join(marks.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("met").alias(f"met_{c}"), F.col("regs").alias(f"r_{c}")), c)
    return pairs.where(_may_link(percent)).mapInArrow(choose, "u long, v long")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets have in common."""
    flat = np.concatenate(sets)
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    several = count[at] > 1
    place = np.cumsum(count > 1) - 1
    at, owner = place[at[several]], owner[several]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        a, b = np.searchsorted(at, [first, first + COLUMNS])
        held = np.zeros((len(sets), min(COLUMNS, int(at[-1]) + 1 - first)), dtype=np.float32)
        held[owner[a:b], at[a:b] - first] = 1
        out += held @ held.T
    return out


def _forest(nodes: np.ndarray, parts: np.ndarray, block: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of a block or two that join all components which any link of theirs joins."""
    n = np.array([len(x) for x in sets])
    linked = _common(sets) * (100 + percent) >= (n[:, None] + n[None, :]) * percent
    linked &= parts[:, None] != parts[None, :]
    if block.min() != block.max():
        linked &= block[:, None] != block[None, :]
    head: dict[int, int] = {}

    def find(x: int) -> int:
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    out = []
    for i, j in np.argwhere(np.triu(linked, 1)):
        a, b = find(int(parts[i])), find(int(parts[j]))
        if a != b:
            head[b] = a
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _in_blocks(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between components of rest(bucket, node, part) that share a bucket, from all pairs of a bucket.

    A bucket is cut into blocks of about ELEMENTS members of sets; each two blocks meet in a task,
    which compares their sets all at once and gives only links that join components.
    """
    held = rest.join(sets, "node").withColumn("n", F.size("h"))
    cut = rest.join(sets.select("node", F.size("h").alias("n")), "node").groupBy("bucket").agg(F.ceil(F.sum("n") / ELEMENTS).cast("int").alias("blocks"))
    placed = held.join(checked_broadcast(stored(cut)), "bucket").withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = placed.select("bucket", "node", "part", "block", "h", other.alias("with"))
    met = met.select("bucket", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "node", "part", "block", "h")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> pa.RecordBatch:
            found = _forest(*[np.array([r[k] for r in rows]) for k in (0, 1, 2)], [r[3] for r in rows], percent) if len({r[1] for r in rows}) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            keys = list(zip(*[batch.column(c).to_numpy().tolist() for c in ("bucket", "low", "high")], strict=True))
            node, part, block = (batch.column(c).to_numpy().tolist() for c in ("node", "part", "block"))
            column = batch.column("h")
            ends = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False)
            for k, own in enumerate(keys):
                if own != key and rows:
                    yield done()
                    rows = []
                key = own
                rows.append((node[k], part[k], block[k], flat[ends[k] : ends[k + 1]].copy()))
        if rows:
            yield done()

    at = ["bucket", "low", "high"]
    return met.repartition(*at).sortWithinPartitions(*at).mapInArrow(look, "u long, v long")


def _components(members: DataFrame, marks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, part) of every node of members(bucket, size, least, node) under all links of nodes that share a bucket.

    First each node is compared with the smallest node of all its buckets, which joins most copies.
    In buckets that still hold several components one node of each is compared with a node of
    another one, in TURNS rounds with other nodes each. What still holds several
    components is compared whole: buckets of SMALL nodes or fewer as pairs, a share of the nodes in
    each round, larger ones in blocks. So every pair of a bucket is in one component or compared.
    """

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of pairs(u, v) that are links, on full sets."""
        each = pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        likely = stored(_likely(each, marks, percent))
        both = likely.join(sets.select(F.col("node").alias("u"), F.col("h").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("h").alias("b")), "v")
        shared = F.size(F.array_intersect("a", "b")).cast("long")
        out = stored(both.where(shared * (100 + percent) >= (F.size("a") + F.size("b")) * percent).select("u", "v"))
        dropped(likely)
        return out

    def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
        """parts with the components that links of their nodes join; only components go through union-find."""
        of = lambda c: parts.select(F.col("node").alias(c), F.col("part").alias(f"p_{c}"))
        between = links.join(of("u"), "u").join(of("v"), "v").select(F.col("p_u").alias("u"), F.col("p_v").alias("v")).distinct()
        moved = stored(connected_components(between).withColumnsRenamed({"node": "part", "component": "to"}))
        out = stored(parts.join(checked_broadcast(moved), "part", "left").select("node", F.coalesce("to", "part").alias("part")))
        for old in (parts, links, moved):
            dropped(old)
        return out

    def split(live: DataFrame, parts: DataFrame) -> DataFrame:
        """(bucket, size, node, part) of live buckets that hold several components."""
        now = live.select("bucket", "size", "node").join(checked_broadcast(parts), "node")
        several = stored(now.groupBy("bucket").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("bucket"))
        rest = stored(now.join(checked_broadcast(several), "bucket", "left_semi"))
        dropped(several)
        dropped(live)
        return rest

    parts = stored(members.select("node").distinct().select("node", F.col("node").alias("part")))
    parts = joined(parts, linked(members.groupBy("node").agg(F.min("least").alias("v")).select(F.col("node").alias("u"), "v")))
    rest = split(members, parts)
    for turn in range(TURNS):
        order = F.xxhash64("bucket", "node", F.lit(turn))
        firsts = rest.groupBy("bucket", "part").agg(F.min(order).alias("h"), F.min_by("node", order).alias("u"))
        heads = firsts.groupBy("bucket").agg(F.min_by("u", "h").alias("v"))
        parts = joined(parts, linked(firsts.join(heads, "bucket").select("u", "v")))
        rest = split(rest, parts)
    sizes = marks.select("node", "n", "met")
    fit = _may_link(percent)
    before, most = 0.0, 2.0
    while before < SMALL and rest.limit(1).count():
        turn = F.shiftrightunsigned(F.xxhash64("bucket", "node"), 11) * F.lit(2.0**-53) * F.col("size")
        known = rest.where(F.col("size") <= SMALL).join(checked_broadcast(sizes), "node")
        heads = known.where((turn >= before) & (turn < most)).select("bucket", F.col("node").alias("u"), F.col("part").alias("of_u"), F.col("n").alias("n_u"), F.col("met").alias("met_u"))
        others = known.select("bucket", F.col("node").alias("v"), F.col("part").alias("of_v"), F.col("n").alias("n_v"), F.col("met").alias("met_v"))
        tried = heads.join(others, (heads["bucket"] == others["bucket"]) & (F.col("of_u") != F.col("of_v")) & fit).select("u", "v")
        parts = joined(parts, linked(tried))
        before, most = most, most * 4
        rest = split(rest, parts)
    parts = joined(parts, stored(_in_blocks(rest.where(F.col("size") > SMALL), sets, percent)))
    dropped(rest)
    return parts


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs(doc_id, text).

    A text's set has its different shingles of `size` words; with fewer words the whole sequence is
    one, with none the set is empty and linked with nothing. Sets are linked if they share `percent`
    or more of their union, as confirmed on the sets themselves; candidates agree in all registers of
    a band. component_id is the smallest doc_id reachable, itself included, and a row is kept if it
    has that.

    Equal sets are one vertex, so copies are never compared. Null texts are empty. A null doc_id
    counts in no minimum, and its row is kept never; component_id is null only if no row of the
    component has an id. Rows that repeat a doc_id stand for themselves, equal ones are all kept.
    Very long texts are read whole. Other columns are ignored; an empty table gives no rows.
    """
    rows = stored(sketched(docs, size))
    grouped = rows.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("least"), F.first("regs").alias("regs"))
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()))
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("regs", 1 + k * ROWS, ROWS)) for k in range(BANDS)])
    buckets = classes.select("node", F.explode(bands).alias("bucket"))
    shared = stored(buckets.groupBy("bucket").count().where("count > 1").select("bucket"))
    together = stored(buckets.join(checked_broadcast(shared), "bucket", "left_semi"))
    dropped(shared)
    live = stored(classes.join(checked_broadcast(stored(together.select("node").distinct())), "node", "left_semi"))
    # Of each set the row with its smallest doc_id is read again; rows that repeat that id may give a set twice.
    firsts = live.select(F.col("least").alias("_least")).distinct()
    wanted = docs.select("doc_id", "text").join(checked_broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("_least")), "left_semi")
    sets = stored(full_sets(wanted, size).join(checked_broadcast(live.select("a", "b", "node")), ["a", "b"]).select("node", "h"))
    if sets.groupBy("node").count().where("count > 1").limit(1).count():
        sets = stored(sets.dropDuplicates(["node"]))
    # Members that no other set has can't be shared, so sets with too many of them have no link.
    alone = sets.select("node", F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("alone"))
    met = live.join(stored(alone), "node", "left").withColumn("met", F.col("n") - F.coalesce("alone", F.lit(0))).where(F.col("met") * 100 >= F.col("n") * percent)
    marks = stored(met.select("node", "n", "met", "regs"))
    dropped(live)
    held = stored(together.join(checked_broadcast(marks.select("node")), "node", "left_semi"))
    dropped(together)
    full = stored(held.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("least")).where("size > 1"))
    members = stored(held.join(checked_broadcast(full), "bucket"))
    dropped(held)
    dropped(full)
    parts = _components(members, marks, sets, percent)
    dropped(members)
    dropped(sets)
    whole = classes.select("a", "b", "least", "node").join(checked_broadcast(parts), "node", "left").withColumn("part", F.coalesce("part", "node"))
    ids = stored(whole.select("a", "b", "least", "part"))
    heads = stored(ids.groupBy("part").agg(F.min("least").alias("component_id"), F.count("*").alias("sets")).where("sets > 1"))
    named = ids.join(checked_broadcast(heads), "part", "left").select("a", "b", F.when(F.col("sets") > 1, F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    out = rows.where("n > 0").join(named, ["a", "b"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


#: The same components in SQL, from all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END)) AS s FROM w),
c AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
h AS (SELECT c, n, unnest(s) AS x FROM c),
p AS (
  SELECT a.c AS a, b.c AS b FROM h a JOIN h b ON a.x = b.x AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 180 * count(*) >= 80 * (a.n + b.n)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT c AS x, c AS y FROM c UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
m AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.m, s.doc_id) AS component_id, coalesce(m.m, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN m ON m.x = c.c
"""


def op11(spark, sf_dir) -> DataFrame:
    """Shingles and component of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))

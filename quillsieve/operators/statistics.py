"""Clustered and paired statistics over per-document outcomes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillsieve.functions.hashing import hash_unit
from quillsieve.sources.scratch import scratch_folder

#: Clusters of a cell that are gathered in one row, of 16 bytes a value each; cells of more are drawn by joins.
GATHERED = 1 << 18
#: Places drawn at once.
_STEP = 128


def _sums(rows: DataFrame, keys: list[str], cluster: str, values: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    complete = rows.where(" AND ".join(f"{v} IS NOT NULL AND NOT isnan({v})" for v in values))
    return complete.groupBy(*keys, cluster).agg(F.count("*").alias("size"), *[F.sum(v).alias(v) for v in (*values, *more)])


def _placed(sums: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    cell = Window.partitionBy(*keys)
    return sums.withColumn("j", F.row_number().over(cell.orderBy(cluster)) - 1).withColumn("k", F.count("*").over(cell))


def kept(df: DataFrame) -> DataFrame:
    """df written to scratch and read back, so that what it is made from is made once however often it is used."""
    spark = df.sparkSession
    path = scratch_folder(spark, "kept")
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._kept_path = path
    return back


def freed(df: DataFrame) -> None:
    """Deletes the scratch table behind a result of kept() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cluster_table(rows: DataFrame, keys: list[str], cluster: str, values: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """For each cell and cluster the number of complete rows (size) and the sums of values, and of `more` beside them: a small table, kept(), from which every figure of a cell is made."""
    return kept(_sums(rows, keys, cluster, values, more))


def cluster_sums(rows: DataFrame, keys: list[str], cluster: str, values: list[str]) -> DataFrame:
    """For each cell and cluster the number of complete rows and the sums of values, and the cluster's place (j) among the k of its cell."""
    return _placed(_sums(rows, keys, cluster, values), keys, cluster)


def bootstrap(rows: DataFrame, keys: list[str], cluster: str, values: list[str], draws: int = 10_000, salt: str = "boot") -> DataFrame:
    """(keys, b, values): means of values when clusters are drawn with replacement, `draws` times for each cell.

    Rows become one sum for each cluster before any draw. Draw b takes as its s-th cluster number
    floor(k * hash('b:s')), which needs no generator state and is the same in every run, and the same
    in all cells of k clusters: how often each is drawn is found once for each k, then joined.
    """
    return _drawn(_sums(rows, keys, cluster, values), keys, cluster, values, draws, salt)


def _drawn(table: DataFrame, keys: list[str], cluster: str, values: list[str], draws: int, salt: str) -> DataFrame:
    """bootstrap() from the clusters' sums."""
    sums = _placed(table, keys, cluster)
    drawn = sums.select("k").distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("s", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int"))))
    place = F.floor(F.col("k") * hash_unit(F.concat_ws(":", "b", "s"), salt)).cast("int")
    times = drawn.groupBy("k", "b", place.alias("j")).agg(F.count("*").alias("times"))
    taken = sums.drop(cluster).join(times, ["k", "j"])
    means = [(F.sum(F.col(v) * F.col("times")) / F.sum(F.col("size") * F.col("times"))).alias(v) for v in values]
    return taken.groupBy(*keys, "b").agg(*means)


def interval(boot: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """(keys, lo, hi) of bootstrapped means."""
    tail = (1 - level) / 2
    return boot.groupBy(*keys).agg(F.percentile(value, F.lit(tail)).alias("lo"), F.percentile(value, F.lit(1 - tail)).alias("hi"))


def directional_p(kind: str, value: Column, margin: float = 0.0) -> Column:
    """The one-sided bootstrap p of a claim about a difference, smoothed by one; an aggregate over draws."""
    number = F.count(value) + 1
    below = F.count_if(value <= (0.0 if kind == "superiority" else -margin))
    if kind in ("superiority", "noninferiority"):
        return (below + 1) / number
    if kind == "equivalence":
        return (F.greatest(below, F.count_if(value >= margin)) + 1) / number
    raise ValueError(f"unknown kind of test: {kind}")


def two_sided_p(value: Column) -> Column:
    """Twice the smoothed share of draws on the other side of zero, 1 at most."""
    return F.least(F.lit(1.0), 2 * (F.least(F.count_if(value <= 0), F.count_if(value >= 0)) + 1) / (F.count(value) + 1))


def adjusted(tests: DataFrame, p: str, family: list[str], tie: str) -> DataFrame:
    """tests with holm and bh, the Holm and Benjamini-Hochberg adjustments of p within each family.

    Tests are range-partitioned by family and p, so a large family lies in many pieces: ranks and
    running extremes are those of a piece after what its neighbours sum up to. Both extremes run
    over growing frames; a frame that shrinks towards the end would be read anew for each row.
    """
    known = F.col(p).isNotNull()
    placed = kept(tests.repartitionByRange(*family, p, tie).withColumn("_piece", F.spark_partition_id()))
    earlier = Window.partitionBy(*family).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*family).orderBy(F.col("_piece").desc()).rowsBetween(Window.unboundedPreceding, -1)

    def beside(rows: DataFrame, pieces: DataFrame) -> DataFrame:
        """rows with the columns of pieces(*family, _piece, ...)."""
        named = pieces.withColumnsRenamed({c: f"_of_{c}" for c in [*family, "_piece"]})
        same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in family]
        return rows.join(named, [*same, F.col("_piece") == F.col("_of__piece")]).drop(*[f"_of_{c}" for c in [*family, "_piece"]])

    counts = placed.groupBy(*family, "_piece").agg(F.count(p).alias("_n"))
    counts = counts.select(*family, "_piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_ahead"), F.sum("_n").over(Window.partitionBy(*family)).alias("_m"))
    inside = Window.partitionBy(*family, "_piece", known)
    ranked = beside(placed.withColumn("_inside", F.row_number().over(inside.orderBy(p, tie))), counts).withColumn("_rank", F.col("_ahead") + F.col("_inside"))
    steps = kept(ranked.withColumn("_holm", F.when(known, F.least(F.lit(1.0), (F.col("_m") - F.col("_rank") + 1) * F.col(p)))).withColumn("_bh", F.when(known, F.least(F.lit(1.0), F.col(p) * F.col("_m") / F.col("_rank")))))
    ends = steps.groupBy(*family, "_piece").agg(F.max("_holm").alias("_most"), F.min("_bh").alias("_least"))
    ends = ends.select(*family, "_piece", F.max("_most").over(earlier).alias("_most"), F.min("_least").over(later).alias("_least"))
    up, down = (inside.orderBy(x).rowsBetween(Window.unboundedPreceding, 0) for x in (F.col("_rank"), F.col("_rank").desc()))
    done = beside(steps.withColumn("_holm", F.max("_holm").over(up)).withColumn("_bh", F.min("_bh").over(down)), ends)
    done = done.withColumn("holm", F.when(known, F.greatest("_holm", "_most"))).withColumn("bh", F.when(known, F.least("_bh", "_least")))
    return done.select(*tests.columns, "holm", "bh")


def retention(weak: Column, strong: Column, weak_full: Column, strong_full: Column) -> Column:
    """The share of a reader upgrade that compression leaves; NULL where full contexts don't differ."""
    gap = strong_full - weak_full
    return F.when(F.abs(gap) >= 1e-9, (strong - weak) / gap)


def cr1(rows: DataFrame, keys: list[str], cluster: str, value: str) -> DataFrame:
    """(keys, mean, se, clusters, n): a mean with its cluster-robust standard error."""
    sums = rows.where(F.col(value).isNotNull()).groupBy(*keys, cluster).agg(F.sum(value).alias("s"), F.count("*").alias("m"))
    totals = sums.groupBy(*keys).agg(F.count("*").alias("g"), F.sum("s").alias("t"), F.sum("m").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("m")).alias("sm"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    mean = F.col("t") / F.col("n")
    square = F.col("ss") - 2 * mean * F.col("sm") + mean * mean * F.col("mm")
    se = F.when(F.col("g") > 1, F.sqrt(F.greatest(F.col("g") / (F.col("g") - 1) * square, F.lit(0.0))) / F.col("n"))
    return totals.select(*keys, mean.alias("mean"), se.alias("se"), F.col("g").alias("clusters"), "n")


def sign_flips(rows: DataFrame, keys: list[str], cluster: str, value: str, most: int = 20, draws: int = 20_000) -> DataFrame:
    """(keys, x, flipped): sums over clusters under every choice of signs if there are few clusters, else under keyed draws."""
    sums = cluster_sums(rows, keys, cluster, [value])
    cells = sums.select(*keys, "k").distinct()
    number = F.when(F.col("k") <= most, F.pow(F.lit(2), F.col("k"))).otherwise(F.lit(draws)).cast("int")
    choices = cells.withColumn("x", F.explode(F.sequence(F.lit(0), number - 1)))
    bit = F.when(F.col("k") <= most, F.expr("getbit(cast(x AS bigint), cast(least(j, 62) AS int))")).otherwise((hash_unit(F.concat_ws(":", "x", "j"), "flip") < 0.5).cast("int"))
    signed = choices.join(sums.drop("k"), keys).withColumn("v", F.col(value) * (1 - 2 * bit))
    return signed.groupBy(*keys, "x").agg(F.sum("v").alias("flipped"))


def spearman(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, rho): rank correlation with average ranks; NULL if either side is constant."""
    cell = Window.partitionBy(*keys)

    def rank(c: str) -> Column:
        return F.rank().over(cell.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2.0

    return rows.withColumn("_a", rank(a)).withColumn("_b", rank(b)).groupBy(*keys).agg(F.when((F.stddev_pop("_a") > 0) & (F.stddev_pop("_b") > 0), F.corr("_a", "_b")).alias("rho"))


def units(salt: str, draws: int, first: int, last: int) -> np.ndarray:
    """hash_unit('b:s', salt) for draws b and places s from first to last: the numbers that bootstrap() draws with, kept for the next cell."""
    key = (salt, draws, first, last)
    if key not in _UNITS:
        if len(_UNITS) > 32:
            _UNITS.clear()
        made = [int(hashlib.sha1(f"{salt}:{b}:{s}".encode()).hexdigest()[:13], 16) for b in range(draws) for s in range(first, last)]
        _UNITS[key] = (np.array(made, dtype=np.float64) / float(16**13)).reshape(draws, last - first)
    return _UNITS[key]


_UNITS: dict[tuple, np.ndarray] = {}


def drawn_means(sizes: np.ndarray, sums: np.ndarray, draws: int, salt: str) -> np.ndarray:
    """[draws, values] means of clusters drawn with replacement; sums has a row for each cluster."""
    k = len(sizes)
    total, number = np.zeros((draws, sums.shape[1])), np.zeros(draws)
    for first in range(0, k, _STEP):
        last = min(first + _STEP, k)
        at = np.floor(k * units(salt, draws, first, first + _STEP)[:, : last - first]).astype(np.int64)
        number += sizes[at].sum(axis=1)
        for v in range(sums.shape[1]):
            total[:, v] += sums[at, v].sum(axis=1)
    return total / number[:, None]


def _per_cell(cells: DataFrame, keys: list[str], schema: str, figures: Callable[[dict], dict | None]) -> DataFrame:
    """keys and figures(row) of each row of cells; rows for which there is None are left out."""
    kinds = dict(cells.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + schema
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                found = [(row, figures(row)) for row in batch.slice(at, 64).to_pylist()]
                yield pa.RecordBatch.from_pylist([{**{k: r[k] for k in keys}, **f} for r, f in found if f is not None], schema=kind)

    return cells.mapInArrow(run, schema)


def cell_vectors(sums: DataFrame, keys: list[str], cluster: str, values: list[str], gathered: int = GATHERED) -> tuple[DataFrame, DataFrame | None]:
    """(cells, large) of a cluster_table(): clusters of each cell as one list of (cluster, size, sums), in order; and the clusters of cells that have more than `gathered`, None without such."""
    numbers = sums.groupBy(*keys).agg(F.count("*").alias("k"))
    listed, large = sums, None
    if (numbers.agg(F.max("k")).first()[0] or 0) > gathered:
        large = sums.join(numbers.where(F.col("k") > gathered).drop("k"), keys, "left_semi")
        listed = sums.join(numbers.where(F.col("k") <= gathered).drop("k"), keys, "left_semi")
    each = F.array_sort(F.collect_list(F.struct(F.col(cluster).alias("c"), "size", *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])))
    return listed.groupBy(*keys).agg(each.alias("clusters")), large


def _arrays(row: dict, values: int) -> tuple[np.ndarray, np.ndarray]:
    clusters = row["clusters"]
    return np.array([c["size"] for c in clusters], dtype=float), np.array([[c[f"v{i}"] for i in range(values)] for c in clusters], dtype=float).reshape(len(clusters), values)


def bootstrapped(rows: DataFrame, keys: list[str], cluster: str, values: list[str], schema: str, figures: Callable[[np.ndarray, np.ndarray], dict | None], draws: int = 10_000, salt: str = "boot", gathered: int = GATHERED) -> DataFrame:
    """keys and figures(means, drawn) of each cell, in the columns of schema: means of values over its rows, and [draws, values] means when clusters are drawn with replacement.

    The draws are those of bootstrap(). All values of a cell have the same draws, so figures may be
    any function of several means. rows are read once; a cell's clusters become one short list, and nothing
    but these lists moves; cells of more than `gathered` clusters are drawn by joins instead, with equal results.
    """
    return bootstrapped_sums(cluster_table(rows, keys, cluster, values), keys, cluster, values, schema, figures, draws, salt, gathered)


def bootstrapped_sums(sums: DataFrame, keys: list[str], cluster: str, values: list[str], schema: str, figures: Callable[[np.ndarray, np.ndarray], dict | None], draws: int = 10_000, salt: str = "boot", gathered: int = GATHERED) -> DataFrame:
    """bootstrapped() from a cluster_table()."""
    cells, large = cell_vectors(sums, keys, cluster, values, gathered)

    def of(row: dict) -> dict | None:
        sizes, sums = _arrays(row, len(values))
        return figures(sums.sum(axis=0) / sizes.sum(), drawn_means(sizes, sums, draws, salt))

    out = _per_cell(cells, keys, schema, of)
    if large is None:
        return out
    boot = _drawn(large, keys, cluster, values, draws, salt)
    boot = boot.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("b", *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)]))).alias("drawn"))
    both = boot.join(large.groupBy(*keys).agg(F.array(*[F.sum(v) / F.sum("size") for v in values]).alias("means")), keys)
    joint = lambda row: figures(np.array(row["means"]), np.array([[d[f"v{i}"] for i in range(len(values))] for d in row["drawn"]]))
    return out.union(_per_cell(both, keys, schema, joint))


def quantiles(drawn: np.ndarray, level: float = 0.95) -> tuple[float | None, float | None]:
    """The ends of an interval of finite draws; None without any."""
    finite = drawn[np.isfinite(drawn)]
    return tuple(float(x) for x in np.quantile(finite, [(1 - level) / 2, (1 + level) / 2])) if len(finite) else (None, None)


def one_sided(drawn: np.ndarray, kind: str, margin: float = 0.0) -> float | None:
    """directional_p() of drawn differences, those that aren't finite left out; None without any."""
    finite = drawn[np.isfinite(drawn)]
    below = int((finite <= (0.0 if kind == "superiority" else -margin)).sum())
    if kind == "equivalence":
        below = max(below, int((finite >= margin).sum()))
    elif kind not in ("superiority", "noninferiority"):
        raise ValueError(f"unknown kind of test: {kind}")
    return (below + 1) / (len(finite) + 1) if len(finite) else None


def two_sided(drawn: np.ndarray) -> float | None:
    """two_sided_p() of drawn differences."""
    finite = drawn[np.isfinite(drawn)]
    return min(1.0, 2 * (min(int((finite <= 0).sum()), int((finite >= 0).sum())) + 1) / (len(finite) + 1)) if len(finite) else None


def retentions(means: np.ndarray) -> np.ndarray:
    """retention() of rows (weak, strong, weak in full, strong in full); NaN where full contexts don't differ."""
    weak, strong, weak_full, strong_full = (means[..., i] for i in range(4))
    gap = strong_full - weak_full
    return np.where(np.abs(gap) >= 1e-9, (strong - weak) / np.where(np.abs(gap) >= 1e-9, gap, 1.0), np.nan)


#: Clusters up to which every choice of signs is taken, and draws beyond.
EXACT, SIGN_DRAWS = 20, 20_000


def signed_sums(e: np.ndarray, salt: str = "flip") -> np.ndarray:
    """Sums of e under every choice of signs if there are few, each made from the one before it by doubling; else under keyed draws."""
    if len(e) <= EXACT:
        out = np.zeros(1)
        for x in e:
            out = np.concatenate([out + x, out - x])
        return out
    out = np.zeros(SIGN_DRAWS)
    for first in range(0, len(e), _STEP):
        part = e[first : first + _STEP]
        flips = units(salt, SIGN_DRAWS, first, first + _STEP)[:, : len(part)] < 0.5
        out += np.where(flips, -part, part).sum(axis=1)
    return out


#: Standard normal points of the least detectable effect: one-sided 5 %, power 80 %.
_Z_ALPHA, _Z_POWER = 1.6448536269514722, 0.8416212335729143


def wild(rows: DataFrame, keys: list[str], cluster: str, value: str, margin: float = 0.0, gathered: int = GATHERED) -> DataFrame:
    """keys, mean, clusters, lo, hi, above_p, equal_p, se, mde of each cell with two or more clusters.

    lo and hi: wild cluster bootstrap, the cluster residuals times every choice of signs. above_p: the
    one-sided sign-flip p of a mean at -margin or below; equal_p: the larger one of both sides of the
    margin. se: cluster-robust; mde: the least difference found with a power of 80 %. One pass a cell
    in memory that doubles up to EXACT clusters and stays there; a cell's clusters must fit in one row.
    """
    cells, large = cell_vectors(cluster_table(rows, keys, cluster, [value]), keys, cluster, [value], gathered)
    if large is not None:
        raise ValueError(f"cells of more than {gathered} clusters have no sign flips")

    def of(row: dict) -> dict | None:
        sizes, sums = _arrays(row, 1)
        s, n = sums[:, 0], sizes.sum()
        if len(s) < 2:
            return None
        mean = s.sum() / n
        residual = s - sizes * mean
        lo, hi = np.quantile(mean + signed_sums(residual) / n, [0.025, 0.975])

        def p(edge: float, above: bool) -> float:
            e = s - sizes * edge
            flipped, seen = signed_sums(e), e.sum()
            return float((flipped >= seen - 1e-12).mean() if above else (flipped <= seen + 1e-12).mean())

        se = float(np.sqrt(len(s) / (len(s) - 1) * (residual**2).sum()) / n)
        above = p(-margin, True)
        return {"mean": float(mean), "clusters": len(s), "lo": float(lo), "hi": float(hi), "above_p": above, "equal_p": max(above, p(margin, False)), "se": se, "mde": (_Z_ALPHA + _Z_POWER) * se}

    return _per_cell(cells, keys, "mean double, clusters int, lo double, hi double, above_p double, equal_p double, se double, mde double", of)


def at_equal(points: DataFrame, keys: list[str], arm: str, x: str, y: str, reference: str) -> DataFrame:
    """(keys, arm, target, value, extrapolated): y of each arm where x is what each point of the reference arm has.

    Between an arm's points next to the target the value is interpolated on the logarithm of x, as a
    backward and a forward as-of join give them; beyond its ends the line through the last two goes on
    and extrapolated is set. Arms of one point, and points at one x (their mean counts), are defined:
    one point gives its own value. points has few rows, one for each cell.
    """
    points = kept(points)
    known = points.where(f"{x} > 0 AND {y} IS NOT NULL").groupBy(*keys, arm, x).agg(F.avg(y).alias("_y")).select(*keys, arm, F.log(x).alias("_x"), "_y")
    own = F.array_sort(F.collect_list(F.struct("_x", "_y")))
    lines = known.groupBy(*keys, arm).agg(own.alias("_line"))
    targets = points.where((F.col(arm) == reference) & (F.col(x) > 0)).select(*keys, F.col(x).alias("target")).distinct()
    met = lines.join(targets, keys).withColumn("_t", F.log("target"))
    below = F.size(F.filter("_line", lambda p: p["_x"] <= F.col("_t")))
    n = F.size("_line")
    left = F.greatest(F.lit(1), F.least(below, n - 1))
    placed = met.withColumn("_n", n).withColumn("_a", F.element_at("_line", left)).withColumn("_b", F.element_at("_line", F.least(left + 1, n)))
    share = (F.col("_t") - F.col("_a._x")) / (F.col("_b._x") - F.col("_a._x"))
    value = F.when(F.col("_n") == 1, F.col("_a._y")).otherwise(F.col("_a._y") + share * (F.col("_b._y") - F.col("_a._y")))
    outside = (F.col("_t") < F.element_at("_line", 1)["_x"] - 1e-12) | (F.col("_t") > F.element_at("_line", -1)["_x"] + 1e-12)
    return placed.select(*keys, arm, "target", value.alias("value"), outside.alias("extrapolated"))

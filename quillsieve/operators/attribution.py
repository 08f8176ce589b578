"""Utility attribution: which chunks an answer depends on, from masked contexts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsieve.functions.hashing import hash_unit

KEEP_RATES = (0.5, 0.25)
ALPHAS = (0.1, 0.3, 1.0, 3.0, 10.0)
FOLDS = 5


def num_masks(chunks: Column, least: int = 64, per_chunk: float = 1.0, most: int = 256) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), F.ceil((chunks + 1) * per_chunk))).cast("int")


def random_masks(doc_id: Column, chunks: Column, number: Column, rates: tuple = KEEP_RATES) -> Column:
    """A list of masks: bit c of mask k is set if hash('doc:k:c') is below a rate that cycles.

    A mask that keeps nothing gets one chunk, one that keeps all of several loses one, by the hash 'doc:k'.
    """
    rate = F.array(*[F.lit(r) for r in rates])

    def mask(k: Column) -> Column:
        bits = F.transform(
            F.sequence(F.lit(0), chunks - 1),
            lambda c: hash_unit(F.concat_ws(":", doc_id.cast("string"), k.cast("string"), c.cast("string")), "mask") < F.element_at(rate, (k % len(rates) + 1).cast("int")),
        )
        pick = F.floor(hash_unit(F.concat_ws(":", doc_id.cast("string"), k.cast("string")), "flip") * chunks).cast("int")

        def mended(b: Column) -> Column:
            wrong = ~F.exists(b, lambda x: x) | ((chunks > 1) & F.forall(b, lambda x: x))
            return F.when(wrong, F.transform(b, lambda x, c: F.when(c == pick, ~x).otherwise(x))).otherwise(b)

        return F.element_at(F.transform(F.array(bits), mended), 1)

    return F.transform(F.sequence(F.lit(0), number - 1), mask)


def loo_masks(chunks: Column) -> Column:
    """Each mask leaves one chunk out; a single chunk gives the empty mask."""
    places = F.sequence(F.lit(0), chunks - 1)
    return F.transform(places, lambda i: F.transform(places, lambda j: j != i))


def is_loo(masks: Column) -> Column:
    n = F.size(masks)
    return (n > 0) & (n == F.size(F.element_at(masks, 1))) & F.forall(F.transform(masks, lambda m, i: F.forall(F.transform(m, lambda b, j: b == (i != j)), lambda x: x)), lambda x: x)


def subsampled(outcomes: DataFrame, n: int, seed: int) -> DataFrame:
    """n mask rows of each document by hash of (seed, document, mask), in their own order; fewer stay as they are."""
    order = Window.partitionBy("doc_id").orderBy(hash_unit(F.concat_ws(":", F.lit(seed), "doc_id", "k"), "subsample"), "k")
    return outcomes.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def loo_utilities(outcomes: Column, full: Column) -> Column:
    """What leaving each chunk out costs."""
    return F.transform(outcomes, lambda y: full - y)


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def zscore(values: Column) -> Column:
    """(z, informative) within a document, by the population deviation; constant utilities give zeros."""

    def of(m: Column) -> Column:
        deviation = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(values))

        def scaled(sd: Column) -> Column:
            flat = sd < 1e-12
            z = F.transform(values, lambda x: F.when(flat, F.lit(0.0)).otherwise((x - m) / sd))
            return F.named_struct(F.lit("z"), z, F.lit("informative"), ~flat)

        return F.element_at(F.transform(F.array(deviation), scaled), 1)

    return F.element_at(F.transform(F.array(mean_of(values)), of), 1)


def gold_ranks(order: Column, gold: Column) -> tuple[Column, Column]:
    """Recall of gold among the first |gold| of a ranking, and the reciprocal rank of the best; NULL without gold."""
    first = F.slice(order, F.lit(1), F.size(gold))
    some = F.size(gold) > 0
    recall = F.size(F.array_intersect(gold, first)) / F.size(gold)
    best = F.array_min(F.transform(gold, lambda g: F.array_position(order, g)))
    return F.when(some, recall), F.when(some, 1.0 / best)


def position_bin(place: Column, chunks: Column, bins: int = 10) -> Column:
    return F.least(F.lit(bins - 1), F.floor(bins * place / F.greatest(F.lit(1), chunks))).cast("int")


def position_prior(labels: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, prior, n): mean z by relative place, over informative documents; empty bins 0."""
    chunks = labels.where("informative").select(F.size("z").alias("n"), F.posexplode("z").alias("i", "zi"))
    means = chunks.groupBy(position_bin(F.col("i"), F.col("n"), bins).alias("bin")).agg(F.avg("zi").alias("prior"), F.count("*").alias("n"))
    every = labels.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(means, "bin", "left").na.fill({"prior": 0.0, "n": 0})


def ensemble(labels: DataFrame) -> DataFrame:
    """(doc_id, z, informative, full_f1) from labels(doc_id, reader, z, informative, full_f1): mean z of informative readers, scaled anew."""
    long = labels.where("informative").select("doc_id", F.posexplode("z").alias("i", "zi"))
    means = long.groupBy("doc_id", "i").agg(F.avg("zi").alias("m"), F.count("*").alias("readers"))
    lists = means.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.named_struct(F.lit("i"), F.col("i"), F.lit("m"), F.col("m")))).alias("s"))
    scaled = lists.select("doc_id", zscore(F.transform("s", lambda x: x["m"])).alias("s"))
    full = labels.groupBy("doc_id").agg(F.avg("full_f1").alias("full_f1"), F.count_distinct(F.size("z")).alias("lengths"))
    checked = full.where(F.assert_true(F.col("lengths") == 1, F.lit("readers disagree on the number of chunks")).isNull())
    return scaled.join(checked, "doc_id").select("doc_id", "s.z", "s.informative", "full_f1")


def design(masks: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(masks), 1)), masks.astype(float)])


def ridge(x: np.ndarray, y: np.ndarray, alpha: float | np.ndarray) -> np.ndarray:
    """Least squares with a penalty on all but the first column; of equal solutions the shortest."""
    penalty = np.diag(np.broadcast_to(np.asarray(alpha, dtype=float), (x.shape[1],)).copy())
    penalty[0, 0] = 0.0
    return np.linalg.pinv(x.T @ x + penalty, hermitian=True) @ (x.T @ y)


@lru_cache(maxsize=1024)
def fold_of(n: int, seed: int = 0) -> np.ndarray:
    """A fold for each mask by hash, as even as can be; kept, as it depends on their number alone."""
    order = sorted(range(n), key=lambda k: hashlib.sha1(f"fold:{seed}:{k}".encode()).hexdigest())
    folds = np.zeros(n, dtype=int)
    folds[order] = np.arange(n) * min(FOLDS, n) // max(n, 1)
    folds.setflags(write=False)
    return folds


def cv_errors(masks: np.ndarray, y: np.ndarray, alpha: float, seed: int = 0) -> tuple[float, float]:
    """(mean squared error, R2) of held-out predictions; NaN below four masks, R2 NaN for constant outcomes."""
    if len(y) < 4:
        return float("nan"), float("nan")
    x, folds, said = design(masks), fold_of(len(y), seed), np.zeros(len(y))
    for f in range(folds.max() + 1):
        out = folds == f
        said[out] = x[out] @ ridge(x[~out], y[~out], alpha)
    error = float(((said - y) ** 2).sum())
    spread = float(((y - y.mean()) ** 2).sum())
    return error / len(y), 1 - error / spread if spread > 0 else float("nan")


#: Numbers of a stack of documents that are solved at once.
STACK = 1 << 18


def shaped(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, masks [rows, masks, chunks], y [rows, masks]) of each shape of document in a batch with lists masks and y, in stacks of bounded size. Documents without masks are left out."""
    column, outcomes = batch.column("masks"), batch.column("y")
    inner = column.values
    ends, starts = column.offsets.to_numpy(), inner.offsets.to_numpy()
    bits, y, of_y = inner.values.to_numpy(zero_copy_only=False), outcomes.values.to_numpy(zero_copy_only=False), outcomes.offsets.to_numpy()
    n = np.diff(ends)
    if (n != np.diff(of_y)).any():
        raise ValueError("a document has not as many outcomes as masks")
    own = np.flatnonzero(n > 0)
    c = np.diff(starts)[ends[:-1][own]] if len(own) else n[own]
    if (starts[ends[1:][own]] - starts[ends[:-1][own]] != n[own] * c).any():
        raise ValueError("masks of a document are of different lengths")
    shapes, which = np.unique(np.stack([n[own], c], axis=1), axis=0, return_inverse=True)
    for k, (masks, chunks) in enumerate(shapes):
        every = own[which.reshape(-1) == k]
        step = max(1, STACK // max(1, int(masks * chunks)))
        for at in range(0, len(every), step):
            rows = every[at : at + step]
            x = bits[(starts[ends[:-1][rows]])[:, None] + np.arange(masks * chunks)].astype(float).reshape(len(rows), masks, chunks)
            yield rows, x, y[of_y[:-1][rows][:, None] + np.arange(masks)].astype(float)


def _solved(gram: np.ndarray, right: np.ndarray, penalties: np.ndarray) -> np.ndarray:
    """Coefficients [penalties, fits, columns] of normal equations gram [fits, columns, columns], right [fits, columns]; penalties [penalties, columns] above 0 but for the first column."""
    out = np.empty((len(penalties), *right.shape))
    for a, own in enumerate(penalties):
        out[a] = np.linalg.solve(gram + np.diag(own), right[:, :, None])[:, :, 0]
    return out


def _with_one(x: np.ndarray, penalties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.ones((*x.shape[:2], 1)), x], axis=2), np.hstack([np.zeros((len(penalties), 1)), penalties])


def ridge_fits(x: np.ndarray, y: np.ndarray, penalties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(intercepts [penalties, fits], coefficients [penalties, fits, columns]) of many fits of one shape: x [fits, rows, columns], y [fits, rows], penalties [penalties, columns] above 0."""
    x, penalties = _with_one(x, penalties)
    turned = x.transpose(0, 2, 1)
    w = _solved(turned @ x, (turned @ y[:, :, None])[:, :, 0], penalties)
    return w[:, :, 0], w[:, :, 1:]


def held_out_fits(x: np.ndarray, y: np.ndarray, penalties: np.ndarray, seed: int = 0) -> np.ndarray:
    """Predictions [penalties, fits, rows] of each row by fits on the other folds, as ridge_fits()."""
    x, penalties = _with_one(x, penalties)
    turned = x.transpose(0, 2, 1)
    gram, right = turned @ x, (turned @ y[:, :, None])[:, :, 0]
    folds, said = fold_of(x.shape[1], seed), np.empty((len(penalties), *y.shape))
    for f in range(folds.max() + 1):
        at = np.flatnonzero(folds == f)
        out = x[:, at]
        back = out.transpose(0, 2, 1)
        w = _solved(gram - back @ out, right - (back @ y[:, at, None])[:, :, 0], penalties)
        said[:, :, at] = np.einsum("bkq,abq->abk", out, w)
    return said


def fit_ridge(outcomes: DataFrame, alpha: float) -> DataFrame:
    """(doc_id, intercept, beta, cv_mse, cv_r2, residual) of outcomes(doc_id, mask, y), a row for each mask.

    residual is the largest violation of the normal equations, a certificate of the fit.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        masks, y = np.array(rows["mask"].tolist(), dtype=float), rows["y"].to_numpy(dtype=float)
        x = design(masks)
        beta = ridge(x, y, alpha)
        penalty = alpha * np.r_[0.0, beta[1:]]
        mse, r2 = cv_errors(masks, y, alpha)
        return pd.DataFrame([{"doc_id": rows["doc_id"].iloc[0], "intercept": beta[0], "beta": beta[1:].tolist(), "cv_mse": mse, "cv_r2": r2, "residual": float(np.abs(x.T @ (y - x @ beta) - penalty).max())}])

    kind = dict(outcomes.dtypes)["doc_id"]
    return outcomes.groupBy("doc_id").applyInPandas(fit, f"doc_id {kind}, intercept double, beta array<double>, cv_mse double, cv_r2 double, residual double")


def select_alpha(outcomes: DataFrame, grid: tuple = ALPHAS) -> DataFrame:
    """(alpha, cv_mse), least error first, smaller alpha first on ties, over documents whose outcomes vary."""
    lists = outcomes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "mask", "y"))).alias("x"))
    return select_alpha_of(lists.select(F.col("x.mask").alias("masks"), F.col("x.y").alias("y")), grid)


def select_alpha_of(measured: DataFrame, grid: tuple = ALPHAS) -> DataFrame:
    """select_alpha() of measured(masks, y), a row for each document: no mask is shuffled."""

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, masks, y in shaped(batch):
                fit = np.flatnonzero(np.var(y, axis=1) > 0) if y.shape[1] >= 4 else []
                if len(fit):
                    said = held_out_fits(masks[fit], y[fit], np.array([[a] * masks.shape[2] for a in grid]))
                    mse = ((said - y[fit]) ** 2).mean(axis=2)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(grid, dtype=float), len(fit))), pa.array(mse.reshape(-1))], names=["alpha", "mse"])

    each = measured.select("masks", "y").mapInArrow(errors, "alpha double, mse double")
    return each.groupBy("alpha").agg(F.avg("mse").alias("cv_mse")).orderBy("cv_mse", "alpha")


def bootstrap_beta(masks: np.ndarray, y: np.ndarray, alpha: float, draws: int = 200, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """2.5 and 97.5 percent points of coefficients when masks are drawn with replacement."""
    rng = np.random.default_rng(seed)
    x = design(masks)
    fits = np.stack([ridge(x[at], y[at], alpha) for at in rng.integers(0, len(y), (draws, len(y)))])
    return np.quantile(fits, 0.025, axis=0), np.quantile(fits, 0.975, axis=0)


def interactions(masks: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """Masks with a column for each pair of chunks kept together."""
    return np.hstack([masks, *[(masks[:, i] * masks[:, j])[:, None] for i, j in pairs]]) if pairs else masks


def ndcg(order: Column, gains: Column, k: int) -> Column:
    """NDCG at k of a ranking; gains below zero count as zero, without gains NULL."""
    clipped = F.transform(gains, lambda g: F.greatest(g, F.lit(0.0)))
    discounted = lambda xs: F.aggregate(F.transform(F.slice(xs, 1, k), lambda g, i: g * F.log(F.lit(2.0)) / F.log(i + 2.0)), F.lit(0.0), lambda s, x: s + x)
    ideal = discounted(F.reverse(F.array_sort(clipped)))
    got = discounted(F.transform(order, lambda i: F.element_at(clipped, i + 1)))
    return F.when(ideal > 0, got / ideal)


def top_share_recall(order: Column, gold: Column, share: float = 0.25) -> Column:
    """Recall of gold in the first max(1, round(share * chunks)) of a ranking, halves to even."""
    first = F.slice(order, F.lit(1), F.greatest(F.lit(1), F.bround(F.size(order) * share, 0).cast("int")))
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(gold, first)) / F.size(gold))

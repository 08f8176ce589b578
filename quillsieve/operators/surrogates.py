"""Surrogates of masked outcomes beyond the additive one: pair interactions, and refits on fewer calls.

Fits are ridge regressions. Those of all pairs are in dual form: a document's masks enter only
through their Gram matrix, and a penalty by column is a weight of its kernel. Masks are 0 or 1, so
with s kept chunks in common two masks have s(s-1)/2 kept pairs in common, and all pairs of a
document need no columns of their own. Those with a column for each chunk are solved by their
normal equations, documents of one shape at once. A document's masks stand in one row: nothing is
shuffled but per-document figures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillsieve.functions.hashing import hash_unit
from quillsieve.operators.attribution import fold_of, held_out_fits, ridge_fits, shaped
from quillsieve.operators.statistics import kept

#: Penalties tried for main effects and for interactions.
MAIN_GRID = (0.1, 0.3, 1.0, 3.0, 10.0)
PAIR_GRID = (0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0)
MODELS = ("additive", "gold_pairs", "top2_pair", "all_pairs")
#: Numbers of calls of the refits, and draws of each.
CALLS, DRAWS = (8, 16, 32, 48), 5
#: Outcomes that differ less are equal.
FLAT = 1e-9
#: Columns up to which all pairs are fitted with columns of their own.
COLUMNS = 48


def pair_kernel(masks: np.ndarray) -> np.ndarray:
    """How many pairs of chunks each two masks both keep."""
    s = masks @ masks.T
    return s * (s - 1) / 2


def dual(kernel: np.ndarray, y: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, predictions): ridge with a free intercept on the training rows, predictions for all rows of the kernel."""
    own = kernel[np.ix_(train, train)]
    center = own.mean(axis=0)
    inner = own - center[None, :] - center[:, None] + center.mean()
    weights = np.linalg.solve(inner + np.eye(len(train)), y[train] - y[train].mean())
    # The weights sum to zero, so a row's own mean needs no taking off.
    across = kernel[:, train] - center[None, :]
    return weights, y[train].mean() + across @ weights


def duals(own: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, centers, means) of many fits of one size at once: own is [fits, n, n], y [fits, n]."""
    center = own.mean(axis=1)
    inner = own - center[:, None, :] - center[:, :, None] + center.mean(axis=1)[:, None, None]
    means = y.mean(axis=1)
    weights = np.linalg.solve(inner + np.eye(own.shape[1]), (y - means[:, None])[:, :, None])[:, :, 0]
    return weights, center, means


def held_out_all(kernels_of: Callable[[np.ndarray], np.ndarray], y: np.ndarray, seed: int = 0) -> np.ndarray:
    """held_out() for many kernels of one size at once: kernels_of(train) is [fits, n, n], y [fits, n] or, if shared, [n]."""
    n = y.shape[-1]
    folds, said = fold_of(n, seed), None
    for f in range(folds.max() + 1):
        train, out = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
        kernel = kernels_of(train)
        if said is None:
            y = np.broadcast_to(y, (len(kernel), n))
            said = np.zeros(y.shape)
        weights, center, means = duals(kernel[:, train[:, None], train[None, :]], y[:, train])
        across = kernel[:, out[:, None], train[None, :]] - center[:, None, :]
        said[:, out] = means[:, None] + (across @ weights[:, :, None])[:, :, 0]
    return said


def betas(masks: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients of the additive surrogate."""
    weights, _ = dual(masks @ masks.T / alpha, y, np.arange(len(y)))
    return masks.T @ weights / alpha


def held_out(kernel_of: Callable[[np.ndarray], np.ndarray], y: np.ndarray, seed: int = 0) -> np.ndarray:
    """Predictions of each row by fits on the other folds; the kernel may depend on the training rows."""
    folds, said = fold_of(len(y), seed), np.zeros(len(y))
    for f in range(folds.max() + 1):
        train, out = np.flatnonzero(folds != f), folds == f
        said[out] = dual(kernel_of(train), y, train)[1][out]
    return said


def kernels(masks: np.ndarray, y: np.ndarray, gold: list[int], alpha: float) -> dict[str, Callable[[float], Callable[[np.ndarray], np.ndarray]]]:
    """For each model, by the penalty of its interactions, the kernel of a training set. The best two chunks are chosen inside the training set."""
    plain = masks @ masks.T
    main = plain / alpha
    every = pair_kernel(masks)
    held = masks[:, sorted(set(gold))]
    first: dict[bytes, np.ndarray] = {}

    def best(train: np.ndarray) -> np.ndarray:
        """The kernel of the pair with the largest coefficients, found once for each training set."""
        if train.tobytes() not in first:
            weights, _ = dual(main, y, train)
            order = np.argsort(-np.round(masks[train].T @ weights / alpha, 12), kind="stable")[:2]
            both = masks[:, order].prod(axis=1) if len(order) == 2 else np.zeros(len(y))
            first[train.tobytes()] = np.outer(both, both)
        return first[train.tobytes()]

    out = {
        "additive": lambda a: lambda train: plain / a,
        "top2_pair": lambda a: lambda train: main + best(train) / a,
        "all_pairs": lambda a: lambda train: main + every / a,
    }
    if held.shape[1] >= 2:
        out["gold_pairs"] = lambda a: lambda train: main + pair_kernel(held) / a
    return out


def _listed(measured: DataFrame, schema: str, each: Callable[[Row], Iterator[dict]]) -> DataFrame:
    """each(row) over measured(doc_id, source, masks, y, gold, answers_in), one Arrow pass and no shuffle."""
    kinds = dict(measured.dtypes)
    schema = schema.format(**kinds)
    kind = to_arrow_schema(StructType.fromDDL(schema))
    names = kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Few documents at a time: their masks become Python lists.
            for at in range(0, len(batch), 64):
                found = []
                for row in batch.slice(at, 64).to_pylist():
                    masks, y = np.array(row["masks"], dtype=float), np.round(np.array(row["y"], dtype=float), 9)
                    if len(y) and np.ptp(y) >= FLAT:
                        found += [{"doc_id": row["doc_id"], "source": row["source"], **x} for x in each(masks, y, row)]
                yield pa.RecordBatch.from_pylist([{c: x.get(c) for c in names} for x in found], schema=kind)

    return measured.select("doc_id", "source", "masks", "y", "gold", "answers_in").mapInArrow(run, schema)


def _held_out_pairs(masks: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Held-out predictions [penalties, documents, masks] of top2_pair and all_pairs, for documents of one shape. The best two chunks are chosen inside the training set."""
    d, n, c = masks.shape
    grid = np.array(PAIR_GRID)
    i, j = np.triu_indices(c, 1)
    few = c + len(i) <= COLUMNS
    plain = masks @ masks.transpose(0, 2, 1)
    every, main = plain * (plain - 1) / 2, plain / alpha
    folds, best, pairs = fold_of(n), np.zeros((len(grid), d, n)), np.zeros((len(grid), d, n))
    for f in range(folds.max() + 1):
        train, out = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
        both = np.zeros((d, n, 1))
        if c >= 2:
            _, beta = ridge_fits(masks[:, train], y[:, train], np.array([[alpha] * c]))
            order = np.argsort(-np.round(beta[0], 12), axis=1, kind="stable")[:, :2]
            both = np.take_along_axis(masks, order[:, None, :], axis=2).prod(axis=2, keepdims=True)
        x = np.concatenate([masks, both], axis=2)
        start, beta = ridge_fits(x[:, train], y[:, train], np.array([[alpha] * c + [a] for a in grid]))
        best[:, :, out] = start[:, :, None] + np.einsum("bkq,abq->abk", x[:, out], beta)
        for a, penalty in enumerate(grid if not few else ()):
            kernel = main[:, :, train] + every[:, :, train] / penalty
            weights, center, means = duals(kernel[:, train], y[:, train])
            pairs[a][:, out] = means[:, None] + ((kernel[:, out] - center[:, None, :]) @ weights[:, :, None])[:, :, 0]
    if few:
        pairs = held_out_fits(np.concatenate([masks, masks[:, :, i] * masks[:, :, j]], axis=2), y, np.array([[alpha] * c + [a] * len(i) for a in grid]))
    return best, pairs


def _golden(masks: np.ndarray, y: np.ndarray, held: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Held-out predictions of gold_pairs, as _held_out_pairs(), and mean coefficients [penalties, documents] of gold pairs and gold chunks; held [documents, gold chunks]."""
    c = masks.shape[2]
    i, j = np.triu_indices(held.shape[1], 1)
    own = np.take_along_axis(masks, held[:, None, :], axis=2)
    x = np.concatenate([masks, own[:, :, i] * own[:, :, j]], axis=2)
    penalties = np.array([[alpha] * c + [a] * len(i) for a in PAIR_GRID])
    _, beta = ridge_fits(x, y, penalties)
    return held_out_fits(x, y, penalties), beta[:, :, c:].mean(axis=2), np.take_along_axis(beta, held[None, :, :], axis=2).mean(axis=2)


def document_errors(measured: DataFrame, alpha: float) -> DataFrame:
    """(doc_id, source, model, penalty, mse, r2, gold_pair, gold_main) of each informative document, model and penalty: its held-out error and R2, and for gold_pairs the mean coefficients of gold pairs and gold chunks.

    `additive` also stands with a null penalty: the fit with alpha, which gains are measured against.
    """
    kinds = dict(measured.dtypes)
    schema = f"doc_id {kinds['doc_id']}, source string, fits array<struct<model: string, penalty: double, mse: double, r2: double, gold_pair: double, gold_main: double>>"
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("model", "penalty", "mse", "r2", "gold_pair", "gold_main")
        for batch in batches:
            gold = batch.column("gold").to_pylist()
            at, made = [], []
            for rows, masks, y in shaped(batch):
                y = np.round(y, 9)
                fit = np.flatnonzero(np.ptp(y, axis=1) >= FLAT) if y.shape[1] >= 4 else []
                if not len(fit):
                    continue
                rows, masks, y = rows[fit], masks[fit], y[fit]
                spread = ((y - y.mean(axis=1)[:, None]) ** 2).mean(axis=1)
                c = masks.shape[2]
                main = held_out_fits(masks, y, np.array([[a] * c for a in (*MAIN_GRID, alpha)]))
                best, pairs = _held_out_pairs(masks, y, alpha)
                grid = [("additive", a) for a in (*MAIN_GRID, None)] + [(m, a) for m in ("top2_pair", "all_pairs") for a in PAIR_GRID]
                mse = ((np.concatenate([main, best, pairs]) - y) ** 2).mean(axis=2)
                r2 = 1 - mse / spread
                found = [[(*g, float(e), float(r), None, None) for g, e, r in zip(grid, mse[:, k], r2[:, k], strict=True)] for k in range(len(rows))]
                held = [sorted(set(gold[row] or [])) for row in rows]
                for size in {len(x) for x in held if len(x) >= 2}:
                    own = [k for k, x in enumerate(held) if len(x) == size]
                    said, of_pairs, of_main = _golden(masks[own], y[own], np.array([held[k] for k in own]), alpha)
                    error = ((said - y[own]) ** 2).mean(axis=2)
                    for at_own, k in enumerate(own):
                        figures = [x[:, at_own].tolist() for x in (error, 1 - error / spread[own], of_pairs, of_main)]
                        found[k] += [("gold_pairs", a, *x) for a, *x in zip(PAIR_GRID, *figures, strict=True)]
                at += rows.tolist()
                made += [[dict(zip(names, x, strict=True)) for x in own] for own in found]
            left = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([left.column("doc_id").cast(kind.field(0).type), left.column("source"), pa.array(made, kind.field(2).type)], schema=kind)

    fits = measured.select("doc_id", "source", "masks", "y", "gold").mapInArrow(run, schema)
    return fits.select("doc_id", "source", F.inline("fits"))


def interaction_errors(measured: DataFrame, alpha: float) -> DataFrame:
    """(source, model, penalty, cv_mse, n): mean held-out error of each model and penalty over informative documents."""
    return _mean_errors(document_errors(measured, alpha))


def _mean_errors(errors: DataFrame) -> DataFrame:
    return errors.where("penalty IS NOT NULL").groupBy("source", "model", "penalty").agg(F.avg("mse").alias("cv_mse"), F.count("*").alias("n"))


def chosen_penalties(errors: DataFrame) -> DataFrame:
    """(source, model, penalty, cv_mse) with the least error, the smaller penalty on ties."""
    best = F.min(F.struct(F.round("cv_mse", 12).alias("e"), "penalty", "cv_mse")).alias("b")
    return errors.groupBy("source", "model").agg(best).select("source", "model", "b.penalty", "b.cv_mse")


def interaction_fits(measured: DataFrame, penalties: DataFrame, alpha: float) -> DataFrame:
    """(doc_id, source, model, r2, gain, gold_pair, gold_main) of each informative document: held-out R2, its excess over the additive fit, mean coefficients of gold pairs and gold chunks.

    penalties(source, model, penalty) has a row for each source and model, so each source's few go
    with every document as one map. A document of fewer than two gold chunks has no gold pairs.
    """
    maps = penalties.groupBy(F.col("source").alias("_s")).agg(F.map_from_entries(F.collect_list(F.struct("model", "penalty"))).alias("penalties"))
    rows = measured.join(maps, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("gold", F.struct("gold", "penalties"))

    def each(masks, y, row):
        gold, given = row["gold"]["gold"], dict(row["gold"]["penalties"])
        spread = ((y - y.mean()) ** 2).sum()
        found = {}
        for model, of in kernels(masks, y, gold, alpha).items():
            if model in given and len(y) >= 4:
                penalty = alpha if model == "additive" else given[model]
                found[model] = {"model": model, "r2": float(1 - ((held_out(of(penalty), y) - y) ** 2).sum() / spread)}
        for model, x in found.items():
            x["gain"] = x["r2"] - found["additive"]["r2"] if "additive" in found else None
            if model == "gold_pairs":
                held = sorted(set(gold))
                weights, _ = dual(kernels(masks, y, gold, alpha)["gold_pairs"](given[model])(None), y, np.arange(len(y)))
                pairs = [masks[:, i] * masks[:, j] for k, i in enumerate(held) for j in held[k + 1 :]]
                x["gold_pair"] = float(np.mean([p @ weights for p in pairs]) / given[model])
                x["gold_main"] = float(np.mean(masks[:, held].T @ weights) / alpha)
            yield x

    return _listed(rows, "doc_id {doc_id}, source string, model string, r2 double, gain double, gold_pair double, gold_main double", each)


def _chosen_fits(errors: DataFrame, penalties: DataFrame) -> DataFrame:
    """What interaction_fits() says, from document_errors(): each document's row of its source's penalty, the additive one being that of alpha."""
    own = F.broadcast(penalties.select(F.col("source").alias("_s"), F.col("model").alias("_m"), F.col("penalty").alias("_p")))  # a row for each source and model
    rows = errors.join(own, F.col("source").eqNullSafe(F.col("_s")) & (F.col("model") == F.col("_m")))
    rows = rows.where(F.when(F.col("model") == "additive", F.col("penalty").isNull()).otherwise(F.col("penalty") == F.col("_p")))
    rows = rows.groupBy("doc_id", "source").agg(F.max(F.when(F.col("model") == "additive", F.col("r2"))).alias("_base"), F.collect_list(F.struct("model", "r2", "gold_pair", "gold_main")).alias("x"))
    return rows.select("doc_id", "source", "_base", F.inline("x")).withColumn("gain", F.col("r2") - F.col("_base")).drop("_base")


def interaction_gain(measured: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Whether pairs of chunks explain what the additive surrogate leaves: by source and model the chosen penalty, mean held-out R2, gain over the additive fit with standard error and share of documents that gain, coefficients of gold pairs.

    Penalties are those of least held-out error over the source's informative documents. Rows of
    measured(doc_id, source, masks, y, gold, answers_in) with constant or no outcomes, or fewer than
    four masks, take no part.
    """
    errors = kept(document_errors(measured, alpha))  # held-out errors of all penalties are made once, and hold those of the chosen ones
    penalties = kept(chosen_penalties(_mean_errors(errors)))
    fits = _chosen_fits(errors, penalties)
    found = fits.groupBy("source", "model").agg(
        F.count("*").alias("n"), F.avg("r2").alias("r2"), F.avg("gain").alias("gain"), (F.stddev_samp("gain") / F.sqrt(F.count("gain"))).alias("gain_se"), F.avg((F.col("gain") > FLAT).cast("int")).alias("share_gaining"),
        F.avg("gold_pair").alias("gold_pair"), F.avg("gold_main").alias("gold_main"))
    own = penalties.withColumnsRenamed({"source": "_s", "model": "_m"})
    return found.join(own, F.col("source").eqNullSafe(F.col("_s")) & (F.col("model") == F.col("_m"))).drop("_s", "_m", "cv_mse")


def subset_order(doc_id, draw: int, masks: int) -> list[int]:
    """Masks of a document in the order in which a draw takes them: by a hash, so that a draw of fewer is the head of one of more."""
    unit = [hashlib.sha1(f"subset:{draw}:{doc_id}:{k}".encode()).hexdigest()[:13] for k in range(masks)]
    return sorted(range(masks), key=lambda k: (unit[k], k))


def mask_subsets(measured: DataFrame, calls: tuple = CALLS, draws: int = DRAWS) -> DataFrame:
    """(doc_id, draw, calls, k): the masks of each refit, as subset_order() takes them; numbers of calls that a document hasn't are left out."""
    return subsets(measured.select("doc_id", F.size("y").alias("n")), calls, draws)


def subsets(counts: DataFrame, calls: tuple = CALLS, draws: int = DRAWS) -> DataFrame:
    """mask_subsets() from the number of masks of each document in counts(doc_id, n): an order depends on nothing else, and is made inside the row."""
    drawn = counts.where(F.col("n") > min(calls)).select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    of = lambda k: F.struct(hash_unit(F.concat_ws(":", "draw", "doc_id", k), "subset").alias("unit"), k.alias("k"))
    ordered = F.array_sort(F.transform(F.sequence(F.lit(0), F.col("n") - 1), of))
    placed = drawn.select("doc_id", "n", "draw", F.explode(F.array(ordered)).alias("order"))  # a generator of one row: made once for all numbers of calls
    placed = placed.select("doc_id", "n", "draw", F.slice(F.col("order.k"), 1, max(calls)).alias("order"), F.explode(F.array(*[F.lit(c) for c in calls])).alias("calls"))
    return placed.where("calls < n").select("doc_id", "draw", "calls", F.explode(F.slice("order", F.lit(1), F.col("calls"))).alias("k"))


def _ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks."""
    values, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    upto = np.cumsum(counts)
    return (upto - (counts - 1) / 2)[inverse]


def _label(beta: np.ndarray, gold: list[int], answers_in: list[int]) -> dict:
    """Whether the best chunk holds an answer, recall of gold among as many best, and whether coefficients are all alike."""
    beta = np.round(beta, 9)
    flat = float(np.std(beta) < 1e-12)
    order = np.argsort(-beta, kind="stable")
    first = None if not answers_in else 0.0 if flat else float(order[0] in answers_in)
    gold = sorted(set(gold))
    recall = None if not gold else 0.0 if flat else len(set(order[: len(gold)].tolist()) & set(gold)) / len(gold)
    return {"first": first, "recall": recall, "degenerate": flat}


def _correlation(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def _refits(masks: np.ndarray, y: np.ndarray, kernel: np.ndarray, ats: np.ndarray, full: np.ndarray, alpha: float, gold: list[int], answers_in: list[int]) -> list[dict]:
    """For fits on some masks each (ats, all of one number): their labels, and how they compare with the fit on all: rank correlation, held-out R2 among their own masks and on the others."""
    inside, own = kernel[ats[:, :, None], ats[:, None, :]], y[ats]
    weights, center, means = duals(inside, own)
    coefficients = np.einsum("bm,bmc->bc", weights, masks[ats]) / alpha
    varied = [b for b in range(len(ats)) if len(ats[b]) >= 4 and np.ptp(own[b]) >= FLAT]
    within = dict(zip(varied, held_out_all(lambda train: inside[varied], own[varied]), strict=True)) if varied else {}
    whole = np.round(full, 9)
    ranks = _ranks(whole) if np.std(whole) > 1e-12 else None
    r2 = lambda said, seen: float(1 - ((said - seen) ** 2).sum() / ((seen - seen.mean()) ** 2).sum())
    found = []
    for b, at in enumerate(ats):
        out: dict = {"spearman": None, "cv_r2": None, "heldout_r2": None}
        beta = np.round(coefficients[b], 9)
        if ranks is not None and np.std(beta) > 1e-12:
            out["spearman"] = _correlation(_ranks(beta), ranks)
        if b in within:
            out["cv_r2"] = r2(within[b], own[b])
        others = np.ones(len(y), dtype=bool)
        others[at] = False
        rest = np.flatnonzero(others)
        if len(rest) >= 2 and np.ptp(y[rest]) >= FLAT:
            out["heldout_r2"] = r2(means[b] + (kernel[rest[:, None], at[None, :]] - center[b][None, :]) @ weights[b], y[rest])
        found.append(_label(coefficients[b], gold, answers_in) | out)
    return found


_CURVE = "doc_id {doc_id}, source string, fit string, calls int, first double, recall double, degenerate double, spearman double, cv_r2 double, heldout_r2 double"


def _ranked(x: np.ndarray) -> np.ndarray:
    """Average ranks along the last axis, less their mean."""
    less = (x[..., None, :] < x[..., :, None]).sum(axis=-1)
    same = (x[..., None, :] == x[..., :, None]).sum(axis=-1)
    return less + (same + 1) / 2 - (x.shape[-1] + 1) / 2


def _mean_r2(said: np.ndarray, y: np.ndarray, held: np.ndarray) -> np.ndarray:
    """R2 over the held places of the last axis; NaN where these are fewer than two or alike."""
    count = held.sum(axis=-1)
    mean = (y * held).sum(axis=-1) / np.maximum(count, 1)
    spread = (held * (y - mean[..., None]) ** 2).sum(axis=-1)
    apart = np.where(held, y, -np.inf).max(axis=-1) - np.where(held, y, np.inf).min(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((count >= 2) & (apart >= FLAT), 1 - (held * (said - y) ** 2).sum(axis=-1) / spread, np.nan)


_DRAWN = ("first", "recall", "degenerate", "spearman", "cv_r2", "heldout_r2")


def _drawn(masks: np.ndarray, y: np.ndarray, ats: np.ndarray, full: np.ndarray, alpha: float, gold: np.ndarray, answers_in: np.ndarray) -> np.ndarray:
    """[documents, figures]: _refits() of documents of one shape, means over draws (NaN: none); ats [documents, draws, masks], gold and answers_in [documents, chunks]."""
    d, draws, m = ats.shape
    n, c = masks.shape[1:]
    ats = np.sort(ats, axis=2)
    at = np.arange(d)[:, None, None]
    x, own = masks[at, ats].reshape(d * draws, m, c), y[at, ats].reshape(d * draws, m)
    start, beta = ridge_fits(x, own, np.full((1, c), alpha))
    start, beta = start[0].reshape(d, draws), beta[0].reshape(d, draws, c)
    # Equal coefficients such as 1 / 1024 lie between two numbers of 9 digits: only what is equal at 12 digits rounds alike.
    rounded = np.round(np.round(beta, 12), 9)
    flat = np.std(rounded, axis=2) < 1e-12
    place = np.argsort(np.argsort(-rounded, axis=2, kind="stable"), axis=2)
    size = gold.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        first = np.where(flat, 0.0, (answers_in[:, None, :] & (place == 0)).any(axis=2))
        first = np.where(answers_in.any(axis=1)[:, None], first, np.nan)
        recall = np.where(flat, 0.0, (gold[:, None, :] & (place < size[:, None, None])).sum(axis=2) / size[:, None])
        recall = np.where(size[:, None] > 0, recall, np.nan)
        whole = np.round(np.round(full, 12), 9)
        a, b = _ranked(rounded), _ranked(whole)[:, None, :]
        spearman = (a * b).sum(axis=2) / np.sqrt((a * a).sum(axis=2) * (b * b).sum(axis=2))
    spearman = np.where((np.std(whole, axis=1) > 1e-12)[:, None] & (np.std(rounded, axis=2) > 1e-12), spearman, np.nan)
    cv = np.full((d, draws), np.nan)
    if m >= 4:
        said = held_out_fits(x, own, np.full((1, c), alpha))[0]
        cv = _mean_r2(said, own, np.ones(own.shape, dtype=bool)).reshape(d, draws)
    rest = np.ones((d, draws, n), dtype=bool)
    np.put_along_axis(rest, ats, False, axis=2)
    said = start[:, :, None] + beta @ masks.transpose(0, 2, 1)
    others = _mean_r2(said, np.broadcast_to(y[:, None, :], rest.shape), rest)
    figures = np.stack([first, recall, flat.astype(float), spearman, cv, others], axis=2)
    some = ~np.isnan(figures)
    count = some.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(count > 0, np.where(some, figures, 0.0).sum(axis=1) / count, np.nan)


def refits(measured: DataFrame, alpha: float = 1.0, calls: tuple = CALLS, draws: int = DRAWS, sparse_keeps: int = 2) -> DataFrame:
    """(doc_id, source, fit, calls, first, recall, degenerate, spearman, cv_r2, heldout_r2) of each informative document, means over draws.

    fit is `curve` for draws of each number of calls (and all), and, where a document has as many
    masks of more than `sparse_keeps` chunks as of fewer, `sparse` (those masks), `dense` and `any`
    (as many drawn from the others and from all): refits at equal cost. Draws are subset_order().
    """
    schema = _CURVE.format(**dict(measured.dtypes))
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def listed(chunks: list, rows: np.ndarray, c: int) -> np.ndarray:
        """Which of c chunks each row lists."""
        out = np.zeros((len(rows), c), dtype=bool)
        for k, row in enumerate(rows):
            out[k, sorted(set(chunks[row] or []))] = True
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, gold, answers = (batch.column(c).to_pylist() for c in ("doc_id", "gold", "answers_in"))
            for rows, masks, y in shaped(batch):
                y = np.round(y, 9)
                fit = np.flatnonzero(np.ptp(y, axis=1) >= FLAT)
                if not len(fit):
                    continue
                rows, masks, y = rows[fit], masks[fit], y[fit]
                n, c = masks.shape[1:]
                golden, holding = listed(gold, rows, c), listed(answers, rows, c)
                full = ridge_fits(masks, y, np.full((1, c), alpha))[1][0]
                orders = np.array([[subset_order(ids[row], d, n) for d in range(draws)] for row in rows])
                found: list = []

                def put(fit: str, number: int, at, ats: np.ndarray) -> None:
                    figures = _drawn(masks[at], y[at], ats, full[at], alpha, golden[at], holding[at])  # noqa: B023
                    found.append((rows[at], fit, number, figures))  # noqa: B023

                every = np.arange(len(rows))
                put("curve", n, every, np.broadcast_to(np.arange(n), (len(rows), 1, n)))
                found[0][3][:, _DRAWN.index("spearman")] = 1.0
                for k in calls:
                    if k < n:
                        put("curve", k, every, orders[:, :, :k])
                few = masks.sum(axis=2) <= sparse_keeps
                numbers = few.sum(axis=1)
                for m in np.unique(numbers):
                    if 2 <= m <= n - m:
                        at = np.flatnonzero(numbers == m)
                        put("sparse", m, at, np.stack([np.flatnonzero(few[k]) for k in at])[:, None, :])
                        put("dense", m, at, np.stack([[o[~few[k][o]][:m] for o in orders[k]] for k in at]))
                        put("any", m, at, orders[at][:, :, :m])
                own = np.concatenate([x[0] for x in found])
                figures = np.concatenate([x[3] for x in found])
                left = batch.take(pa.array(own, pa.int64()))
                columns = [left.column("doc_id"), left.column("source"), pa.array([x[1] for x in found for _ in x[0]]), pa.array([int(x[2]) for x in found for _ in x[0]], pa.int32())]
                columns += [pa.array(figures[:, k], pa.float64(), from_pandas=True) for k in range(len(_DRAWN))]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, kind, strict=True)], schema=kind)

    return measured.select("doc_id", "source", "masks", "y", "gold", "answers_in").mapInArrow(run, schema)


def k_curve(measured: DataFrame, alpha: float = 1.0, calls: tuple = CALLS, draws: int = DRAWS) -> DataFrame:
    """By source, fit and number of calls (null: as many as a document has): documents, means of each figure over those that have it, medians of the correlations."""
    rows = refits(measured, alpha, calls, draws)
    at = F.when((F.col("fit") == "curve") & F.col("calls").isin(*calls), F.col("calls"))
    figures = ("first", "recall", "degenerate", "spearman", "cv_r2", "heldout_r2")
    return rows.groupBy("source", "fit", at.alias("calls")).agg(
        F.count("*").alias("n"), F.avg("calls").alias("mean_calls"), *[F.avg(c).alias(c) for c in figures], *[F.percentile(c, F.lit(0.5)).alias(f"{c}_median") for c in ("spearman", "cv_r2", "heldout_r2")]
    )

"""Distilling utilities into a one-pass scorer: examples, losses, and a linear ListNet model over lexical features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.functions.text import contains_answer, terms

SOURCES = ("beta", "ensemble", "span", "answer", "loo_bin")


def examples(labels: DataFrame, source: str = "beta", threshold: float = 0.0, prior: list[float] | None = None) -> DataFrame:
    """labels(doc_id, question, answers, chunks, gold_chunks, beta, z, informative, estimator) with a target and a gold list, informative documents only.

    span marks gold chunks, of documents without any as well. answer marks chunks that contain an
    answer, loo_bin leave-one-out utilities above the threshold; both leave out documents without a
    marked chunk and take the marked ones for gold. loo_bin refuses any other record, informative or
    not. Else the target is z, less a prior by relative place if there is one.
    """
    if source not in SOURCES:
        raise ValueError(f"unknown label source: {source}")
    if source == "loo_bin":
        labels = labels.where(F.assert_true(F.col("estimator") == "loo", F.lit("binary labels take leave-one-out records")).isNull())
    kept = labels.where("informative")
    numbers = F.sequence(F.lit(0), F.size("chunks") - 1)
    if source == "span":
        gold = F.col("gold_chunks")
    elif source == "answer":
        gold = F.filter(numbers, lambda i: contains_answer(F.get("chunks", i), F.col("answers")))
    elif source == "loo_bin":
        gold = F.filter(numbers, lambda i: F.get("beta", i) > threshold)
    else:
        target = F.col("z")
        if prior:
            bins = F.array(*[F.lit(float(p)) for p in prior])
            place = lambda i: F.least(F.lit(len(prior)), F.floor(len(prior) * i / F.greatest(F.lit(1), F.size("z"))) + 1).cast("int")
            target = F.transform("z", lambda z, i: z - F.element_at(bins, place(i)))
        return kept.withColumn("target", target).withColumn("gold", F.col("gold_chunks"))
    marked = kept.withColumn("gold", F.when(F.size("chunks") > 0, gold).otherwise(F.array().cast("array<int>")))
    marked = marked.withColumn("target", F.transform("chunks", lambda c, i: F.array_contains("gold", i).cast("double")))
    return marked if source == "span" else marked.where(F.size("gold") > 0)


def softmax(xs: Column) -> Column:
    top = F.array_max(xs)
    shifted = F.transform(xs, lambda x: F.exp(x - top))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda s, y: s + y))


def listnet(scores: Column, target: Column, squared: float = 0.0) -> Column:
    """Cross entropy between the softmax of targets and of scores, plus a share of the mean squared error."""
    entropy = F.aggregate(F.zip_with(softmax(target), softmax(scores), lambda p, q: -p * F.log(q)), F.lit(0.0), lambda s, x: s + x)
    error = F.aggregate(F.zip_with(scores, target, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.size(scores)
    return entropy + squared * error


def weighted_bce(scores: Column, target: Column) -> Column:
    """Binary cross entropy on logits, positives weighed by max(1, negatives / positives)."""
    pos = F.aggregate(target, F.lit(0.0), lambda s, t: s + t)
    weight = F.greatest(F.lit(1.0), (F.size(target) - pos) / F.greatest(pos, F.lit(1.0)))
    one = lambda s, t: -(weight * t * -F.log1p(F.exp(-s)) + (1 - t) * -F.log1p(F.exp(s)))
    return F.aggregate(F.zip_with(scores, target, one), F.lit(0.0), lambda a, x: a + x) / F.size(scores)


def group_size(step: int, n: int, place: int) -> int:
    """Documents that share an optimiser step with the one at a place."""
    return min(step, n - step * (place // step))


FEATURES = ("bm25", "overlap", "place", "length")


def features(question: Column, chunks: Column, bm25: Column) -> Column:
    """For each chunk: its BM25, the share of question terms it has, its relative place, the logarithm of its length."""
    asked = F.array_distinct(terms(question))
    n = F.size(chunks)

    def one(c: Column, i: Column) -> Column:
        own = F.array_distinct(terms(c))
        return F.array(F.element_at(bm25, i + 1), F.size(F.array_intersect(asked, own)) / F.greatest(F.lit(1), F.size(asked)), i / F.greatest(F.lit(1), n - 1), F.log1p(F.size(own).cast("double")))

    return F.transform(chunks, one)


def _gradients(weights: np.ndarray, squared: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, loss, n = np.zeros_like(weights), 0.0, 0
        for batch in batches:
            for x, t in zip(batch["x"], batch["target"], strict=True):
                x, t = np.array(x.tolist(), dtype=float), np.asarray(t, dtype=float)
                s = x @ weights
                p, q = np.exp(t - t.max()), np.exp(s - s.max())
                p, q = p / p.sum(), q / q.sum()
                total += x.T @ (q - p + squared * 2 * (s - t) / len(t))
                loss += float(-(p * np.log(q)).sum() + squared * ((s - t) ** 2).mean())
                n += 1
        yield pd.DataFrame([{"gradient": total.tolist(), "loss": loss, "n": n}])

    return run


def train(rows: DataFrame, epochs: int = 20, rate: float = 0.5, squared: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, list[float]]:
    """Weights of FEATURES and the loss of each epoch, by full gradients summed over partitions; rows(x, target) stay where they are.

    The best epoch's weights are returned; a loss that isn't a number never is the best.
    """
    weights, best, history = np.zeros(len(FEATURES)), (float("inf"), np.zeros(len(FEATURES))), []
    rows = rows.select("x", "target").persist()
    try:
        for epoch in range(epochs):
            parts = rows.mapInPandas(_gradients(weights, squared), "gradient array<double>, loss double, n long")
            sums = parts.agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"), *[F.sum(F.element_at("gradient", k + 1)).alias(f"g{k}") for k in range(len(FEATURES))]).first()
            if not sums["n"]:
                break
            loss = sums["loss"] / sums["n"]
            history.append(loss)
            if loss < best[0]:
                best = (loss, weights.copy())
            gradient = np.array([sums[f"g{k}"] for k in range(len(FEATURES))]) / sums["n"] + decay * weights
            weights = weights - rate * (1 - epoch / epochs) * gradient
    finally:
        rows.unpersist()
    return best[1], history


def linear(x: Column, weights: np.ndarray) -> Column:
    """Scores of a list of feature lists."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.transform(x, lambda f: F.aggregate(F.zip_with(f, w, lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y))

"""Chunk scorers. Each gives a list of numbers beside a list of chunks, row by row: no shuffle, whatever the corpus.

Scores are rounded to nine digits before ranking, so that sums in another order rank alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsieve.functions.hashing import hash_unit
from quillsieve.functions.text import terms

Scorer = Callable[[Column, Column], Column]


def bm25(question: Column, chunks: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """BM25 of each chunk, document frequencies taken over the document's own chunks; repeated query terms count each time."""

    asked = terms(question)

    def counted(words: Column, sought: Column) -> Column:
        """A chunk's length and those of its words that are asked for."""
        return F.named_struct(F.lit("n"), F.size(words), F.lit("hits"), F.filter(words, lambda w: F.array_contains(sought, w)))

    def of(d: Column) -> Column:
        docs = d["docs"]
        n = F.size(docs)
        mean = F.greatest(F.aggregate(docs, F.lit(0), lambda s, x: s + x["n"]) / F.greatest(n, F.lit(1)), F.lit(1e-9))
        frequency = F.transform(d["asked"], lambda t: F.named_struct(F.lit("t"), t, F.lit("df"), F.size(F.filter(docs, lambda x: F.array_contains(x["hits"], t)))))
        weighed = F.transform(frequency, lambda q: F.named_struct(F.lit("t"), q["t"], F.lit("idf"), F.log(1 + (n - q["df"] + 0.5) / (q["df"] + 0.5))))

        def scores(x: Column) -> Column:
            """All chunks' scores; each reads only its few words that are asked for."""

            def score(c: Column) -> Column:
                def add(s: Column, q: Column) -> Column:
                    tf = F.size(F.filter(c["hits"], lambda w: w == q["t"]))
                    return s + F.when(tf == 0, F.lit(0.0)).otherwise(q["idf"] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * c["n"] / x["mean"])))

                return F.when(F.size(c["hits"]) == 0, F.lit(0.0)).otherwise(F.round(F.aggregate(x["weighed"], F.lit(0.0), add), 9))

            return F.transform(docs, score)

        return F.flatten(F.transform(F.array(F.named_struct(F.lit("weighed"), weighed, F.lit("mean"), mean)), scores))

    # Tokens, frequencies and the mean pass through lists of one, so that they are made once a document.
    sought = F.array(F.named_struct(F.lit("asked"), asked, F.lit("each"), F.array_distinct(asked)))
    held = F.transform(sought, lambda q: F.named_struct(F.lit("asked"), q["asked"], F.lit("docs"), F.transform(chunks, lambda c: counted(terms(c), q["each"]))))
    return F.flatten(F.transform(held, of))


def lead(question: Column, chunks: Column) -> Column:
    return F.transform(chunks, lambda c, i: -i.cast("double"))


def random_scores(doc_id: Column, chunks: Column) -> Column:
    """Keyed by the document and the chunk's place."""
    return F.transform(chunks, lambda c, i: hash_unit(F.concat(doc_id, F.lit(":"), i.cast("string")), "random"))


def oracle(gold: Column, base: Column) -> Column:
    """Gold chunks first, above all others; the rest by a base score."""
    top = F.array_max(base) + 1.0
    return F.transform(base, lambda s, i: F.when(F.array_contains(gold, i), top).otherwise(s))


def lookup(betas: Column, chunks: Column) -> Column:
    """Stored utilities of a document's chunks, NULL where they are missing or of another length."""
    return F.when(F.size(betas) == F.size(chunks), betas)


def ranking(scores: Column) -> Column:
    """Chunk numbers by falling score, ties by lower number, numbers that aren't finite last."""
    keyed = F.transform(scores, lambda s, i: F.named_struct(F.lit("k"), F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), F.lit(float("inf"))).otherwise(-s), F.lit("i"), i))
    return F.transform(F.array_sort(keyed), lambda x: x["i"])


def fused(*scores: Column, k: float = 60.0) -> Column:
    """Reciprocal rank fusion of two or more score lists."""
    if len(scores) < 2:
        raise ValueError("rank fusion takes two or more scorers")
    def places(order: Column) -> Column:
        """The place of each chunk, by its number."""
        turned = F.transform(order, lambda i, at: F.named_struct(F.lit("i"), i, F.lit("at"), at))
        return F.transform(F.array_sort(turned), lambda x: x["at"])

    # The places pass through a list of one, so that they are made once a document.
    held = F.array(F.array(*[places(ranking(s)) for s in scores]))

    def of(o: Column) -> Column:
        total = lambda at, i: sum((1.0 / (k + 1 + (at if j == 0 else F.get(o[j], i))) for j in range(len(scores))), F.lit(0.0))
        return F.transform(o[0], total)

    return F.flatten(F.transform(held, of))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of the normalised vectors."""
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))

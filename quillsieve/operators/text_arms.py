"""Arms that return text instead of chunks: compressors that are asked again until their text fits."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Attempts by rate and by token target, and the margins that each further attempt adds.
RATE_ATTEMPTS, TARGET_ATTEMPTS, RATE_MARGIN, TARGET_MARGIN = 3, 5, 1.02, 0.98


class Compressor(ABC):
    """Compresses a context for a question at a ratio, or to a number of tokens if it takes one."""

    takes_target = False

    @abstractmethod
    def compress(self, question: str, chunks: list[str], ratio: float, target: int | None) -> str: ...

    def count(self, text: str) -> int:
        return len((text or "").split())

    def cut(self, text: str, tokens: int) -> str:
        return " ".join((text or "").split()[:tokens])


class Truncation(Compressor):
    """The first words that a ratio leaves."""

    def compress(self, question: str, chunks: list[str], ratio: float, target: int | None) -> str:
        words = "\n\n".join(chunks).split()
        return " ".join(words[: int(len(words) / ratio + 0.5)])


def fitted(tool: Compressor, question: str, chunks: list[str], ratio: float, budget: int) -> tuple[str, bool]:
    """A text within the budget, and whether its tail had to be cut: each attempt tightens by what the last was over."""
    rate, target, text = ratio, float(budget), ""
    for _ in range(TARGET_ATTEMPTS if tool.takes_target else RATE_ATTEMPTS):
        text = tool.compress(question, chunks, rate, int(target) if tool.takes_target else None)
        n = tool.count(text)
        if n <= budget:
            return text, False
        rate *= RATE_MARGIN * n / budget
        target = max(1.0, target * TARGET_MARGIN * budget / n)  # cut to whole tokens on the call only
    return tool.cut(text, budget), True


def compressed(docs: DataFrame, tool: Compressor) -> DataFrame:
    """(doc_id, ratio, text, kept_tokens, truncated, error) of docs(doc_id, question, chunks, ratio, budget); a failing document gives its error, not a failed job."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                try:
                    text, cut = fitted(tool, row.question, list(row.chunks), row.ratio, int(row.budget))
                    out.append((row.doc_id, row.ratio, text, tool.count(text), cut, None))
                except Exception as e:  # recorded, so that one document doesn't stop the others
                    out.append((row.doc_id, row.ratio, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "ratio", "text", "kept_tokens", "truncated", "error"]).astype({"kept_tokens": "Int32", "truncated": "boolean"})

    return docs.select("doc_id", "question", "chunks", "ratio", "budget").mapInPandas(run, f"doc_id {kind}, ratio double, text string, kept_tokens int, truncated boolean, error string")

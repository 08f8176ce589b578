"""Readers answer a question from a context. Language models plug in as batch functions; lexical ones are built in."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType


def _words(text: str) -> list[str]:
    return re.findall(r"\w+", (text or "").lower())


class Reader(ABC):
    """Answers batches of (context, question); name labels its rows."""

    name = "reader"

    @abstractmethod
    def generate(self, contexts: list[str], questions: list[str]) -> list[str]: ...

    def logprob(self, contexts: list[str], questions: list[str], answers: list[str]) -> list[float | None]:
        """Mean log-probability of answers, for readers that have one."""
        return [None] * len(contexts)


class SentenceReader(Reader):
    """The sentence that shares the most question words, weighted by rarity in the context if asked; the first on ties."""

    def __init__(self, name: str, rare: bool):
        self.name, self.rare = name, rare

    def generate(self, contexts: list[str], questions: list[str]) -> list[str]:
        out = []
        for context, question in zip(contexts, questions, strict=True):
            sentences = [s.strip() for line in (context or "").split("\n") for s in re.split(r"(?<=[.!?…])\s+", line) if s.strip()]
            sets, asked = [set(_words(s)) for s in sentences], set(_words(question))
            seen = {w: sum(w in s for s in sets) for w in asked}
            worth = [sum(1 / seen[w] if self.rare else 1 for w in sorted(asked & s)) for s in sets]
            out.append(sentences[max(range(len(sentences)), key=lambda i: (worth[i], -i))] if sentences else "")
        return out


class FirstSentence(Reader):
    name = "first"

    def generate(self, contexts: list[str], questions: list[str]) -> list[str]:
        return [next((s.strip() for s in re.split(r"(?<=[.!?…])\s+|\n", c or "") if s.strip()), "") for c in contexts]


class LineReader(Reader):
    """Turns to the line that shares the most distinct words with the question, the first on ties, and says some of its words."""

    name = "line"

    def __init__(self, first: int = 7, words: int = 4):
        self.first, self.words = first, words

    def generate(self, contexts: list[str], questions: list[str]) -> list[str]:
        out = []
        held: dict[str, set[str]] = {}  # Masked contexts of a document share their lines.
        for context, question in zip(contexts, questions, strict=True):
            lines, asked = (context or "").split("\n"), set(_words(question))
            for line in lines:
                if line not in held:
                    held[line] = set(_words(line))
            found = max(lines, key=lambda line: len(asked & held[line]))  # max keeps the first of equals
            said = [w for w in re.split(r"[ \t\n\f\r]+", found) if w]
            out.append(" ".join(said[self.first - 1 : self.first - 1 + self.words]))
        return out


LEXICAL = (SentenceReader("rare", True), SentenceReader("overlap", False), FirstSentence())


def answered(rows: DataFrame, readers: tuple[Reader, ...] = LEXICAL) -> DataFrame:
    """rows(context, question, ...) once for each reader, with reader and answer added; batches are sorted by length and put back."""
    schema = StructType([f for f in rows.schema.fields if f.name not in ("reader", "answer")] + [StructField("reader", StringType()), StructField("answer", StringType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            order = batch["context"].str.len().fillna(0).to_numpy().argsort(kind="stable")
            for reader in readers:
                part = batch.iloc[order]
                said = reader.generate(part["context"].tolist(), part["question"].tolist())
                yield part.assign(reader=reader.name, answer=said).iloc[order.argsort(kind="stable")][names]

    return rows.mapInPandas(run, schema)

"""Arms applied to documents: each specification becomes a scorer, a kind of selection, and rows for every ratio.

Documents are read once. Scores that are column expressions stay in the JVM; the others come from
one Arrow call for each document batch, in which all model arms share the batch's words. A row is
made for each arm and ratio only then, so an arm more costs its selection and nothing else.
"""

from __future__ import annotations

import math
import re
import time
from abc import ABC, abstractmethod
from collections import Counter
from collections.abc import Callable
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.functions.text import CHUNK_SEP, chunk_body, chunk_title, contains_answer, gold_recall, split_sentences, token_count
from quillsieve.operators import scoring, selection
from quillsieve.operators.text_arms import Compressor, fitted
from quillsieve.plans.arms import Arm, parse_all

#: Base columns of a row; the selection follows them.
BASE = ("doc_id", "source", "language", "hop", "cluster_id", "needle_relpos")
#: What model scores are rounded to before ranking.
DIGITS = 9


class Batch:
    """Questions and the texts to be scored for each, with their words, made once for all scorers."""

    def __init__(self, questions: list[str], texts: list[list[str]]) -> None:
        self.questions, self.texts = questions, texts

    @staticmethod
    def _terms(text: str) -> list[str]:
        return re.findall(r"\w+", (text or "").lower())

    @cached_property
    def question_terms(self) -> list[Counter]:
        return [Counter(self._terms(q)) for q in self.questions]

    @cached_property
    def text_terms(self) -> list[list[Counter]]:
        return [[Counter(self._terms(t)) for t in ts] for ts in self.texts]


class BatchScorer(ABC):
    """Scores every text of every question of a batch; what a model arm plugs in."""

    @abstractmethod
    def scores(self, batch: Batch) -> list[list[float]]: ...


class TermCosine(BatchScorer):
    """Cosine of term counts of question and text: the stand-in for dense encoders, whose weights are not available."""

    def scores(self, batch: Batch) -> list[list[float]]:
        out = []
        for q, texts in zip(batch.question_terms, batch.text_terms, strict=True):
            size = sum(n * n for n in q.values())
            own = []
            for t in texts:
                norm = size * sum(n * n for n in t.values())
                own.append(sum(n * t[w] for w, n in q.items()) / math.sqrt(norm) if norm else 0.0)
            out.append(own)
        return out


class Coverage(BatchScorer):
    """The share of the question's terms that a text holds: the stand-in for cross-encoders."""

    def scores(self, batch: Batch) -> list[list[float]]:
        return [[sum(w in t for w in q) / max(1, len(q)) for t in texts] for q, texts in zip(batch.question_terms, batch.text_terms, strict=True)]


class CharacterRate(Compressor):
    """The first characters that a ratio leaves, so words over- and undershoot their budget: the stand-in for compressors with a tokenizer of their own."""

    def compress(self, question: str, chunks: list[str], ratio: float, target: int | None) -> str:
        text = CHUNK_SEP.join(chunks)
        return text[: int(len(text) / ratio)]

    def count(self, text: str) -> int:
        """As word_units()."""
        return len((text or "").split()) + (text or "").count(CHUNK_SEP)


#: Stand-ins by the name of the arm; given models come before them.
SCORERS: dict[str, BatchScorer] = {"embed": TermCosine(), "reranker": Coverage(), "provence": Coverage(), "recomp": TermCosine(), "exit": Coverage()}
COMPRESSORS: dict[str, Compressor] = {"llmlingua2": CharacterRate(), "llmlingua": CharacterRate(), "longllmlingua": CharacterRate()}


def word_units(text: Column) -> Column:
    """Words, and one token for each break between chunks."""
    return (token_count(text) + F.size(F.split(text, CHUNK_SEP)) - 1).cast("int")


def sentence_units(docs: DataFrame) -> DataFrame:
    """docs with units, the sentences of their chunks: chunk, text, title, paragraph, title_tokens, tokens."""
    known = "para" in docs.columns

    def of(c: Column, i: Column) -> Column:
        title = chunk_title(c, F.col("hop"))
        para = F.get(F.col("para"), i).cast("int") if known else F.lit(None).cast("int")
        made = lambda s: F.named_struct(F.lit("chunk"), i, F.lit("text"), s, F.lit("title"), title, F.lit("paragraph"), para, F.lit("title_tokens"), token_count(title), F.lit("tokens"), token_count(s))
        return F.transform(split_sentences(chunk_body(c, F.col("hop"))), made)

    return docs.withColumn("units", F.flatten(F.transform("chunks", of)))


def _once(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs with columns that are made once a row, not at each use."""
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return docs.select("*", F.inline(F.array(made)))


def _models(arms: list[Arm], level: str) -> list[str]:
    """Names of the models that arms need at a level (chunk or sentence), parts of fusions included."""
    found: list[str] = []
    for arm in arms:
        levels = {"chunk": ("chunk",), "sentence": ("sentence",), "fill": ("chunk", "sentence")}.get(arm.kind, ())
        if level not in levels:
            continue
        parts = arm.parts if arm.parts else (arm,)
        for p in parts:
            for leaf in p.parts or (p,):
                if leaf.name not in ("lead", "random", "bm25", "oracle_span", "oracle_support", "oracle_beta") and _key(leaf) not in found:
                    found.append(_key(leaf))
    return found


def _key(arm: Arm) -> str:
    return f"{arm.name}:{arm.argument}" if arm.argument else arm.name


def _given(models: dict, stand_ins: dict, key: str):
    name = key.partition(":")[0]
    for place, k in ((models, key), (models, name), (stand_ins, name)):
        if k in place:
            return place[k]
    raise ValueError(f"no model for {key}")


_UNITS = "array<struct<chunk: int, text: string, title: string, paragraph: int, title_tokens: int, tokens: int>>"
_RESULT = "struct<chunk: array<array<double>>, sentence: array<array<double>>, texts: array<struct<ratio: double, text: string, truncated: boolean, error: string>>, seconds: double>"


def _asked(arms: list[Arm], ratios: list[float], models: dict, tools: dict) -> Callable | None:
    """One Arrow call for all that isn't a column expression, or None if nothing needs it."""
    chunk_models, sentence_models = ([_given(models, SCORERS, k) for k in _models(arms, level)] for level in ("chunk", "sentence"))
    text_tools = [_given(tools, COMPRESSORS, _key(a)) for a in arms if a.kind == "text"]
    if not (chunk_models or sentence_models or text_tools):
        return None
    ratios = [float(r) for r in ratios]

    @F.arrow_udf(_RESULT)
    def ask(question: pa.Array, chunks: pa.Array, sentences: pa.Array, full_tokens: pa.Array) -> pa.Array:
        began = time.perf_counter()
        questions, chunks = question.to_pylist(), chunks.to_pylist()
        rows = [{"chunk": [], "sentence": [], "texts": []} for _ in questions]
        for level, own, texts in (("chunk", chunk_models, chunks), ("sentence", sentence_models, sentences.to_pylist() if sentence_models else [])):
            batch = Batch(questions, texts)
            for model in own:
                for row, scores in zip(rows, model.scores(batch), strict=True):
                    row[level].append([round(float(s), DIGITS) for s in scores])
        for tool in text_tools:
            for row, q, c, n in zip(rows, questions, chunks, full_tokens.to_pylist(), strict=True):
                for r in ratios:
                    try:
                        text, cut = fitted(tool, q, c, r, max(1, math.ceil(n / r)))
                        row["texts"].append({"ratio": r, "text": text, "truncated": cut, "error": None})
                    except Exception as e:  # a compressor's failure on a document is recorded, not fatal
                        row["texts"].append({"ratio": r, "text": None, "truncated": None, "error": f"{type(e).__name__}: {e}"})
        for row in rows:
            row["seconds"] = (time.perf_counter() - began) / len(rows)
        kinds = pa.list_(pa.list_(pa.float64()))
        texts = pa.list_(pa.struct([("ratio", pa.float64()), ("text", pa.string()), ("truncated", pa.bool_()), ("error", pa.string())]))
        return pa.array(rows, pa.struct([("chunk", kinds), ("sentence", kinds), ("texts", texts), ("seconds", pa.float64())]))

    return ask


def arm_rows(docs: DataFrame, specs: list[str], ratios: list[float], models: dict | None = None, tools: dict | None = None, count: Callable[[Column], Column] = word_units, separator: int = 1) -> DataFrame:
    """A row for each of docs, each arm and ratio: base columns, arm, ratio (null for full), num_chunks, n_gold, full_tokens, budget, kept, partial, text, kept_tokens, truncated, gold_recall, seconds, error, and the document's question, answers and gold_chunks.

    docs: doc_id, source, language, hop, cluster_id, needle_relpos, question, answers, chunks and
    gold_chunks; betas for oracle_beta, para where chunks are sentences of paragraphs. models and
    tools replace the stand-ins by name or name:argument. Full contexts have one row. oracle_beta
    gives no rows where utilities are missing or of another length. Text arms whose tool fails on a
    document give a row with the error. Documents without chunks give no rows. seconds is the share
    of the batch's time that a document's model calls took, 0 for arms without one.
    """
    arms = parse_all(specs)
    docs = docs.where(F.size("chunks") > 0)
    # Sentences only where an arm takes some.
    cut = any(a.kind in ("sentence", "fill") for a in arms)
    rows = sentence_units(docs) if cut else docs.withColumn("units", F.lit(None).cast(_UNITS))
    titled = F.transform("units", lambda u: F.when(u["title"] != "", F.concat(u["title"], F.lit("\n"), u["text"])).otherwise(u["text"]))
    rows = _once(rows, lengths=F.transform("chunks", lambda c: token_count(c)), full_text=F.array_join("chunks", CHUNK_SEP), titled=titled)
    rows = _once(rows, full_tokens=count(F.col("full_text")))
    ask = _asked(arms, ratios, models or {}, tools or {})
    if ask is not None:
        # Sentences go to Python only for a model that scores them.
        sentences = F.col("titled") if _models(arms, "sentence") else F.lit(None).cast("array<string>")
        rows = rows.withColumn("asked", ask("question", "chunks", sentences, "full_tokens"))
    names = {level: _models(arms, level) for level in ("chunk", "sentence")}
    bm25 = {"chunk": F.col("bm25_chunk"), "sentence": F.col("bm25_sentence")}
    made = {}
    leaves = lambda a: [x for p in (a.parts or (a,)) for x in (p.parts or (p,))]
    if any(x.name in ("bm25", "oracle_span", "oracle_support") for a in arms if a.kind in ("chunk", "fill") for x in leaves(a)):
        made["bm25_chunk"] = scoring.bm25(F.col("question"), F.col("chunks"))
    if any(x.name == "bm25" for a in arms if a.kind in ("sentence", "fill") for x in leaves(a)):
        made["bm25_sentence"] = scoring.bm25(F.col("question"), F.col("titled"))
    rows = _once(rows, **made) if made else rows

    def scores(arm: Arm, level: str) -> Column:
        if arm.name in ("sent", "fill"):
            return scores(arm.parts[0], level)
        if arm.name == "rrf":
            return scoring.fused(*[scores(p, level) for p in arm.parts])
        if arm.name == "lead":
            return scoring.lead(F.col("question"), F.col("chunks"))
        if arm.name == "random":
            return scoring.random_scores(F.col("doc_id").cast("string"), F.col("chunks"))
        if arm.name == "bm25":
            return bm25[level]
        if arm.name == "oracle_support":
            return scoring.oracle(F.col("gold_chunks"), bm25[level])
        if arm.name == "oracle_span":
            held = F.filter(F.transform("chunks", lambda c, i: F.when(contains_answer(c, F.col("answers")), i)), lambda i: i.isNotNull())
            return selection.let(held, lambda h: scoring.oracle(h, bm25[level]))
        if arm.name == "oracle_beta":
            return scoring.lookup(F.col("betas"), F.col("chunks"))
        return F.element_at(F.col(f"asked.{level}"), names[level].index(_key(arm)) + 1)

    empty, no_texts = F.lit(None).cast("array<double>"), F.lit(None).cast("array<struct<ratio: double, text: string, truncated: boolean, error: string>>")
    each, place = [], 0
    for arm in arms:
        texts = no_texts
        if arm.kind == "text":
            texts, place = F.slice("asked.texts", place * len(ratios) + 1, len(ratios)), place + 1
        model = bool(_models([arm], "chunk") or _models([arm], "sentence") or arm.kind == "text")
        each.append(F.struct(
            F.lit(arm.label).alias("arm"), F.lit(arm.kind).alias("kind"), (scores(arm, "chunk") if arm.kind in ("chunk", "fill") else empty).alias("scores"),
            (scores(arm, "sentence") if arm.kind in ("sentence", "fill") else empty).alias("unit_scores"), texts.alias("texts"),
            (F.col("asked.seconds") if model else F.lit(0.0)).alias("seconds")))
    # What only scores are made from stays behind; a row for each arm and ratio carries the rest.
    rows = rows.select(*[c for c in rows.columns if c not in ("titled", "asked", "bm25_chunk", "bm25_sentence")], F.inline(F.array(*each))).where("kind NOT IN ('chunk', 'fill') OR scores IS NOT NULL")
    listed = F.array(*[F.lit(float(r)) for r in ratios])
    rows = rows.withColumn("ratio", F.explode(F.when(F.col("kind") == "full", F.array(F.lit(None).cast("double"))).otherwise(listed)))
    limit = F.when(F.col("kind") == "full", F.col("full_tokens")).otherwise(selection.budget(F.col("full_tokens"), F.col("ratio")))
    rows = _once(rows, budget=limit, said=F.element_at(F.filter("texts", lambda t: t["ratio"] == F.col("ratio")), 1))
    c, u, b = F.col("chunks"), F.col("units"), F.col("budget")
    chosen = (
        F.when(F.col("kind") == "chunk", selection.chunk_selection(c, F.col("scores"), F.col("lengths"), b, separator, count))
        .when(F.col("kind") == "sentence", selection.sentence_selection(c, u, F.col("unit_scores"), b, count))
        .when(F.col("kind") == "fill", selection.fill_selection(c, F.col("scores"), F.col("lengths"), u, F.col("unit_scores"), b, separator, count))
        .when(F.col("kind") == "text", selection.selection(F.array(), F.array(), F.col("said.text"), count(F.col("said.text")), F.col("said.truncated")))
        .otherwise(selection.selection(F.sequence(F.lit(0), F.size("chunks") - 1), F.array(), F.col("full_text"), F.col("full_tokens"), F.lit(False)))
    )
    rows = rows.select("*", F.inline(F.array(chosen)))
    recall = (
        F.when(F.col("kind") == "full", F.lit(1.0))
        .when(F.col("kind") == "chunk", F.when(F.col("truncated"), F.lit(0.0)).otherwise(gold_recall(F.col("kept"), F.col("gold_chunks"))))
        .when(F.col("kind") == "fill", F.when(F.size("kept") > 0, gold_recall(F.col("kept"), F.col("gold_chunks"))).otherwise(F.lit(0.0)))
    )
    base = [c if c in docs.columns else F.lit(None).cast("double").alias(c) for c in BASE]
    return rows.select(
        *base, "arm", "ratio", F.size("chunks").alias("num_chunks"), F.size("gold_chunks").alias("n_gold"), "full_tokens", "budget", "kept", "partial", "text", "kept_tokens", "truncated",
        recall.alias("gold_recall"), F.col("seconds"), F.col("said.error").alias("error"), "question", "answers", "gold_chunks")

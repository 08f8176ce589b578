"""Text normalisation and answer metrics as column expressions.

The expressions take texts in Unicode form NFC; in_nfc() brings the columns of a table there, once, before they are used.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Answers that say only yes or no, in English and Vietnamese; English articles.
YES_NO = ("yes", "no", "đúng", "không", "sai", "có")
ARTICLES = ("a", "an", "the")
#: What joins chunks of a context.
CHUNK_SEP = "\n\n"


def nfc(text: Column) -> Column:
    """Unicode form NFC; Spark has no built-in for it."""

    def form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.pandas_udf(form, "string")(text)


def in_nfc(docs: DataFrame, *columns: str) -> DataFrame:
    """docs with texts and lists of texts in form NFC. One Arrow pass over the named columns; nulls stay."""
    kinds = dict(docs.dtypes)

    def lists(texts: pd.Series) -> pd.Series:
        return texts.map(lambda ts: None if ts is None else [None if t is None else unicodedata.normalize("NFC", t) for t in ts])

    listed = F.pandas_udf(lists, "array<string>")
    return docs.withColumns({c: listed(F.col(c)) if kinds[c] == "array<string>" else nfc(F.col(c)) for c in columns})


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def norm(text: Column) -> Column:
    """Lower case without outer white space."""
    return strip(F.lower(text))


def terms(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), "")


def normalize_answer(text: Column) -> Column:
    """terms() without English articles."""
    return F.filter(terms(text), lambda t: ~t.isin(*ARTICLES))


def token_count(text: Column) -> Column:
    """Words between white space; the default of every budget."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), ""))


def is_yes_no(text: Column) -> Column:
    return F.rtrim(norm(text), F.lit(".")).isin(*YES_NO)


def distinct_answers(answers: Column) -> Column:
    """Answers in order, each once, without blank ones."""
    return F.array_distinct(F.filter(answers, lambda a: strip(a) != ""))


def contains_answer(text: Column, answers: Column) -> Column:
    """Whether any answer stands in the text, both normalised; empty answers never do. What is sought begins and ends with other than white space, so the text's own outer white space is left on."""
    low = F.lower(text)
    return F.exists(F.transform(answers, lambda a: norm(a)), lambda a: (a != "") & F.contains(low, a))


def split_sentences(text: Column) -> Column:
    """Sentences by final punctuation or line, trimmed, in order."""
    lines = F.split(text, "\n")
    cut = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?…])\s+(?=\S)")))
    return F.filter(F.transform(cut, lambda s: strip(s)), lambda s: s != "")


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two lists of tokens; only tokens of both are counted."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, t: n + F.least(count(a, t), count(b, t)))


def f1_of_tokens(p: Column, r: Column) -> Column:
    """F1 of two token lists; both empty give 1, one empty 0."""
    common = overlap(p, r)
    empty = (F.size(p) == 0) | (F.size(r) == 0)
    score = 2.0 * common / (F.size(p) + F.size(r))
    return F.when(empty, ((F.size(p) == 0) & (F.size(r) == 0)).cast("double")).otherwise(score)


def _over_answers(prediction: Column, answers: Column, each) -> Column:
    """each(p, r) for the normalised prediction and each normalised answer. Token lists pass through lists of one, so that a text is split once."""
    bound = F.array(F.named_struct(F.lit("p"), normalize_answer(prediction), F.lit("rs"), F.transform(answers, lambda a: normalize_answer(a))))
    return F.flatten(F.transform(bound, lambda x: F.transform(x["rs"], lambda r: each(x["p"], r))))


def answer_scores(prediction: Column, normal: Column) -> Column:
    """(em, f1, recall) as exact_match(), token_f1() and answer_recall() have them; `normal` holds each alias as normalize_answer() has it, and the prediction is split once for all three."""

    def each(x: Column) -> Column:
        def of(r: Column) -> Column:
            common, np, nr = overlap(x, r), F.size(x), F.size(r)
            f1 = F.when((np == 0) | (nr == 0), ((np == 0) & (nr == 0)).cast("double")).otherwise(2.0 * common / (np + nr))
            return F.named_struct(F.lit("em"), (x == r).cast("double"), F.lit("f1"), f1, F.lit("recall"), F.when(nr > 0, common / nr).otherwise(F.lit(0.0)))

        return F.transform(normal, of)

    found = F.transform(F.array(F.flatten(F.transform(F.array(normalize_answer(prediction)), each))), lambda s: F.named_struct(
        *[v for c in ("em", "f1", "recall") for v in (F.lit(c), F.coalesce(F.array_max(F.transform(s, lambda x: x[c])), F.lit(0.0)))]))
    return F.element_at(found, 1)


def token_f1(prediction: Column, answers: Column) -> Column:
    """The best F1 over aliases; 0 without any."""
    return F.coalesce(F.array_max(_over_answers(prediction, answers, f1_of_tokens)), F.lit(0.0))


def exact_match(prediction: Column, answers: Column) -> Column:
    return F.exists(_over_answers(prediction, answers, lambda p, r: p == r), lambda x: x).cast("double")


def answer_recall(prediction: Column, answers: Column) -> Column:
    """The largest share of an alias's tokens that the prediction has; empty aliases don't count."""
    one = lambda p, r: F.when(F.size(r) > 0, overlap(r, p) / F.size(r)).otherwise(F.lit(0.0))
    return F.coalesce(F.array_max(_over_answers(prediction, answers, one)), F.lit(0.0))


def gold_recall(kept: Column, gold: Column) -> Column:
    """The share of gold chunks kept; NULL if there are none."""
    held = F.size(F.filter(gold, lambda g: F.array_contains(kept, g)))
    return F.when(F.size(gold) > 0, held / F.size(gold))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def clean_answer(text: Column, first_line: bool = False) -> Column:
    """An answer without thinking passages and stray tags, cut at the first line or heading if asked."""
    bare = strip(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"</?think>", ""))
    return strip(F.substring_index(F.substring_index(bare, "\n", 1), "###", 1)) if first_line else bare


def reader_tag(name: Column) -> Column:
    return F.replace(F.btrim(name, F.lit("/")), F.lit("/"), F.lit("--"))


def prompt(context: Column, question: Column, language: Column) -> Column:
    """What a reader is asked, in the document's language."""
    vi = F.concat(F.lit("Ngữ cảnh:\n"), context, F.lit("\n\nCâu hỏi: "), question, F.lit("\nTrả lời ngắn gọn:"))
    en = F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nShort answer:"))
    return F.when(language == "vi", vi).otherwise(en)


def chunk_title(chunk: Column, hop: Column) -> Column:
    """The first line of a multi-hop chunk that has more, else empty."""
    return F.when((hop == "multi") & F.contains(chunk, F.lit("\n")), strip(F.substring_index(chunk, "\n", 1))).otherwise(F.lit(""))


def chunk_body(chunk: Column, hop: Column) -> Column:
    """A chunk without its title."""
    titled = chunk_title(chunk, hop) != ""
    return F.when(titled, F.substring(chunk, F.locate("\n", chunk) + 1, F.length(chunk))).otherwise(chunk)


def middle_cut(ids: Column, limit: int) -> Column:
    """A list longer than the limit keeps its head and its tail."""
    head = limit // 2
    tail = limit - head
    cut = F.concat(F.slice(ids, 1, head), F.slice(ids, F.size(ids) - tail + 1, tail)) if head and tail else F.slice(ids, F.size(ids) - tail + 1, tail)
    return F.when(F.size(ids) <= limit, ids).otherwise(cut)

"""Selection under a token budget. Greedy choice skips what doesn't fit and goes on, so it is a fold, not a running sum."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsieve.functions.text import CHUNK_SEP, token_count
from quillsieve.operators.scoring import ranking

_INTS = "array<int>"


def budget(full_tokens: Column, ratio: Column | float) -> Column:
    return F.greatest(F.lit(1), F.ceil(full_tokens / ratio).cast("int"))


def over_budget(kept_tokens: Column, limit: Column, tolerance: float = 0.02) -> Column:
    """Whether a selection keeps more tokens than its budget allows, beyond a tolerance for arms that compress to a rate."""
    return kept_tokens > limit * (1 + tolerance)


def greedy(scores: Column, lengths: Column, limit: Column, separator: int = 0) -> Column:
    """(kept, used): chunks by falling score, each taken if it and its separator still fit; in the order taken."""
    start = F.named_struct(F.lit("kept"), F.array().cast(_INTS), F.lit("used"), F.lit(0))

    def take(a: Column, i: Column) -> Column:
        cost = F.element_at(lengths, i + 1) + F.when(F.size(a["kept"]) > 0, F.lit(separator)).otherwise(F.lit(0))
        fits = a["used"] + cost <= limit
        return F.when(fits, F.named_struct(F.lit("kept"), F.concat(a["kept"], F.array(i)), F.lit("used"), (a["used"] + cost))).otherwise(a)

    return F.aggregate(ranking(scores), start, take)


def joined(chunks: Column, kept: Column) -> Column:
    """Kept chunks in their own order."""
    return F.array_join(F.transform(F.array_sort(kept), lambda i: F.element_at(chunks, i + 1)), CHUNK_SEP)


def head(text: Column, tokens: Column) -> Column:
    """The first tokens of a text, one space between."""
    listed = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return F.array_join(F.slice(listed, F.lit(1), F.greatest(tokens, F.lit(0))), " ")


def select_chunks(chunks: Column, scores: Column, lengths: Column, limit: Column, separator: int = 0) -> Column:
    """(kept, text, kept_tokens, truncated): the greedy choice; if nothing fits the best chunk cut to the budget.

    With counts that add up, as words do, the joined text never exceeds the budget, so none is dropped again.
    """
    best = F.element_at(ranking(scores), 1)

    def of(choice: Column) -> Column:
        none = F.size(choice["kept"]) == 0
        kept = F.when(none, F.array(best)).otherwise(F.array_sort(choice["kept"]))
        text = F.when(none, head(F.element_at(chunks, best + 1), limit)).otherwise(joined(chunks, choice["kept"]))
        return F.named_struct(F.lit("kept"), kept.cast(_INTS), F.lit("text"), text, F.lit("kept_tokens"), token_count(text), F.lit("truncated"), none)

    return F.element_at(F.transform(F.array(greedy(scores, lengths, limit, separator)), of), 1)


def select_sentences(units: Column, scores: Column, limit: Column) -> Column:
    """(keep, opened, used) over units(chunk, text, title_tokens, tokens): a sentence costs its tokens, and its title when its chunk is first opened."""
    start = F.named_struct(F.lit("keep"), F.array().cast(_INTS), F.lit("opened"), F.array().cast(_INTS), F.lit("used"), F.lit(0))

    def take(a: Column, j: Column) -> Column:
        u = F.element_at(units, j + 1)
        cost = u["tokens"] + F.when(F.array_contains(a["opened"], u["chunk"]), F.lit(0)).otherwise(u["title_tokens"])
        grown = F.named_struct(F.lit("keep"), F.concat(a["keep"], F.array(j)), F.lit("opened"), F.array_union(a["opened"], F.array(u["chunk"])), F.lit("used"), (a["used"] + cost))
        return F.when(a["used"] + cost <= limit, grown).otherwise(a)

    return F.aggregate(ranking(scores), start, take)


def fill(units: Column, scores: Column, whole: Column, used: Column, limit: Column, separator: int = 0) -> Column:
    """(keep, opened, used): what is left of a budget filled with the best sentences of chunks that aren't whole.

    A paragraph first touched costs its separator, its title and one; a further sentence one more than its tokens.
    """
    start = F.named_struct(F.lit("keep"), F.array().cast(_INTS), F.lit("opened"), F.array().cast(_INTS), F.lit("used"), used.cast("int"))

    def take(a: Column, j: Column) -> Column:
        u = F.element_at(units, j + 1)
        key = F.coalesce(u["paragraph"], u["chunk"])
        cost = u["tokens"] + 1 + F.when(F.array_contains(a["opened"], key), F.lit(0)).otherwise(u["title_tokens"] + separator)
        grown = F.named_struct(F.lit("keep"), F.concat(a["keep"], F.array(j)), F.lit("opened"), F.array_union(a["opened"], F.array(key)), F.lit("used"), (a["used"] + cost))
        return F.when(~F.array_contains(whole, u["chunk"]) & (a["used"] + cost <= limit), grown).otherwise(a)

    return F.aggregate(ranking(scores), start, take)


def reassembled(units: Column, keep: Column, chunks: Column, whole: Column) -> Column:
    """Kept sentences in their own order, a title once a paragraph, whole chunks in full at their place."""
    kept = F.transform(F.array_sort(F.array_distinct(keep)), lambda j: F.element_at(units, j + 1))
    part = lambda u: F.named_struct(F.lit("at"), u["chunk"], F.lit("kind"), F.lit(1), F.lit("key"), F.coalesce(u["paragraph"], u["chunk"]), F.lit("title"), u["title"], F.lit("text"), u["text"])
    full = F.transform(F.array_sort(F.array_distinct(whole)), lambda i: F.named_struct(F.lit("at"), i, F.lit("kind"), F.lit(0), F.lit("key"), i, F.lit("title"), F.lit(""), F.lit("text"), F.element_at(chunks, i + 1)))
    parts = F.concat(full, F.transform(kept, part))

    def first_of(p: Column) -> Column:
        return F.array_min(F.transform(F.filter(parts, lambda x: (x["kind"] == p["kind"]) & (x["key"] == p["key"])), lambda x: x["at"]))

    keys = F.array_sort(F.array_distinct(F.transform(parts, lambda p: F.named_struct(F.lit("first"), first_of(p), F.lit("kind"), p["kind"], F.lit("key"), p["key"]))))

    def written(k: Column) -> Column:
        own = F.filter(parts, lambda x: (x["kind"] == k["kind"]) & (x["key"] == k["key"]))
        body = F.array_join(F.transform(own, lambda x: x["text"]), " ")
        title = F.element_at(own, 1)["title"]
        return F.when(title != "", F.concat(title, F.lit("\n"), body)).otherwise(body)

    return F.array_join(F.transform(keys, written), CHUNK_SEP)


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value made once however often `of` uses it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def assembled(units: Column, keep: Column, chunks: Column, whole: Column) -> Column:
    """As reassembled(), in one pass: sentences and whole chunks in their order, joined while their paragraph stays the same.

    Units are in document order, and the chunks of a paragraph follow each other.
    """
    item = lambda at, j, key, title, text: F.named_struct(F.lit("at"), at, F.lit("j"), j, F.lit("key"), key, F.lit("title"), title, F.lit("text"), text)
    none = F.lit(None).cast("int")
    full = F.transform(whole.cast(_INTS), lambda i: item(i, F.lit(-1), none, F.lit(""), F.element_at(chunks, i + 1)))
    part = F.transform(F.array_distinct(keep.cast(_INTS)), lambda j: let(F.element_at(units, j + 1), lambda u: item(u["chunk"].cast("int"), j, F.coalesce(u["paragraph"], u["chunk"]).cast("int"), u["title"], u["text"])))
    start = F.named_struct(F.lit("text"), F.lit(None).cast("string"), F.lit("key"), none)

    def add(a: Column, x: Column) -> Column:
        own = F.when(x["title"] != "", F.concat(x["title"], F.lit("\n"), x["text"])).otherwise(x["text"])
        more = F.when(a["key"] == x["key"], F.concat(a["text"], F.lit(" "), x["text"])).otherwise(F.concat(a["text"], F.lit(CHUNK_SEP), own))
        return F.named_struct(F.lit("text"), F.when(a["text"].isNull(), own).otherwise(more), F.lit("key"), x["key"])

    return F.coalesce(F.aggregate(F.array_sort(F.concat(full, part)), start, add, lambda a: a["text"]), F.lit(""))


def fitting(order: Column, text_of: Callable[[Column], Column], count: Callable[[Column], Column], limit: Column) -> Column:
    """(n, text, tokens) of the longest head of `order` whose text, counted anew, is within the limit; n is 0 if there is none."""
    start = F.named_struct(F.lit("n"), F.lit(0), F.lit("text"), F.lit(""), F.lit("tokens"), F.lit(0))
    lengths = F.when(F.size(order) > 0, F.sequence(F.size(order), F.lit(1), F.lit(-1))).otherwise(F.array().cast(_INTS))

    def shorter(a: Column, n: Column) -> Column:
        tried = let(text_of(F.slice(order, 1, n)), lambda t: F.named_struct(F.lit("n"), n, F.lit("text"), t, F.lit("tokens"), count(t)))
        return F.when(a["n"] > 0, a).otherwise(let(tried, lambda x: F.when(x["tokens"] <= limit, x).otherwise(a)))

    return F.aggregate(lengths, start, shorter)


def selection(kept: Column, partial: Column, text: Column, tokens: Column, truncated: Column) -> Column:
    return F.named_struct(
        F.lit("kept"), F.array_sort(kept.cast(_INTS)), F.lit("partial"), F.array_sort(partial.cast(_INTS)), F.lit("text"), text, F.lit("kept_tokens"), tokens.cast("int"), F.lit("truncated"), truncated
    )


def _cut(text: Column, limit: Column, kept: Column, count: Callable[[Column], Column]) -> Column:
    """What is kept if nothing fits: the head of a text."""
    return let(head(text, limit), lambda t: selection(kept, F.array(), t, count(t), F.lit(True)))


def chunk_selection(chunks: Column, scores: Column, lengths: Column, limit: Column, separator: int, count: Callable[[Column], Column]) -> Column:
    """(kept, partial, text, kept_tokens, truncated): chunks by falling score with the separators before them; the text is counted anew, the weakest chunk dropped until it fits."""

    def of(order: Column) -> Column:
        found = let(order, lambda o: let(fitting(o, lambda k: joined(chunks, k), count, limit), lambda f: F.when(f["n"] > 0, selection(F.slice(o, 1, f["n"]), F.array(), f["text"], f["tokens"], F.lit(False)))))
        best = let(F.element_at(ranking(scores), 1), lambda b: _cut(F.element_at(chunks, b + 1), limit, F.array(b), count))
        return F.coalesce(found, best)

    return of(greedy(scores, lengths, limit, separator)["kept"])


def sentence_selection(chunks: Column, units: Column, scores: Column, limit: Column, count: Callable[[Column], Column]) -> Column:
    """As chunk_selection() over sentences; kept are the chunks touched. A document without sentences keeps the head of its first chunk."""
    none = F.array().cast(_INTS)
    touched = lambda keep: F.array_distinct(F.transform(keep, lambda j: F.element_at(units, j + 1)["chunk"]))

    def of(order: Column) -> Column:
        found = let(order, lambda o: let(fitting(o, lambda k: assembled(units, k, chunks, none), count, limit), lambda f: F.when(f["n"] > 0, selection(touched(F.slice(o, 1, f["n"])), F.array(), f["text"], f["tokens"], F.lit(False)))))
        best = let(F.element_at(ranking(scores), 1), lambda b: _cut(assembled(units, F.array(b), chunks, none), limit, touched(F.array(b)), count))
        return F.coalesce(found, F.when(F.size(units) > 0, best).otherwise(_cut(F.element_at(chunks, 1), limit, F.array(F.lit(0)), count)))

    return of(select_sentences(units, scores, limit)["keep"])


def fill_selection(chunks: Column, scores: Column, lengths: Column, units: Column, unit_scores: Column, limit: Column, separator: int, count: Callable[[Column], Column]) -> Column:
    """Whole chunks first, then sentences of the others in what is left (partial: the chunks these are from). Where no chunk fits whole it is sentence selection; where chunks are sentences (paragraph set), chunk selection."""

    def filled(whole: Column) -> Column:
        order = fill(units, unit_scores, whole["kept"], whole["kept_tokens"], limit, separator)["keep"]
        of = lambda o: let(fitting(o, lambda k: assembled(units, k, chunks, whole["kept"]), count, limit), lambda f: F.when(f["n"] > 0, selection(
            whole["kept"], F.array_distinct(F.transform(F.slice(o, 1, f["n"]), lambda j: F.element_at(units, j + 1)["chunk"])), f["text"], f["tokens"], F.lit(False))))
        return F.coalesce(let(order, of), whole)

    def plain(s: Column) -> Column:
        return selection(F.array(), F.when(s["truncated"], F.array().cast(_INTS)).otherwise(s["kept"]), s["text"], s["kept_tokens"], s["truncated"])

    def choose(whole: Column) -> Column:
        sentences = F.exists(units, lambda u: u["paragraph"].isNotNull())
        return F.when(sentences, whole).when(whole["truncated"], let(sentence_selection(chunks, units, unit_scores, limit, count), plain)).otherwise(filled(whole))

    return let(chunk_selection(chunks, scores, lengths, limit, separator, count), choose)

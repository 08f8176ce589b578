"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for other spellings.

The field is trained on a small labelled table that is spelled out below and decoded by Viterbi over
batches of windows. It sees the tokens around digits, at-signs and written-out marks; a text without
any of those has none of the kinds, so no text is left out.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.base import table

KINDS = ("email", "ip", "card", "phone")
_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits matches from its start or not at all, hence the look-behind: it keeps long runs linear.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Whether the digits' check sum ends in 0, every second digit from the right being doubled."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from their at-signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed; code points, end exclusive."""
    found = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# The field's tokens, features and tags.

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
#: Words that tell of a kind, and written-out marks.
CUES = {
    "at": "AT", "arroba": "AT", "dot": "DOT", "punkt": "DOT", "punto": "DOT", "point": "DOT",
    "com": "TLD", "org": "TLD", "net": "TLD", "de": "TLD", "fr": "TLD", "es": "TLD", "io": "TLD", "edu": "TLD", "info": "TLD",
    "tel": "CALL", "phone": "CALL", "call": "CALL", "mobile": "CALL", "cell": "CALL", "fax": "CALL", "telefon": "CALL", "teléfono": "CALL", "téléphone": "CALL", "handy": "CALL",
    "mail": "MAIL", "email": "MAIL", "correo": "MAIL", "courriel": "MAIL", "contact": "MAIL", "write": "MAIL",
    "card": "CARD", "visa": "CARD", "mastercard": "CARD", "amex": "CARD", "karte": "CARD", "tarjeta": "CARD", "carte": "CARD", "credit": "CARD",
    "ip": "IP", "address": "IP", "host": "IP", "server": "IP", "ping": "IP",
    "version": "NUM", "release": "NUM", "page": "NUM", "year": "NUM", "section": "NUM", "line": "NUM", "order": "NUM", "item": "NUM",
}
_SHAPES = ["PAD", "W", "OTHER", *sorted({v for v in CUES.values()}), *(f"D{k}" for k in (1, 2, 3, 4, 6, 9, 12, 19, 99)), *(f"p{c}" for c in ".-()[]{}@+/:,#")]
_SHAPE = {s: i for i, s in enumerate(_SHAPES)}
_OFFSETS = (0, -1, 1, -2, 2, -3, 3)
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Shapes twice (with and without white space before) at each offset, and cue words before.
_WIDTH = 2 * len(_SHAPES)
_CUE_NAMES = sorted(set(CUES.values()))
_FEATURES = _WIDTH * len(_OFFSETS) + len(_CUE_NAMES)


def _shape(token: str) -> int:
    c = token[0]
    if c.isdigit():
        n = len(token)
        return _SHAPE["D" + str(next(k for k in (1, 2, 3, 4, 6, 9, 12, 19, 99) if n <= k or k == 99))]
    if c.isalpha():
        return _SHAPE[CUES.get(token.lower(), "W")]
    return _SHAPE.get("p" + token, _SHAPE["OTHER"])


def _features(shapes: list[int], gaps: list[int]) -> np.ndarray:
    """For each token the numbers of its features, padded with the number past the last."""
    n = len(shapes)
    wide = np.zeros(n + 6, dtype=np.int64)
    wide[3 : n + 3] = 2 * np.array(shapes) + np.array(gaps)
    out = np.full((n, len(_OFFSETS) + 3), _FEATURES, dtype=np.int64)
    for k, o in enumerate(_OFFSETS):
        out[:, k] = k * _WIDTH + wide[3 + o : n + 3 + o]
    cues = [_CUE_NAMES.index(_SHAPES[s]) if _SHAPES[s] in _CUE_NAMES else -1 for s in shapes]
    for i in range(n):
        near = sorted({c for c in cues[max(0, i - 6) : i] if c >= 0})[:3]
        out[i, len(_OFFSETS) : len(_OFFSETS) + len(near)] = [_WIDTH * len(_OFFSETS) + c for c in near]
    return out


def _allowed() -> np.ndarray:
    """0 where a tag may follow another, a large cost where it may not: I only goes on its own kind."""
    cost = np.zeros((len(TAGS), len(TAGS)))
    for i, a in enumerate(TAGS):
        for j, b in enumerate(TAGS):
            if b[0] == "I" and (a == "O" or a[2:] != b[2:]):
                cost[i, j] = -1e4
    return cost


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Field:
    """Weights of features by tag, and of pairs of tags."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def decode(self, windows: list[np.ndarray], cells: int = 200_000) -> list[np.ndarray]:
        """The best tags of each window of features, by Viterbi over batches of windows of like length."""
        order = sorted(range(len(windows)), key=lambda k: len(windows[k]))
        out: list = [None] * len(windows)
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(windows[order[end]]) <= cells:
                end += 1
            group = order[at:end]
            longest = len(windows[group[-1]])
            scores = np.zeros((len(group), longest, len(TAGS)))
            lengths = np.array([len(windows[k]) for k in group])
            for r, k in enumerate(group):
                scores[r, : lengths[r]] = self.emit[windows[k]].sum(axis=1)
            back = np.zeros((len(group), longest, len(TAGS)), dtype=np.int8)
            best = scores[:, 0] + np.where([t[0] == "I" for t in TAGS], -1e4, 0.0)
            move = self.move + _allowed()
            for t in range(1, longest):
                through = best[:, :, None] + move[None]
                choice = through.argmax(axis=1)
                stepped = np.take_along_axis(through, choice[:, None, :], axis=1)[:, 0] + scores[:, t]
                live = (t < lengths)[:, None]
                best = np.where(live, stepped, best)
                back[:, t] = np.where(live, choice, np.arange(len(TAGS)))
            tags = np.zeros((len(group), longest), dtype=np.int64)
            tags[:, -1] = best.argmax(axis=1)
            for t in range(longest - 1, 0, -1):
                tags[:, t - 1] = np.take_along_axis(back[:, t], tags[:, t][:, None], axis=1)[:, 0]
            for r, k in enumerate(group):
                out[k] = tags[r, : lengths[r]]
            at = end
        return out


def labelled_table() -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The labelled rows: texts with the spans of personal data in them."""
    rng = random.Random(11)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: rng.choice(["ana", "j.roe", "Max", "kim", "lee.w", "Zoë", "omar", "pat", "info", "sales", "thande", "ouvier"])
    word = lambda: rng.choice(["the", "was", "stone", "river", "onha", "ered", "que", "ist", "Thndly", "ción", "paper", "and", "to", "in"])
    tld = lambda: rng.choice(["com", "org", "net", "de", "io"])
    kinds = {
        "email": [
            lambda: f"{name()} at {word()} dot {tld()}", lambda: f"{name()} (at) {word()} (dot) {tld()}", lambda: f"{name()} [at] {word()} [dot] {tld()}",
            lambda: f"{name()}(at){word()}.{tld()}", lambda: f"{name()} @ {word()}.{tld()}", lambda: f"{name()} arroba {word()} punto {tld()}",
            lambda: f"{name()}@{word()} dot {tld()}", lambda: f"{name()} at {word()} dot {word()} dot {tld()}",
        ],
        "ip": [lambda: f"{d(2)} dot {d(3)} dot {d(1)} dot {d(2)}", lambda: f"{d(2)}[.]{d(3)}[.]{d(1)}[.]{d(2)}", lambda: f"{d(3)}(.){d(2)}(.){d(2)}(.){d(1)}"],
        "card": [lambda: f"{d(4)}.{d(4)}.{d(4)}.{d(4)}", lambda: f"{d(4)}/{d(4)}/{d(4)}/{d(4)}", lambda: f"{d(4)} - {d(4)} - {d(4)} - {d(4)}"],
        "phone": [
            lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)} {d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"00{d(2)} {d(3)} {d(6)}",
        ],
    }
    lead = {"email": ["mail", "contact", "write to", "email:", "", ""], "ip": ["ip", "host", "server", ""], "card": ["card", "visa", "credit card:", "pay by"], "phone": ["call", "tel", "phone:", "fax", "mobile", "reach us", ""]}
    plain = [
        lambda: f"version {d(1)}.{d(1)}", lambda: f"in 19{d(2)} and 20{d(2)}", lambda: f"{d(2)}.{d(2)}.20{d(2)}", lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(1)},{d(3)},{d(3)}",
        lambda: f"page {d(3)}", lambda: f"order {d(8)}", lambda: f"{d(1)}.{d(2)} and {d(2)}%", lambda: f"({d(4)})", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"item {d(12)}", lambda: f"section {d(1)}.{d(1)}.{d(1)}.",
        lambda: f"{word()} at {word()}", lambda: f"at {d(2)} {word()}", lambda: f"a dot on {word()}", lambda: f"{d(16)}", lambda: f"{word()} {d(4)} {d(4)}", lambda: f"{word()}@{word()}", lambda: f"{d(3)}-{d(3)}", lambda: f"{d(5)} {word()} {d(2)}",
        lambda: f"release {d(1)}.{d(1)}.{d(2)}.{d(1)}", lambda: f"= {d(3)} - {d(3)} = {d(3)}", lambda: f"{word()} de {word()} com {d(1)}", lambda: f"line {d(3)}-{d(3)}-{d(2)}",
    ]
    rows = []
    for k in range(420):
        before = " ".join(word() for _ in range(rng.randint(0, 5)))
        after = " ".join(word() for _ in range(rng.randint(0, 5)))
        kind = ("email", "phone", "ip", "card", None, None, None)[k % 7]
        if kind:
            cue = rng.choice(lead[kind])
            head = " ".join(x for x in (before, cue) if x)
            head += " " if head else ""
            what = rng.choice(kinds[kind])()
            rows.append((head + what + rng.choice([" ", ". ", ", "]) + after, [(len(head), len(head) + len(what), kind)]))
        else:
            rows.append((" ".join((before, rng.choice(plain)(), after)), []))
    return rows


def _tokens(text: str, start: int = 0, end: int | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    spans = [m.span() for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]
    shapes = [_shape(text[a:b]) for a, b in spans]
    gaps = [int(a == 0 or text[a - 1].isspace()) for a, _ in spans]
    return spans, _features(shapes, gaps) if spans else np.zeros((0, len(_OFFSETS) + 3), dtype=np.int64)


@functools.lru_cache(maxsize=1)
def trained(rounds: int = 70) -> Field:
    """The field with the likeliest tags on the labelled table, by Adam on its log-likelihood with a ridge."""
    rows, wanted = [], []
    for text, truth in labelled_table():
        spans, feats = _tokens(text)
        tags = np.zeros(len(spans), dtype=np.int64)
        for a, b, kind in truth:
            inside = [k for k, (x, y) in enumerate(spans) if x >= a and y <= b]
            tags[inside] = TAGS.index(f"I-{kind}")
            tags[inside[0]] = TAGS.index(f"B-{kind}")
        if len(spans):
            rows.append(feats)
            wanted.append(tags)
    b, t, k = len(rows), max(map(len, rows)), len(TAGS)
    x = np.full((b, t, rows[0].shape[1]), _FEATURES, dtype=np.int64)
    y, mask = np.zeros((b, t), dtype=np.int64), np.zeros((b, t), dtype=bool)
    for r, (feats, tags) in enumerate(zip(rows, wanted, strict=True)):
        x[r, : len(feats)], y[r, : len(tags)], mask[r, : len(tags)] = feats, tags, True
    emit, move, block = np.zeros((_FEATURES + 1, k)), np.zeros((k, k)), _allowed()
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (emit, move)]
    gold = np.zeros((b, t, k))
    np.put_along_axis(gold, y[:, :, None], 1.0, axis=2)
    gold *= mask[:, :, None]
    gold_move = np.zeros((k, k))
    both = mask[:, 1:]
    np.add.at(gold_move, (y[:, :-1][both], y[:, 1:][both]), 1.0)
    first = np.where([tag[0] == "I" for tag in TAGS], -1e4, 0.0)
    for step in range(1, rounds + 1):
        score = emit[x].sum(axis=2)
        m = move + block
        alpha = np.zeros((b, t, k))
        alpha[:, 0] = score[:, 0] + first
        for i in range(1, t):
            alpha[:, i] = np.where(mask[:, i, None], _logsumexp(alpha[:, i - 1, :, None] + m, 1) + score[:, i], alpha[:, i - 1])
        beta = np.zeros((b, t, k))
        for i in range(t - 2, -1, -1):
            beta[:, i] = np.where(mask[:, i + 1, None], _logsumexp(m[None] + (score[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0.0)
        total = _logsumexp(alpha[:, -1], 1)
        here = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
        pair = np.exp(alpha[:, :-1, :, None] + m + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * both[:, :, None, None]
        grad_emit = np.zeros_like(emit)
        np.add.at(grad_emit, x.reshape(-1), np.repeat((here - gold).reshape(-1, k), x.shape[2], axis=0))
        grads = grad_emit / b + 1e-3 * emit, (pair.sum(axis=(0, 1)) - gold_move) / b + 1e-3 * move
        for p, g, (first_moment, second) in zip((emit, move), grads, moments, strict=True):
            first_moment += 0.1 * (g - first_moment)
            second += 0.001 * (g * g - second)
            p -= 0.15 * (first_moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        emit[-1] = 0.0
    return Field(emit, move)


_SEED = re.compile(r"[0-9@]")
_WRITTEN = re.compile(r"\s(?:dot|arroba|punto|punkt|point)(?=\s)|[(\[{](?:at|dot)[)\]}]", re.I)
#: Code points around a seed that are read.
REACH = 80


def windows(text: str) -> list[tuple[int, int]]:
    """The stretches of a text around digits, at-signs and written-out marks, merged where they meet."""
    at = [m.start() for m in _SEED.finditer(text)]
    at += [m.start() for m in _WRITTEN.finditer(text)]
    out: list[list[int]] = []
    for p in sorted(at):
        a, b = max(0, p - REACH), min(len(text), p + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    for w in out:  # to word boundaries
        while w[0] > 0 and text[w[0] - 1].isalnum():
            w[0] -= 1
        while w[1] < len(text) and text[w[1]].isalnum():
            w[1] += 1
    return [(a, b) for a, b in out]


def _sound(kind: str, span: str) -> bool:
    """Whether a span of the field can be of its kind."""
    digits = sum(c.isdigit() for c in span)
    low = span.lower()
    if kind == "email":
        return ("@" in span or "at" in low or "arroba" in low) and ("." in span or "dot" in low or "punto" in low or "punkt" in low or "point" in low)
    if kind == "ip":
        parts = re.findall("[0-9]+", span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        only = re.sub("[^0-9]", "", span)
        return 14 <= len(only) <= 19 and luhn(only)
    return 9 <= digits <= 15


def find_all(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """For each text its base spans, and all spans with those that the field adds beside them."""
    bases, cut, owner = [], [], []
    for k, text in enumerate(texts):
        bases.append(base_spans(text))
        for a, b in windows(text):
            spans, feats = _tokens(text, a, b)
            if spans:
                cut.append((spans, feats))
                owner.append(k)
    extra: list[list] = [[] for _ in texts]
    for (spans, _), tags, k in zip(cut, field.decode([f for _, f in cut]), owner, strict=True):
        at = 0
        while at < len(tags):
            tag = TAGS[tags[at]]
            end = at + 1
            if tag != "O":
                while end < len(tags) and TAGS[tags[end]] == f"I-{tag[2:]}":
                    end += 1
                a, b, kind = spans[at][0], spans[end - 1][1], tag[2:]
                if _sound(kind, texts[k][a:b]) and all(b <= x or a >= y for x, y, _ in bases[k] + extra[k]):
                    extra[k].append((a, b, kind))
            at = end
    return [(base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))) for base, more in zip(bases, extra, strict=True)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row of docs(doc_id, text).

    The numbers count base spans. Null and empty texts have none; repeated rows appear once each;
    other columns are ignored; an empty table gives no rows.
    """
    field = field or trained()
    ddl = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_all([t or "" for t in batch.column("text").to_pylist()], field)
            columns = [batch.column("doc_id")]
            columns += [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            columns.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()))
            columns.append(pa.array([joined(every) for _, every in found], pa.string()))
            columns.append(pa.array([len(every) - len(base) for base, every in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)


def op5(spark, sf_dir) -> DataFrame:
    """Personal data in all documents."""
    return personal_data(table(spark, sf_dir, "documents"))

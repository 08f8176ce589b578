"""Secret scans: fixed patterns, and a character convolutional network over every other candidate in its context."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.base import table

KINDS = ("assign", "access", "hex")
#: The kind of spans that the network adds.
ADDED = "token"
#: Share of labelled secrets, held out of training, that the threshold must find; it is never below one half.
RECALL, LEAST = 0.97, 0.5
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed; code points, end exclusive."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of 16 or more key characters that hold a digit and a letter."""
    return [m.span() for m in _CANDIDATE.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]


# The network: one-hot characters with a channel for the candidate's own place, a convolution, the largest and the
# mean of each filter inside the candidate and the largest outside it, a logistic layer.

_LETTERS = " " + string.ascii_letters + string.digits + "+/_=-.:\"'(){}[]<>,;#@\n"
_CODE = np.full(128, len(_LETTERS), dtype=np.int64)
for _k, _c in enumerate(_LETTERS):
    _CODE[ord(_c)] = _k
_CHANNELS = len(_LETTERS) + 1
WIDTH, FILTERS, BEFORE, INSIDE, AFTER = 4, 24, 24, 48, 8
SPAN = BEFORE + INSIDE + AFTER


def _encode(text: str, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the surrounding and the candidate's characters, and which are its own; a long candidate goes by its stretches."""
    window = (" " * max(0, BEFORE - a) + text[max(0, a - BEFORE) : min(b, a + INSIDE)]).ljust(BEFORE + INSIDE) + text[b : b + AFTER].ljust(AFTER)
    raw = np.array([ord(c) for c in window])
    own = np.zeros(SPAN)
    own[BEFORE : BEFORE + min(b - a, INSIDE)] = 1.0
    return np.where(raw < 128, _CODE[np.minimum(raw, 127)], len(_LETTERS)), own


def _stretches(a: int, b: int) -> list[tuple[int, int]]:
    """A candidate in stretches that the network can see whole, the last reaching its end."""
    if b - a <= INSIDE:
        return [(a, b)]
    starts = list(range(a, b - INSIDE, INSIDE)) + [b - INSIDE]
    return [(s, s + INSIDE) for s in starts]


class Network:
    def __init__(self, filters: np.ndarray, place: np.ndarray, bias: np.ndarray, top: np.ndarray, top_bias: float, scale: float = 1.0, shift: float = 0.0, threshold: float = 0.5):
        self.filters, self.place, self.bias, self.top, self.top_bias = filters, place, bias, top, top_bias
        self.scale, self.shift, self.threshold = scale, shift, threshold

    def _layers(self, codes: np.ndarray, own: np.ndarray):
        steps = SPAN - WIDTH + 1
        z = np.zeros((len(codes), steps, FILTERS)) + self.bias
        for k in range(WIDTH):
            z += self.filters[k][codes[:, k : k + steps]] + own[:, k : k + steps, None] * self.place[k]
        h = np.maximum(z, 0.0)
        inside = own[:, :steps, None]
        held = h * inside
        outside = h * (1 - inside)
        count = np.maximum(inside.sum(axis=1), 1.0)
        pooled = np.hstack([held.max(axis=1), held.sum(axis=1) / count, outside.max(axis=1)])
        return h, inside, held, outside, count, pooled

    def logits(self, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        return np.concatenate([self._layers(codes[i : i + 512], own[i : i + 512])[-1] @ self.top + self.top_bias for i in range(0, len(codes), 512)]) if len(codes) else np.zeros(0)

    def probabilities(self, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(codes, own) + self.shift, -30, 30)))


def labelled_findings(seed: int, rows: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): candidates in context, secret (1) or not (0); spelled out here, nothing is read."""
    rng = random.Random(seed)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    mixed, lower, b64 = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/"
    syllables = ["the", "an", "er", "on", "que", "ción", "sch", "eau", "ment", "ing", "tion", "re", "data", "user", "file", "page", "item", "index", "main", "test"]
    plain = lambda n: "".join(rng.choice([s for s in syllables if s.isascii()]) for _ in range(n))
    word = lambda: rng.choice(["the", "was", "ered", "river", "ist", "que", "of", "thndly", "paper", "stone"])
    secrets = [
        lambda: ("sk_live_" + pick(mixed, rng.randint(20, 32))), lambda: ("ghp_" + pick(mixed, 36)), lambda: ("xoxb-" + pick(string.digits, 11) + "-" + pick(mixed, 24)),
        lambda: pick(b64, rng.randint(28, 44)) + rng.choice(["", "=", "=="]), lambda: pick(mixed, rng.randint(24, 48)), lambda: pick(lower, rng.randint(28, 40)),
        lambda: ("eyJ" + pick(b64, rng.randint(30, 44))), lambda: ("AIza" + pick(mixed + "_-", 35)), lambda: ("glpat-" + pick(mixed, 20)),
    ]
    leads = ["key = ", "auth: ", "Authorization: Bearer ", "credential=", "export KEY=", "client_key: '", "bearer ", "pass: ", ""]
    clean = [
        lambda: plain(rng.randint(4, 8)) + pick(string.digits, rng.randint(1, 3)), lambda: f"{plain(2)}-{plain(2)}-{plain(2)}-{rng.randint(1, 99)}", lambda: f"{plain(2)}_{plain(3)}_{rng.randint(1, 2030)}",
        lambda: f"20{rng.randint(10, 30)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T{rng.randint(10, 23)}", lambda: f"{plain(2)}/{plain(3)}/{rng.randint(1, 9999)}", lambda: plain(3).upper() + "-" + pick(string.digits, 6),
        lambda: pick(string.digits, rng.randint(15, 20)) + rng.choice("abx"), lambda: f"{pick('0123456789abcdef', 8)}-{pick('0123456789abcdef', 4)}-{pick('0123456789abcdef', 4)}", lambda: "=" * rng.randint(8, 20) + plain(2) + "1" + "=" * rng.randint(8, 20),
        lambda: plain(1).title() + plain(2).title() + plain(2).title() + plain(1).title() + str(rng.randint(1, 9)), lambda: "a1" * rng.randint(8, 20), lambda: f"id_{rng.randint(10**9, 10**11)}_{plain(3)}",
    ]
    out = []
    for k in range(rows):
        label = k % 2
        head = " ".join(word() for _ in range(rng.randint(0, 6)))
        head += " " if head else ""
        head += rng.choice(leads) if label or rng.random() < 0.2 else rng.choice(["see ", "file ", "at ", "id ", "from ", "", ""])
        what = (rng.choice(secrets) if label else rng.choice(clean))()
        out.append((head + what + rng.choice([" ", "' ", "\n", ", "]) + " ".join(word() for _ in range(rng.randint(0, 3))), len(head), len(head) + len(what), label))
    return out


def _matrix(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, own = zip(*(_encode(t, a, min(b, a + INSIDE)) for t, a, b, _ in rows), strict=True)
    return np.array(codes), np.array(own), np.array([y for *_, y in rows], dtype=float)


@functools.lru_cache(maxsize=1)
def trained(epochs: int = 6) -> Network:
    """A network fitted to labelled findings by Adam; scale, shift and threshold come from rows held out of that.

    Platt scaling with smoothed targets calibrates the outputs. The threshold is the largest
    probability at which RECALL of the held-out secrets are found, which gives the fewest false
    alarms under that constraint.
    """
    rng = np.random.default_rng(5)
    codes, own, y = _matrix(labelled_findings(1, 2400))
    net = Network(rng.normal(0, 0.1, (WIDTH, _CHANNELS, FILTERS)), rng.normal(0, 0.1, (WIDTH, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 3 * FILTERS), 0.0)
    held = [net.filters, net.place, net.bias, net.top]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in held]
    steps, tick = SPAN - WIDTH + 1, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 64):
            at = order[i : i + 64]
            h, inside, kept, outside, count, pooled = net._layers(codes[at], own[at])
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.top + net.top_bias, -30, 30)))
            error = (p - y[at]) / len(at)
            down = error[:, None] * net.top[None]
            grad = np.zeros_like(h)
            rows, cols = np.arange(len(at))[:, None], np.arange(FILTERS)[None]
            grad[rows, kept.argmax(axis=1), cols] += down[:, :FILTERS]
            grad += inside * (down[:, FILTERS : 2 * FILTERS] / count)[:, None, :]
            grad[rows, outside.argmax(axis=1), cols] += down[:, 2 * FILTERS :]
            grad *= h > 0
            g_filters, g_place = np.zeros_like(net.filters), np.zeros_like(net.place)
            flat = grad.reshape(-1, FILTERS)
            for k in range(WIDTH):
                np.add.at(g_filters[k], codes[at][:, k : k + steps].reshape(-1), flat)
                g_place[k] = (own[at][:, k : k + steps, None] * grad).sum(axis=(0, 1))
            grads = [g_filters + 1e-5 * net.filters, g_place, grad.sum(axis=(0, 1)), pooled.T @ error + 1e-4 * net.top]
            net.top_bias -= 0.01 * error.sum() * len(at) ** 0.5
            tick += 1
            for q, g, (m, v) in zip(held, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= 0.01 * (m / (1 - 0.9**tick)) / (np.sqrt(v / (1 - 0.99**tick)) + 1e-8)
    codes, own, y = _matrix(labelled_findings(2, 1200))
    z = net.logits(codes, own)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        gradient = np.array([((p - target) * z).sum() + 0.01 * (a - 1), (p - target).sum()])
        hessian = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.linalg.solve(hessian, gradient)
    net.scale, net.shift = float(a), float(b)
    p = net.probabilities(codes, own)
    net.threshold = max(LEAST, float(np.quantile(p[y == 1], 1 - RECALL)))
    return net


def find_all(texts: list[str], net: Network) -> list[tuple[list, list]]:
    """For each text its base spans, and all spans with those that the network adds beside them."""
    bases, codes, own, where = [], [], [], []
    for k, text in enumerate(texts):
        base = base_spans(text)
        bases.append(base)
        for a, b in candidates(text):
            for s, e in _stretches(a, b):
                c, o = _encode(text, s, e)
                codes.append(c)
                own.append(o)
                where.append((k, a, b))
    extra: list[list] = [[] for _ in texts]
    if where:
        best: dict = {}
        for i in range(0, len(where), 4096):
            for at, p in zip(where[i : i + 4096], net.probabilities(np.array(codes[i : i + 4096]), np.array(own[i : i + 4096])), strict=True):
                best[at] = max(best.get(at, 0.0), float(p))
        for (k, a, b), p in best.items():
            if p >= net.threshold and all(b <= x or a >= y for x, y, _ in bases[k]):
                extra[k].append((a, b, ADDED))
    rank = (*KINDS, ADDED)
    return [(base, sorted(base + more, key=lambda s: (s[0], rank.index(s[2])))) for base, more in zip(bases, extra, strict=True)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def secrets(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added) of every row of docs(doc_id, text).

    The numbers count base spans. Null and empty texts have none; repeated rows appear once each;
    other columns are ignored; an empty table gives no rows.
    """
    net = net or trained()
    ddl = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_all([t or "" for t in batch.column("text").to_pylist()], net)
            columns = [batch.column("doc_id")]
            columns += [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            columns.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()))
            columns.append(pa.array([joined(every) for _, every in found], pa.string()))
            columns.append(pa.array([len(every) - len(base) for base, every in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)


def op6(spark, sf_dir) -> DataFrame:
    """Secrets in all documents."""
    return secrets(table(spark, sf_dir, "documents"))

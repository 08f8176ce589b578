"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become tags (insult, threat, target, negation, reporting, other). Deterministic transducers
rewrite an insult or threat in the scope of a negation or of reported speech and tell whether its
clause has a target; their composition is one machine, run over the clauses that hold an insult or
a threat. A document's score is a logistic function of what its clauses matched. The insults and
all weights are learned from labelled rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.base import checked_broadcast, dropped, free_name, row_hash, stored, table

#: Labelled rows of each class that are learned from, on average, chosen by a hash of doc_id; all, if there are fewer.
SAMPLE = 4000
#: A score from here on is predicted toxic.
CUT = 0.7
#: Nats that a learned insult must show beyond the logarithm of how many candidates were tried.
EVIDENCE = 2.0
#: Lengths of word beginnings that may stand for their words.
STEMS = range(3, 9)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Closed word classes of the grammar, in four languages.
TARGETS = frozenset("you your yours yourself u he she they them him her his their du dich dir dein deine ihr euch sie er tu te toi ton ta tes vous votre vos il elle ils usted ustedes tú ti vosotros él ella ellos".split())
NEGATIONS = frozenset("not no never neither nor without don't isn't aren't nicht kein keine nie niemals ohne pas jamais aucun sans ne nunca jamás ni sin tampoco".split())
REPORTS = frozenset("said says say saying told tells wrote writes quoted quotes called calls claimed according reported sagte sagt schrieb zitierte dit disait écrit dijo dice escribió según selon laut".split())
THREATS = frozenset("kill hurt destroy beat shoot stab punch murder strangle töten verletzen umbringen schlagen tuer frapper blesser matar golpear herir".split())

#: Odd multipliers that order word hashes anew.
_ODD = np.random.default_rng(7).integers(1 << 62, 1 << 63, 18, dtype=np.uint64) | np.uint64(1)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLAUSE = re.compile(r"[^.!?;:,()\n\"«»„“”]+")


class Transducer:
    """A deterministic weighted transducer: arcs[state, symbol] is (next state, output, weight); others copy and stay."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def compose(self, then: Transducer, symbols: list) -> Transducer:
        """This machine's output fed into `then`, as one machine over the given inputs."""
        arcs, todo, seen = {}, [(self.start, then.start)], {(self.start, then.start)}
        while todo:
            at = todo.pop()
            for x in symbols:
                to1, mid, w1 = self.step(at[0], x)
                to2, out, w2 = then.step(at[1], mid)
                arcs[at, x] = (to1, to2), out, w1 + w2
                if (to1, to2) not in seen:
                    seen.add((to1, to2))
                    todo.append((to1, to2))
        return Transducer((self.start, then.start), arcs)

    def run(self, symbols) -> tuple[list, float]:
        state, out, total = self.start, [], 0.0
        for x in symbols:
            state, y, w = self.step(state, x)
            out.append(y)
            total += w
        return out, total


def _scope(opener: int, reach: int, mark: str) -> Transducer:
    """Marks insults and threats up to `reach` words after an opener."""
    marked = lambda x: (x[0], x[1] | {mark})
    arcs = {}
    for x in _alphabet():
        for left in range(reach + 1):
            if x[0] == opener:
                arcs[left, x] = reach, x, 0.0
            elif left:
                arcs[left, x] = left - 1, marked(x) if x[0] in (INSULT, THREAT) else x, 0.0
    return Transducer(0, arcs)


def _target() -> Transducer:
    """Marks insults and threats after a target of the same clause; run both ways, it tells of one anywhere."""
    arcs = {}
    for x in _alphabet():
        for seen in (0, 1):
            if x[0] == TARGET:
                arcs[seen, x] = 1, x, 0.0
            elif seen and x[0] in (INSULT, THREAT):
                arcs[seen, x] = 1, (x[0], x[1] | {"target"}), 0.0
    return Transducer(0, arcs)


def _alphabet() -> list:
    """Tags with the marks that machines before may have set."""
    sets = [frozenset(m for m, b in zip(("negated", "reported"), bits, strict=True) if b) for bits in ((0, 0), (1, 0), (0, 1), (1, 1))]
    return [(t, s) for t in range(6) for s in (sets if t in (INSULT, THREAT) else sets[:1])]


def grammar() -> Transducer:
    """The composed machine over plain tags."""
    plain = [(t, frozenset()) for t in range(6)]
    return _scope(NEGATION, 3, "negated").compose(_scope(REPORT, 12, "reported"), plain).compose(_target(), plain)


FEATURES = ("insult", "insult_target", "insult_negated", "insult_reported", "threat", "threat_target", "threat_off", "repeated", "strong", "dense")


@dataclass
class Model:
    """Learned insults (whole words and word beginnings, with weights) and the logistic weights of FEATURES."""

    whole: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.lengths = sorted({len(s) for s in self.stems})
        self.machine = grammar()

    def insult(self, word: str) -> float:
        """The weight of a word as an insult, 0 if it is none."""
        found = self.whole.get(word, 0.0)
        for k in self.lengths:
            if len(word) >= k:
                found = max(found, self.stems.get(word[:k], 0.0))
        return found

    def tag(self, word: str) -> int:
        if self.insult(word):
            return INSULT
        return THREAT if word in THREATS else TARGET if word in TARGETS else NEGATION if word in NEGATIONS else REPORT if word in REPORTS else OTHER

    def clauses(self, text: str) -> Iterator[tuple[str, list, list]]:
        """Each clause with an insult or a threat: its text, its words and the marked tags."""
        low = text.lower()
        known = {w for w in set(_WORD.findall(low)) if self.insult(w) or w in THREATS}
        if not known:
            return
        for m in _CLAUSE.finditer(low):
            words = _WORD.findall(m[0])
            if known.isdisjoint(words):
                continue
            tags = [(self.tag(w), frozenset()) for w in words]
            marked, _ = self.machine.run(tags)
            if any(t[0] == TARGET for t in tags):
                marked = [(t, s | {"target"}) if t in (INSULT, THREAT) else (t, s) for t, s in marked]
            yield m[0], words, marked

    def features(self, text: str) -> np.ndarray:
        x, strong, insults, total = np.zeros(len(FEATURES)), 0.0, 0, 1
        for _, words, marked in self.clauses(text):
            total += len(words)
            for w, (t, s) in zip(words, marked, strict=True):
                if t == INSULT:
                    insults += 1
                    strong = max(strong, self.insult(w))
                    x[3 if "reported" in s else 2 if "negated" in s else 1 if "target" in s else 0] += 1
                elif t == THREAT:
                    x[6 if s & {"negated", "reported"} else 5 if "target" in s else 4] += 1
        x = np.minimum(x, 3.0)
        x[7], x[8], x[9] = min(insults, 6) / 3.0, strong / 10.0, float(insults > 0)
        return x

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.features(text or "") @ self.weights)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _evidence(a: float, b: float, n1: int, n0: int) -> float:
    """Nats by which a toxic and b other documents speak for a word beyond chance; 0 if it isn't on the toxic side."""
    if a * n0 <= b * n1:
        return 0.0
    p, q = n1 / (n1 + n0), a / (a + b)
    return a * math.log(q / p) + (b * math.log((1 - q) / (1 - p)) if b else 0.0)


def _evidences(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """_evidence() of many at once."""
    p, q = n1 / (n1 + n0), np.maximum(a, 1e-300) / np.maximum(a + b, 1e-300)
    both = a * np.log(q / p) + b * np.log(np.maximum(1 - q, 1e-300) / (1 - p))
    return np.where(a * n0 <= b * n1, 0.0, both)


def _keys(words) -> Counter:
    """Whole words (True) and word beginnings (False) of a document, the latter counted up to two different words."""
    out = Counter({(w, True): 1 for w in words})
    stems = Counter((w[:k], False) for w in words for k in STEMS if len(w) > k)
    out.update({k: min(2, n) for k, n in stems.items()})
    return out


def _minima(words: list[str]) -> list[int]:
    """Six bands of three minima of word hashes."""
    h = np.array([zlib.crc32(w.encode()) for w in words] or [0], dtype=np.uint64)
    return ((h[:, None] * _ODD[None, :]) >> np.uint64(32)).min(axis=0).tolist()


def _unlike(marks: list[dict]) -> list[dict]:
    """marks(toxic, n, head, minima) without near copies of earlier ones: those that share three minima in one of six bands."""
    seen, out = set(), []
    for mark in sorted(marks, key=lambda m: (m["toxic"], m["n"], m["head"], m["minima"])):
        bands = {(b, *mark["minima"][3 * b : 3 * b + 3]) for b in range(6)}
        if seen.isdisjoint(bands):
            out.append(mark)
        seen |= bands
    return out


def _tallies(docs: DataFrame) -> pa.Table:
    """(key, whole, docs, times) of the keys of docs(words) that three documents or more have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            having, times = Counter(), Counter()
            for words in batch.column("words").to_pylist():
                own = _keys(words)
                having.update(own.keys())
                times.update(own)
            columns = [k for k, _ in having], [w for _, w in having], list(having.values()), [times[k] for k in having]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["key", "whole", "docs", "times"])

    counted = docs.select("words").mapInArrow(count, "key string, whole boolean, docs long, times long")
    return counted.groupBy("key", "whole").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times")).where("docs >= 3").toArrow()


def _found(docs: DataFrame, place: dict) -> DataFrame:
    """(at, times): for each of docs(words) the places of its keys that have one, and how often it has them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [{place[k]: n for k, n in _keys(words).items() if k in place} for words in batch.column("words").to_pylist()]
            lists = [[list(x) for x in own], [list(x.values()) for x in own]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32())) for x in lists], names=["at", "times"])

    return docs.select("words").mapInArrow(find, "at array<int>, times array<int>")


def learn_insults(seen: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Whole words and word beginnings that mark toxic documents, with weights, from seen(id, words, minima, toxic).

    The best is taken, the documents that it explains are set aside, and so on until what is left
    gives none beyond chance among as many as were tried. Near copies of a row count once. Keys are
    counted where the documents lie: the driver gets signatures, the keys of three toxic documents
    or more with their numbers, and the places of those that may be chosen.
    """
    kept = _unlike(seen.select("id", "toxic", F.size("words").alias("n"), F.slice("words", 1, 3).alias("head"), "minima").toArrow().to_pylist())
    n1 = sum(m["toxic"] for m in kept)
    n0 = len(kept) - n1
    if not n1 or not n0:
        return {}, {}
    held = seen.join(F.broadcast(seen.sparkSession.createDataFrame([(m["id"],) for m in kept], "id long")), "id", "left_semi")
    del kept
    common = _tallies(held.where("toxic = 1"))
    keys = list(zip(common.column("key").to_pylist(), common.column("whole").to_pylist(), strict=True))
    count1, count0 = common.column("times").to_numpy(), np.zeros(len(keys), dtype=np.int64)
    pairs = _found(held.where("toxic = 0"), {k: i for i, k in enumerate(keys)}).select(F.explode(F.arrays_zip("at", "times")).alias("x"))
    others = pairs.groupBy("x.at").agg(F.sum("x.times").alias("times")).toArrow()
    count0[others.column("at").to_numpy()] = others.column("times").to_numpy()
    fit = np.flatnonzero(count0 <= 0.02 * (n0 / n1) * count1)
    names, every, b = [keys[i] for i in fit], count1[fit], count0[fit]
    least = math.log(max(1, len(fit))) + EVIDENCE
    exact = lambda n, i: _evidence(int(n[i]), int(b[i]), n1, n0)
    rank = lambda n: lambda i: (round(exact(n, i), 6), names[i][1], len(names[i][0]), names[i][0])
    own = _found(held.where("toxic = 1"), {k: i for i, k in enumerate(names)}).toArrow()
    left = [(at.values.to_numpy(), times.values.to_numpy()) for at, times in zip(own.column("at"), own.column("times"), strict=True)]
    chosen, live = [], every.copy()
    while live.any():
        about = _evidences(live, b, n1, n0)
        best = max(np.flatnonzero((live > 0) & (about >= about.max() - 1e-5)).tolist(), key=rank(live))
        if exact(live, best) < least:
            break
        chosen.append(best)
        stay = []
        for at, times in left:
            if best in at:
                live[at] -= times
            else:
                stay.append((at, times))
        left = stay
    # Words that mostly come with others still have their evidence over all rows.
    likely = [i for i in np.flatnonzero(_evidences(every, b, n1, n0) >= 1.5 * least - 1e-5).tolist() if exact(every, i) >= 1.5 * least]
    stems = {names[i][0] for i in likely if not names[i][1]}
    spread = Counter(w[:n] for w, is_whole in keys if is_whole for n in STEMS if len(w) > n and w[:n] in stems)
    covered = lambda k: any(k[0] == c[0] or not c[1] and k[0].startswith(c[0]) or not k[1] and c[0].startswith(k[0]) for c in (names[i] for i in chosen))
    for i in sorted(likely, key=rank(every), reverse=True):
        if not covered(names[i]) and (names[i][1] or spread[names[i][0]] >= 3):
            chosen.append(i)
    weight = {names[i]: min(10.0, math.log((every[i] + 0.5) / n1) - math.log((b[i] + 0.5) / n0)) for i in chosen}
    return {k[0]: w for k, w in weight.items() if k[1]}, {k[0]: w for k, w in weight.items() if not k[1]}


def fit_weights(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 0.02, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge, by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), decay * max(1.0, weight.sum() / 1000))
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + ridge * w
        hessian = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled rows whose crc32(doc_id) mod 3 is not 1.

    Of each class about `sample` rows, chosen by a hash of doc_id, are sent to the driver. Without
    rows of both classes nothing counts as an insult and every score is one half.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL AND crc32(cast(doc_id AS string)) % 3 <> 1").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stored(known)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return Model({}, {}, np.zeros(len(FEATURES)), 0.0)
    rate = {k: min(1.0, sample / n) for k, n in counts.items()}
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(place < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The different words of each text and their minima; the clauses that learning may need are cut later from the same text."""
        for batch in batches:
            words = [sorted(set(_WORD.findall((t or "").lower()))) for t in batch.column("text").to_pylist()]
            minima = [_minima(w) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array(minima, pa.list_(pa.int64())), batch.column("toxic").cast(pa.int32())], names=["words", "minima", "toxic"])

    seen = stored(rows.select("text", "toxic").mapInArrow(reduce, "words array<string>, minima array<long>, toxic int").withColumn("id", F.monotonically_increasing_id()))
    whole, stems = learn_insults(seen)
    dropped(seen)
    blank = Model(whole, stems, np.zeros(len(FEATURES)), 0.0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [blank.features(t or "").tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic").cast(pa.int32())], names=["x", "toxic"])

    found = rows.select("text", "toxic").mapInArrow(measure, "x array<double>, toxic int").toArrow()
    if not found.num_rows:  # labels, but no documents
        return Model({}, {}, np.zeros(len(FEATURES)), 0.0)
    x, y = np.array(found.column("x").to_pylist()), np.array(found.column("toxic").to_pylist(), dtype=float)
    order = np.lexsort(np.column_stack([x, y]).T)
    weights, bias = fit_weights(x[order], y[order], np.where(y[order] == 1, 1 / rate[1], 1 / rate[0]))
    return Model(whole, stems, weights, bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_clauses, worst) of every row of docs: worst is the clause with most insults and threats.

    Null and empty texts score like texts without a match; repeated rows are scored each; other
    columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, numbers, worst = [], [], []
            for text in batch.column("text").to_pylist():
                hits = [(sum(t in (INSULT, THREAT) for t, _ in marked), clause.strip()) for clause, _, marked in model.clauses(text or "")]
                scores.append(model.score(text) if hits else quiet)
                numbers.append(len(hits))
                worst.append(max(hits, key=lambda h: h[0])[1] if hits else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(numbers, pa.int64()), pa.array(worst, pa.string())], names=["doc_id", "score", "n_clauses", "worst"])

    quiet = model.score("")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, n_clauses long, worst string")


def op4(spark, sf_dir) -> DataFrame:
    """The score of every document."""
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "n_clauses")


def without_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs that score below the cut, told apart by doc_id and text; all columns stay as they are."""
    model = fit(docs.select("doc_id", "text"), labels)
    name = free_name(docs, "_row")
    found = scored(docs.select(row_hash().alias("doc_id"), "text"), model).where(F.col("score") >= cut)
    bad = stored(found.select(F.col("doc_id").alias(name)).distinct())
    return docs.withColumn(name, row_hash()).join(checked_broadcast(bad), name, "left_anti").select(docs.columns)

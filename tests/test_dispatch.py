"""Arm rows against a plain version that walks one document at a time."""

import math
import random
import re

import pytest

from quillsieve.functions.hashing import hash_unit
from quillsieve.operators import dispatch
from quillsieve.operators.text_arms import Compressor

RATIOS = [1.5, 3.0, 8.0]
SPECS = ["full", "lead", "random", "bm25", "oracle_span", "oracle_support", "oracle_beta", "embed", "cover=reranker", "rrf:bm25|embed", "sent+bm25", "sents=sent+rrf:bm25|embed", "fill+bm25", "fill+embed", "recomp", "llmlingua2"]


def tokens(t):
    return len(t.split()) + t.count("\n\n")


def terms(t):
    return re.findall(r"\w+", t.lower())


def bm25(question, chunks):
    docs = [terms(c) for c in chunks]
    mean = max(sum(map(len, docs)) / max(1, len(docs)), 1e-9)
    out = []
    for d in docs:
        s = 0.0
        for t in terms(question):
            df, tf = sum(t in x for x in docs), d.count(t)
            if tf:
                s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / mean))
        out.append(round(s, 9))
    return out


def cosine(question, chunks):
    q = terms(question)
    out = []
    for c in chunks:
        t = terms(c)
        dot = sum(q.count(w) * t.count(w) for w in set(q))
        norm = sum(q.count(w) ** 2 for w in set(q)) * sum(t.count(w) ** 2 for w in set(t))
        out.append(round(dot / math.sqrt(norm), 9) if norm else 0.0)
    return out


def cover(question, chunks):
    q = set(terms(question))
    return [round(sum(w in terms(c) for w in q) / max(1, len(q)), 9) for c in chunks]


def order_of(scores):
    return sorted(range(len(scores)), key=lambda i: (-scores[i], i))


def rrf(*lists):
    out = [0.0] * len(lists[0])
    for scores in lists:
        for r, i in enumerate(order_of(scores), 1):
            out[i] += 1 / (60 + r)
    return out


class Doc:
    def __init__(self, row):
        self.__dict__.update(row)
        self.units = []
        for i, c in enumerate(self.chunks):
            title = c.split("\n", 1)[0].strip() if self.hop == "multi" and "\n" in c else ""
            body = c.split("\n", 1)[1] if title else c
            for line in body.split("\n"):
                for s in re.split(r"(?<=[.!?…])\s+(?=\S)", line):
                    if s.strip():
                        self.units.append((i, s.strip(), title, self.para[i] if self.para else None))
        self.titled = [f"{t}\n{s}" if t else s for _, s, t, _ in self.units]
        self.full = "\n\n".join(self.chunks)


def written(doc, keep, whole=()):
    parts = [((i, -1), None, "", doc.chunks[i]) for i in whole] + [((doc.units[j][0], j), doc.units[j][0] if doc.units[j][3] is None else doc.units[j][3], doc.units[j][2], doc.units[j][1]) for j in set(keep)]
    text, last = None, None
    for _, key, title, body in sorted(parts, key=lambda p: p[0]):
        own = f"{title}\n{body}" if title else body
        text = own if text is None else f"{text} {body}" if key is not None and key == last else f"{text}\n\n{own}"
        last = key
    return text or ""


def cut(text, budget):
    return " ".join(text.split()[:budget])


def choose_chunks(doc, scores, budget):
    kept, used = [], 0
    for i in order_of(scores):
        cost = len(doc.chunks[i].split()) + (1 if kept else 0)
        if used + cost <= budget:
            kept.append(i)
            used += cost
    while kept:
        text = "\n\n".join(doc.chunks[i] for i in sorted(kept))
        if tokens(text) <= budget:
            return sorted(kept), [], text, False
        kept.pop()
    best = order_of(scores)[0]
    return [best], [], cut(doc.chunks[best], budget), True


def choose_sentences(doc, scores, budget):
    keep, opened, used = [], set(), 0
    for j in order_of(scores):
        c, s, title, _ = doc.units[j]
        cost = len(s.split()) + (0 if c in opened else len(title.split()))
        if used + cost <= budget:
            keep.append(j)
            opened.add(c)
            used += cost
    while keep:
        text = written(doc, keep)
        if tokens(text) <= budget:
            return sorted({doc.units[j][0] for j in keep}), [], text, False
        keep.pop()
    if not doc.units:
        return [0], [], cut(doc.chunks[0], budget), True
    best = order_of(scores)[0]
    return [doc.units[best][0]], [], cut(written(doc, [best]), budget), True


def choose_fill(doc, scores, unit_scores, budget):
    whole = choose_chunks(doc, scores, budget)
    if doc.para:
        return whole
    if whole[3]:
        kept, _, text, truncated = choose_sentences(doc, unit_scores, budget)
        return [], [] if truncated else kept, text, truncated
    fill, opened, used = [], set(), tokens(whole[2])
    for j in order_of(unit_scores):
        c, s, title, _ = doc.units[j]
        cost = len(s.split()) + 1 + (0 if c in opened else 1 + len(title.split()))
        if c not in whole[0] and used + cost <= budget:
            fill.append(j)
            opened.add(c)
            used += cost
    while fill:
        text = written(doc, fill, whole[0])
        if tokens(text) <= budget:
            return whole[0], sorted({doc.units[j][0] for j in fill}), text, False
        fill.pop()
    return whole


def compress(doc, ratio, budget):
    rate = ratio
    for _ in range(3):
        text = doc.full[: int(len(doc.full) / rate)]
        n = tokens(text)
        if n <= budget:
            return [], [], text, False
        rate *= 1.02 * n / budget
    return [], [], cut(text, budget), True


def plain(doc, randoms):
    """(arm, ratio) to kept, partial, text, truncated, recall."""
    models = {"bm25": bm25, "embed": cosine, "recomp": cosine, "cover": cover}
    b = bm25(doc.question, doc.chunks)
    top = max(b) + 1
    spans = [any(a.strip().lower() in c.lower() for a in doc.answers) for c in doc.chunks]
    scores = {
        "lead": [-float(i) for i in range(len(b))], "random": randoms, "bm25": b, "embed": cosine(doc.question, doc.chunks), "cover": cover(doc.question, doc.chunks),
        "oracle_span": [top if s else x for s, x in zip(spans, b, strict=True)], "oracle_support": [top if i in doc.gold_chunks else x for i, x in enumerate(b)],
        "oracle_beta": doc.betas if doc.betas and len(doc.betas) == len(b) else None, "rrf:bm25|embed": rrf(b, cosine(doc.question, doc.chunks))}
    out = {("full", None): (list(range(len(b))), [], doc.full, False, 1.0)}
    recall = lambda kept: sum(g in kept for g in doc.gold_chunks) / len(doc.gold_chunks)
    units = {k: models[k](doc.question, doc.titled) for k in ("bm25", "embed", "recomp")}
    for r in RATIOS:
        budget = max(1, math.ceil(tokens(doc.full) / r))
        for arm, s in scores.items():
            if s is not None:
                got = choose_chunks(doc, s, budget)
                out[arm, r] = (*got, 0.0 if got[3] else recall(got[0]))
        for arm, s in (("sent+bm25", units["bm25"]), ("sents", rrf(units["bm25"], units["embed"])), ("recomp", units["recomp"])):
            out[arm, r] = (*choose_sentences(doc, s, budget), None)
        for arm in ("bm25", "embed"):
            got = choose_fill(doc, scores[arm], units[arm], budget)
            out[f"fill+{arm}", r] = (*got, recall(got[0]) if got[0] else 0.0)
        out["llmlingua2", r] = (*compress(doc, r, budget), None)
    return out


def documents():
    rng = random.Random(12)
    vocabulary = ["Paris", "river", "the", "Über", "năm", "of", "a", "stone", "x", "light"] + [f"w{k}" for k in range(40)]
    sentence = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9))) + rng.choice([".", "!", "?", "", "…"])
    rows = []
    for k in range(40):
        hop = "multi" if k % 2 else "single"
        n = rng.randint(1, 9)
        chunks = [(f"Title {i} {rng.choice(vocabulary)}\n" if hop == "multi" and rng.random() < 0.8 else "") + " ".join(sentence() for _ in range(rng.randint(1, 5))) for i in range(n)]
        para = [i // 2 for i in range(n)] if k % 7 == 3 else None
        betas = [rng.random() for _ in range(n + (k % 5 == 0))] if k % 3 else None
        rows.append({"doc_id": k, "source": "s", "language": "vi", "hop": hop, "cluster_id": f"c{k % 4}", "needle_relpos": 0.5, "question": " ".join(rng.choice(vocabulary) for _ in range(4)),
                     "answers": [rng.choice(vocabulary)], "chunks": chunks, "gold_chunks": sorted(rng.sample(range(n), min(n, 2))), "betas": betas, "para": para})
    rows.append({**rows[0], "doc_id": 90, "chunks": ["   "], "gold_chunks": [0], "betas": None, "para": None})
    rows.append({**rows[0], "doc_id": 91, "chunks": [], "gold_chunks": [], "betas": None, "para": None})
    return rows


SCHEMA = "doc_id long, source string, language string, hop string, cluster_id string, needle_relpos double, question string, answers array<string>, chunks array<string>, gold_chunks array<int>, betas array<double>, para array<int>"


def test_all_arms_against_plain_version(spark):
    from pyspark.sql import functions as F

    docs = documents()
    frame = spark.createDataFrame([tuple(d.values()) for d in docs], SCHEMA).repartition(3)
    rows = dispatch.arm_rows(frame, SPECS, RATIOS).collect()
    draws = frame.select("doc_id", F.transform("chunks", lambda c, i: hash_unit(F.concat(F.col("doc_id").cast("string"), F.lit(":"), i.cast("string")), "random")).alias("x")).collect()
    randoms = {r["doc_id"]: r["x"] for r in draws}
    got = {(r["doc_id"], r["arm"], r["ratio"]): (r["kept"], r["partial"], r["text"], r["truncated"], r["gold_recall"]) for r in rows}
    assert len(got) == len(rows)
    want = {}
    for d in docs:
        if d["chunks"]:
            want |= {(d["doc_id"], *k): v for k, v in plain(Doc(d), randoms[d["doc_id"]]).items()}
    wrong = {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)}
    assert not wrong, (len(wrong), list(wrong.items())[:3])
    for r in rows:
        assert r["kept_tokens"] == tokens(r["text"]) <= r["budget"] and r["seconds"] >= 0 and r["error"] is None
    assert any(r["partial"] for r in rows) and any(r["truncated"] for r in rows) and any(len(r["kept"]) > 1 for r in rows)


class Failing(Compressor):
    def compress(self, question, chunks, ratio, target):
        if len(chunks) > 4:
            raise ValueError("too many chunks")
        return " ".join(chunks)


class Wrong(dispatch.BatchScorer):
    def scores(self, batch):
        return [[float("nan")] * len(ts) for ts in batch.texts]


def test_given_models_failures_and_unknown_arms(spark):
    frame = spark.createDataFrame([tuple(d.values()) for d in documents()[:12]], SCHEMA)
    rows = dispatch.arm_rows(frame, ["llmlingua", "pruner:p", "lead"], [2.0], {"pruner:p": Wrong()}, {"llmlingua": Failing()}).collect()
    failed = [r for r in rows if r["arm"] == "llmlingua" and r["num_chunks"] > 4]
    assert failed and all("too many chunks" in r["error"] and r["text"] is None for r in failed)
    by = {(r["doc_id"], r["arm"]): r["kept"] for r in rows}
    assert all(by[d, "pruner:p"] == by[d, "lead"] for d, a in by if a == "lead")  # scores that aren't finite: document order
    with pytest.raises(ValueError, match="no model"):
        dispatch.arm_rows(frame, ["pruner:q"], [2.0])


def test_one_scan(spark):
    frame = spark.createDataFrame([tuple(d.values()) for d in documents()[:3]], SCHEMA)
    plan = dispatch.arm_rows(frame, SPECS, RATIOS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1 and plan.count("Exchange") == 0 and plan.count("ArrowEvalPython") == 1

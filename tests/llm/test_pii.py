import random
import re

from quillsieve.llm import pii

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(30000):
        t = "".join(rng.choice("0123456789019@@..-- +()ab_é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_stay_linear():
    for c in ("1", "a", "@", "1.", "+1", "a@", "-", "1 "):
        pii.base_spans(c * 200_000)


def test_field_on_held_out_spellings():
    field = pii.trained()
    said = [("please call (555) 123-4567 now", "phone:12:26"), ("write to jane at example dot org soon", "email:9:32"), ("ip 10[.]2[.]33[.]4 ok", "ip:3:18")]
    for text, spans in said:
        assert pii.joined(pii.find_all([text], field)[0][1]) == spans
    for text in ("version 2.0 of 2010", "Licensed under CC BY-NC 4.0.", "the 12345 was at 20 dot", "born on 12.03.1999 at 10:20:30", ""):
        assert pii.find_all([text], field)[0] == ([], [])


def test_viterbi_equals_all_paths():
    import itertools

    import numpy as np

    field = pii.trained()
    _, feats = pii._tokens("call 555-1234 x")
    scores, move = field.emit[feats].sum(axis=1)[:4], field.move + pii._allowed()
    first = np.where([t[0] == "I" for t in pii.TAGS], -1e4, 0.0)

    def worth(path):
        return first[path[0]] + sum(scores[i, p] for i, p in enumerate(path)) + sum(move[a, b] for a, b in itertools.pairwise(path))

    best = max(itertools.product(range(len(pii.TAGS)), repeat=4), key=worth)
    assert abs(worth(best) - worth(tuple(field.decode([feats[:4], feats])[0]))) < 1e-9


def test_table(spark):
    rows = [(1, "a.b@c.de and +1 (375) 555-4393", "x"), (2, None, "y"), (3, "", "z"), (1, "a.b@c.de and +1 (375) 555-4393", "x"), (None, "1.2.3.4 é 4111 1111 1111 1111", "w")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["spans"]) for r in pii.personal_data(frame).collect())
    first = ("1", 1, 0, 0, 1, "email:0:8,phone:13:30")
    assert got == [first, first, ("2", 0, 0, 0, 0, ""), ("3", 0, 0, 0, 0, ""), ("None", 0, 1, 1, 0, "ip:0:7,card:10:29")]
    assert pii.personal_data(frame.limit(0)).count() == 0


def test_windows_do_not_depend_on_the_rest_of_a_text():
    assert pii.windows("İ " * 50 + "ana at mail dot\tcom") and pii.windows("ana at mail POINT com") and not pii.windows("a disappointing text")

import re
from pathlib import Path

import duckdb
import pytest

from quillsieve.llm import mixing

SAMPLE = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)


@pytest.mark.skipif(not Path(SAMPLE).exists(), reason="no test data")
def test_against_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SAMPLE}/documents.parquet'")
    want = sorted(c.execute(f"select doc_id, size, source_size, target, taken from ({mixing.SQL})").fetchall(), key=str)
    got = rows_of(mixing.op10(spark, SAMPLE))
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-6 * max(1, b[3]) for a, b in zip(got, want, strict=True))


def water(sizes, weights, share=1.5):
    """Targets by rounds: share by weight, stop at twice the size, share the excess again."""
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), share * sum(sizes.values())
    while open_ and left > 1e-9:
        w = sum(weights[s] for s in open_)
        full = {s for s in open_ if target[s] + left * weights[s] / w >= 2 * sizes[s]}
        if not full:
            for s in open_:
                target[s] += left * weights[s] / w
            break
        for s in full:
            left -= 2 * sizes[s] - target[s]
            target[s] = 2 * sizes[s]
        open_ -= full
    return target


def test_planted_table(spark):
    docs = [(i, " ".join(["w"] * (1 + i % 40)), "hot") for i in range(3000)]
    docs += [(5000 + i, " ".join(["w"] * (i % 9)), f"s{i % 7}") for i in range(300)] + [(6000, None, None), (6001, "a b", None), (6002, "", "none"), (6001, "a b", None), (None, "x y z", "s1")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, taken int")
    got = mixing.mix(frame).collect()
    assert len(got) == len(docs)
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = r["source"]
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"], r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert sizes["hot"] == sum(len(re.findall(r"\S+", t)) for _, t, s in docs if s == "hot")
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water(sizes, {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)})
    for s in sizes:
        assert abs(want[s] - target[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= 45
    assert rows_of(mixing.mix(frame.repartition(7))) == rows_of(mixing.mix(frame))
    assert mixing.mix(frame.limit(0)).count() == 0

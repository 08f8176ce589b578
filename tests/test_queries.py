from pathlib import Path

import duckdb
import pytest

SAMPLE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return None if v is None else round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not Path(SAMPLE).exists(), reason="no test data")
@pytest.mark.parametrize("name", ["bm25_budget_report", "greedy_select", "answer_metrics", "paired_diff", "holm_bh", "loo_labels", "window_packing", "arm_rows", "family_tests", "mask_determinism", "squad_documents", "measure_queue", "measured_answers"])
def test_query_equals_its_sql(spark, name):
    from quillsieve.plans import queries

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SAMPLE}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SAMPLE)
    cols = sorted(found.columns)
    got = sorted((tuple(plain(r[k]) for k in cols) for r in found.collect()), key=repr)
    want = sorted((tuple(plain(v) for v in r) for r in c.execute(f"select {', '.join(cols)} from ({queries.SQL[name]})").fetchall()), key=repr)
    assert got == want


def test_entry_lists_everything():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "bm25_budget_report" in names and len(names) > 40 and set(entry.oracle_sql()) <= set(names)

import itertools
import os

import __spark_entry__ as entry
from quillsieve.operators import statistics
from quillsieve.plans import queries_labels


def test_documents_built_in_waves_are_the_same(spark, monkeypatch, tmp_path):
    """A wave's lines are deleted before the next one's are made."""
    query = entry.queries()["squad_documents"]
    want = sorted(map(tuple, query(spark, entry.SAMPLE).collect()))
    number = itertools.count()
    monkeypatch.setattr(statistics, "scratch_folder", lambda spark, stem: f"{tmp_path}/{stem}-{next(number)}")
    monkeypatch.setattr(queries_labels, "WAVE", len(want) // 3 + 1)
    found = query(spark, entry.SAMPLE)
    assert next(number) > 4 and len(os.listdir(tmp_path)) == 4  # the rows and three waves' digests
    assert sorted(map(tuple, found.collect())) == want

import json

from quillsieve.operators import text_arms
from quillsieve.plans import report


def test_registered_families(spark, tmp_path):
    path = tmp_path / "families.json"
    path.write_text(json.dumps({"name": "x", "families": [{"name": "R1", "claim": "c", "reader": "strong", "ours": "ours", "vs": ["lead", "absent"], "kind": "superiority", "margin": 0.0, "sources": ["s"], "ratios": [4.0]}, {"name": "R2", "claim": "c", "reader": "strong", "ours": "ours", "vs": ["full"], "kind": "noninferiority", "margin": 0.06, "sources": ["s"], "ratios": [4.0]}]}))
    tests = report.read_families(spark, str(path))
    assert tests.count() == 3
    rows = [("strong", "s", r, a, i, i // 2, 0.5 + base + (i % 5) / 1000) for i in range(40) for a, r, base in (("ours", "4.0", 0.1), ("lead", "4.0", 0.0), ("full", "full", 0.15))]
    answers = spark.createDataFrame(rows, "reader string, source string, ratio string, arm string, doc_id int, cluster int, f1 double")
    got = {(r["family"], r["vs"]): r for r in report.family_tests(answers, tests, 100).collect()}
    assert abs(got["R1", "lead"]["diff"] - 0.1) < 1e-9 and got["R1", "lead"]["supported"] and got["R2", "full"]["supported"]
    assert got["R1", "absent"]["p"] is None
    assert {tuple(r) for r in report.roll_up(report.family_tests(answers, tests, 100)).collect()} == {("R1", 2, 1, 1), ("R2", 1, 1, 1)}
    assert report.outside(["ours", "lead", "rest"], tests) == ["rest"]


def test_renderers(spark):
    cells = spark.createDataFrame([("a|b", "x", 0.5), ("a|b", "y", None)], "arm string, source string, f1 double")
    assert "a\\|b | x | 0.500" in report.markdown(cells)
    assert "0.5" in report.latex(report.pivot(cells, "arm", "source", "f1")) and report.tex("50%_") == "50\\%\\_"


def test_text_arms(spark):
    class Stubborn(text_arms.Truncation):
        def compress(self, question, chunks, ratio, target):
            if question == "fail":
                raise RuntimeError("no")
            return "\n\n".join(chunks) if question == "all" else super().compress(question, chunks, ratio, target)

    rows = [("a", "q", ["w " * 40], 4.0, 10), ("b", "all", ["w " * 40], 4.0, 10), ("c", "fail", ["w"], 4.0, 1)]
    docs = spark.createDataFrame(rows, "doc_id string, question string, chunks array<string>, ratio double, budget int")
    got = {r["doc_id"]: r for r in text_arms.compressed(docs, Stubborn()).collect()}
    assert got["a"]["kept_tokens"] == 10 and not got["a"]["truncated"]
    assert got["b"]["kept_tokens"] == 10 and got["b"]["truncated"] and got["c"]["error"].startswith("RuntimeError")

"""One Python worker a task: no stage of the pipeline has two Python steps on end, and none needs a second daemon."""

import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest


def python_within(plan: str) -> bool:
    """A Python step that shares a stage with the plan's top."""
    exchange = None
    for line in plan.splitlines():
        depth = re.match(r"[\s:+-]*", line).end()
        if exchange is not None and depth > exchange:
            continue
        exchange = depth if re.match(r"\w*Exchange", line[depth:]) else None
        if re.match(r"(\*\(\d+\) )?(MapInArrow|MapInPandas|FlatMapGroups|ArrowEval|BatchEval)", line[depth:]):
            return True
    return False


@pytest.fixture
def watched(spark, monkeypatch):
    """The plans that Python steps are put on while a test runs."""
    kind, plans = type(spark.range(0)), []
    before = kind.mapInArrow

    def seen(self, *a, **b):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return before(self, *a, **b)

    monkeypatch.setattr(kind, "mapInArrow", seen)
    return plans


def test_lines_that_are_met_again(spark, tmp_path, watched, monkeypatch):
    """Sketches of lines with 8 common and 2 own words clash, all named candidates fail, and the lines' keys are marked for a second pass."""
    from barflow.llm import linededup

    rare, own = " ".join(f"r{k}" for k in range(8)), [f"own{k}" for k in range(400)]
    texts = [f"{rare} {a} {b}" for a, b in zip(own[::2], own[1::2], strict=True)] + [" ".join([w] * 400) for w in own]
    texts.append(f"{rare} own0 own1 own2")
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), str(tmp_path / "t.parquet"))
    marked, marks_of = [], linededup.marks_of
    monkeypatch.setattr(linededup, "marks_of", lambda *a: marked.append(1) or marks_of(*a))
    out = linededup.line_dedup(spark.read.parquet(str(tmp_path / "t.parquet")))
    gone = {r.doc_id for r in out.filter("size(__gone) > 0").collect()}
    assert gone == {len(texts) - 1}  # 10 of 11 words are an earlier line's, all others share 8 of 12
    assert len(marked) == 6  # two for each verification, two for the second pass
    assert watched and not any(map(python_within, watched))


def test_language_needs_no_python_rows(spark, watched, monkeypatch):
    from corpus_pipeline import identify_language

    def refused(*_, **__):
        raise AssertionError("rows from a list are read by Python workers of a second daemon")

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    assert identify_language(spark, docs, "").count() > 0
    assert watched and not any(map(python_within, watched))

"""The filter audit against a plain count of every order, and its stated cases."""

import collections
import itertools
import re

import pyarrow.parquet as pq
import pytest

from barflow.llm.audit import OUT, filter_audit, outcomes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    """docs: (id, text, part); labels: (id, quality, toxic). Every order is walked document by document."""
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    good, toxic = {x[0] for x in labels if x[1] == 1 and x[0] is not None}, {x[0] for x in labels if x[2] == 1 and x[0] is not None}
    fails = []
    for d, text, part in docs:
        text = text or ""
        w = WORD.findall(text)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text)}
        f["E"] = d is not None and d > first[text]
        fails.append((d, part or "", {k for k, v in f.items() if v}))
    got, value = collections.defaultdict(lambda: [0] * 6), collections.Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for d, part, f in fails:
            gone = False
            for step, x in enumerate(order, 1):
                row = got[part, order, step]
                if x in f and not gone:
                    row[1] += 1
                    row[4] += d in good
                    row[5] += d in toxic
                    value[part, x] += 1
                row[2] += x in f and gone
                row[3] += f == {x}
                gone = gone or x in f
                row[0] += not gone
    return {(*k, *v, value[k[0], k[1][k[2] - 1]]) for k, v in got.items()}


ROWS = [
    (1, "Some Words " * 60, "a"),
    (2, "Some Words " * 60, "b"),
    (2, "Some Words " * 60, "b"),
    (3, None, None),
    (4, "", ""),
    (5, "\x0b \n", "a"),
    (None, "Some Words " * 60, "a"),
    (None, None, "c"),
    (6, " ".join(f"w{k}" for k in range(90)), "c"),
    (7, " ".join(f"w{k}" for k in range(90)) + " 100 %", "c"),
    (8, "ÄÖ日本" * 5000 + " X", "c"),
    (-3, " ".join(f"w{k}" for k in range(90)), "c"),
]
MARKS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (2, None, None), (None, 1, 1), (8, 0, 0), (99, 1, 1), (-3, 1, 1)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    more = docs.select("*", *[F.lit("x").alias(c) for c in ("id", "part", "mask", "n", "digest", "quality", "toxic", "hist")])
    return more, spark.createDataFrame(MARKS, "doc_id long, quality int, toxic int").withColumn("part", F.lit("y"))


def test_cases(tables):
    got = filter_audit(*tables)
    assert got.columns == OUT
    assert {tuple(r) for r in got.collect()} == plain(ROWS, MARKS)


def test_empty(tables):
    docs, labels = tables
    assert filter_audit(docs.limit(0), labels).count() == 0
    without = {tuple(r) for r in filter_audit(docs, labels.limit(0)).collect()}
    assert without == plain(ROWS, [])


def test_query(spark):
    from barflow.llm.queries import QUERIES

    t, m = pq.read_table(f"{SF}/documents.parquet"), pq.read_table(f"{SF}/labels.parquet")
    docs = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), t["source"].to_pylist(), strict=True))
    marks = list(zip(m["doc_id"].to_pylist(), m["quality"].to_pylist(), m["toxic"].to_pylist(), strict=True))
    assert {tuple(r) for r in QUERIES["op13_filter_audit"](spark, SF).collect()} == plain(docs, marks)


def test_outcomes_partition_every_mask():
    _, own, made, by_filter = outcomes(5)
    assert len(own) == 600 and (by_filter.sum(axis=0) == 120).all()
    failing = made["removed"] + made["redundant"]
    assert ((failing == 0) | (failing == 1)).all() and ((made["kept"] + made["removed"]) <= 1).all()
    assert (made["unique_fails"] <= made["removed"]).all()

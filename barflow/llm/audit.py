"""How filters interact: every order of n filters, audited with one matrix product per outcome.

A document's failures are the bits of a mask (filter k: 1 << k).  Which of the 2**n masks
a step of an order keeps, removes, or would have removed does not depend on the corpus, so
these outcomes are fixed 0/1 incidence matrices of 2**n rows (masks) and n! * n columns
(order, step): 32 by 600 for five filters.  A part of the corpus is three histograms over
the masks (documents, good ones, toxic ones); stacked as rows and multiplied by an outcome
matrix, they give all 600 counts of that outcome at once, in whole numbers.

The texts are read once, in one pass that leaves a narrow row a document (id, part, digest,
mask).  Equal rows are counted before they are exchanged, so a text that a third of the
documents share costs a row a part.  Whether a document is the first with its text is asked
by (id, digest), never by the digest alone: the many copies of a text are spread by their ids.

Filters: A: under ``min_words`` words; B: 100 * distinct words < ``distinct`` * words;
C: 100 * capitals (A-Z) > ``capitals`` * code points; D: holds one of ``symbols``; E: the
text is that of a smaller id.  Words are maximal runs of other than ASCII white space.

Defined cases: a null text is an empty one (fails A; it is a copy of other empty texts); a
null part is the empty string; a row without an id is no copy, no original, and has no
labels; rows repeated with the same id and text are not copies of one another; a doc with
several label rows counts as good (toxic) if one of them says so; null labels say nothing;
an empty table gives no rows; extra columns are ignored.  Texts are told apart by SHA-256.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import Scratch, slices, text_buffers

LETTERS = "ABCDE"
COPY = 1 << 4  # the mask's bit of filter E
PARTS_AT_ONCE = 64


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    distinct: int = 65
    capitals: int = 5
    symbols: str = "#$%&*|"


def outcomes(n: int) -> tuple[list[str], np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """(orders, filter of each column, outcome -> 2**n by n! * n of 0/1, columns by filter): what becomes of each mask at each step."""
    orders = list(permutations(range(n)))
    masks = np.arange(1 << n)[:, None]
    own = np.array([f for order in orders for f in order])
    before = np.array([sum(1 << f for f in order[:k]) for order in orders for k in range(n)])
    fails, gone = (masks >> own) & 1 == 1, masks & before != 0
    made = {"kept": ~gone & ~fails, "removed": ~gone & fails, "redundant": gone & fails, "unique_fails": masks == 1 << own}
    names = ["".join(LETTERS[f] for f in order) for order in orders]
    return names, own, {k: v.astype(np.int64) for k, v in made.items()}, (own[:, None] == np.arange(n)).astype(np.int64)


def _judge(limits: Limits):
    """Rows (id, part, digest, mask of A to D) of whole texts."""

    def counts(hit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(hit))[offsets])

    def run(batches):
        symbols = np.isin(np.arange(256), np.frombuffer(limits.symbols.encode(), np.uint8))
        for batch in slices(batches, "text"):
            raw, offsets = text_buffers(batch.column(2))
            points = counts((raw & 0xC0) != 0x80, offsets)
            capitals = counts((raw >= 65) & (raw <= 90), offsets)
            odd = counts(symbols[raw], offsets) > 0
            many, distinct, digests = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64), []
            for k in range(len(points)):
                text = raw[offsets[k] : offsets[k + 1]].tobytes()
                words = text.split()  # of bytes: at ASCII white space
                many[k], distinct[k] = len(words), len(set(words))
                digests.append(hashlib.sha256(text).digest())
            mask = (many < limits.min_words) | (100 * distinct < limits.distinct * many) << 1 | (100 * capitals > limits.capitals * points) << 2 | odd << 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(mask.astype(np.int32))], names=["id", "part", "digest", "mask"])

    return run


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", limits: Limits = Limits()) -> DataFrame:
    """(id, digest, part, mask, n): how many rows of an id, text and part fail which filters, all but the copies' one."""
    own = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text}`").alias("text"))
    judged = own.mapInArrow(_judge(limits), "id long, part string, digest binary, mask int")
    return judged.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))


def histograms(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", limits: Limits = Limits()) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by all their failures."""
    held = Scratch(docs.sparkSession, "audit").keep(failures(docs, key, text, part, limits))
    first = held.groupBy("digest").agg(F.min("id").alias("id")).filter("id IS NOT NULL").withColumn("first", F.lit(True))
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("long").alias(c)
    marks = labels.select(F.col(f"`{key}`").cast("long").alias("id"), "quality", "toxic").filter("id IS NOT NULL").groupBy("id").agg(says("quality"), says("toxic"))
    known = held.filter("id IS NOT NULL").join(first, ["id", "digest"], "left").join(marks, "id", "left")
    nameless = held.filter("id IS NULL").withColumns({"first": F.lit(True), "quality": F.lit(0).cast("long"), "toxic": F.lit(0).cast("long")})
    rows = known.unionByName(nameless).withColumn("mask", F.col("mask").bitwiseOR(F.when(F.col("first").isNull(), F.lit(COPY)).otherwise(F.lit(0))))
    share = lambda c: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias("good" if c == "quality" else c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), share("quality"), share("toxic"))


def _multiply(n: int):
    """Parts with their histograms times the outcome matrices: n! * n rows a part."""

    def run(batches):
        names, own, made, by_filter = outcomes(n)
        size = len(own)
        for whole in batches:
            for at in range(0, whole.num_rows, PARTS_AT_ONCE):
                batch = whole.slice(at, PARTS_AT_ONCE)
                p = batch.num_rows
                stacked = np.zeros((3, p, 1 << n), np.int64)  # documents, good ones, toxic ones
                for k, hist in enumerate(batch.column(1).to_pylist()):
                    for cell in hist:
                        stacked[:, k, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                count = {k: (stacked[0] @ m).ravel() for k, m in made.items()}
                good, toxic = (stacked[1:].reshape(2 * p, -1) @ made["removed"]).reshape(2, -1)
                value = ((count["removed"].reshape(p, size) @ by_filter) @ by_filter.T).ravel()
                part = batch.column(0).take(pa.array(np.repeat(np.arange(p), size)))
                orders = pa.array(np.tile(np.repeat(names, n), p).astype(object), pa.string())
                step = pa.array(np.tile(np.arange(size) % n + 1, p).astype(np.int32))
                numbers = [count["kept"], count["removed"], count["redundant"], count["unique_fails"], good, toxic, value]
                yield pa.RecordBatch.from_arrays([part, orders, step, *[pa.array(x, pa.int64()) for x in numbers]], names=OUT)

    return run


OUT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def interactions(hist: DataFrame, n: int = len(LETTERS)) -> DataFrame:
    """Each part's outcome counts for every order of the n filters and every step: hist (part, mask, n, good, toxic)."""
    # at most 2**n cells a part
    cells = hist.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("hist"))
    return cells.mapInArrow(_multiply(n), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in OUT[3:]))


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", limits: Limits = Limits()) -> DataFrame:
    """The audit of the five filters over whole texts: one row a part, order and step."""
    return interactions(histograms(docs, labels, key, text, part, limits))

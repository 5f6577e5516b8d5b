"""Language identification by sparse multinomial logistic regression.

Features are character 1- to 3-grams of the lower-cased text (everything but letters
and the marks on them counts as a space), hashed to 2**16 columns and weighted by
TF-IDF: the share of the text's n-grams times log((1 + N) / (1 + df)) + 1, with
document frequencies over every training document.  The regression is trained by
follow-the-regularised-leader-proximal with elastic-net penalties on a bounded sample:
about ``per_class`` different texts a language, and with more languages than
``sample`` / ``per_class`` evenly fewer, ``sample`` in all.  The texts with the smallest
hashes are drawn, so the sample does not depend on partitions, and copies count once.
Every language with a training document is learned, however many there are.  A fifth
of the sample is held back to fit the temperature that makes the scores probabilities.
The model is one dense matrix of 2**16 + 1 rows and a column a language, broadcast; the
sample's vectors pass through the driver in parts of at most PART terms.

Defined cases: a null text or one without a letter (Unicode category L) is ``und`` with
score 0; so is every text if there is nothing to learn from; rows without a label are
not learned from; long texts are read whole; equal texts get equal results; ties between
languages go to the first in order; an empty table gives none.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.llm.common import Scratch, give_back, slices, small_batches, text_buffers

BITS = 16
NONE = 1 << BITS  # the column of what is no n-gram
_LETTER: list[np.ndarray] = []
_MULTIPLY = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def kinds() -> np.ndarray:
    """Of each code point: 2 for a letter, 1 for a mark, 0 for all else."""
    if not _LETTER:
        first = np.frombuffer("".join(map(unicodedata.category, map(chr, range(0x110000)))).encode(), np.uint8)[::2]
        _LETTER.append((first == ord("L")) * np.uint8(2) + (first == ord("M")))
    return _LETTER[0]


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points with 32 for all but letters and marks, offsets, letters in each text)."""
    raw, offsets = text_buffers(pc.utf8_lower(column.cast(pa.large_string())))
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
    before = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    offsets = before[offsets]
    kind = kinds()[points]
    points[kind == 0] = 32
    total = np.append(0, np.cumsum(kind == 2))
    return points, offsets, np.diff(total[offsets])


def columns(points: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """The hashed column of the n-gram of ``size`` characters that begins at each place; NONE where there is none."""
    h = np.full(len(points), size, np.uint32)
    blank = points == 32
    none = blank.copy() if size == 1 else np.zeros(len(points), bool)
    for k in range(size):
        if k >= len(points):
            break
        h[: len(points) - k] += points[k:] * _MULTIPLY[k]
        if k:
            h[: len(points) - k] ^= h[: len(points) - k] >> np.uint32(15)
            h[: len(points) - k] *= _MULTIPLY[-k]
            none[: len(points) - k] |= blank[k - 1 : len(points) - 1] & blank[k:]  # runs of spaces say nothing
    out = (h * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)).astype(np.int32)
    ends = offsets[1:][np.diff(offsets) > 0]
    for k in range(1, size):
        last = ends - k
        none[last[last >= 0]] = True
    out[none] = NONE
    return out


SIZES = (1, 2, 3)


def frequencies(text: str):
    """A task's document frequencies: rows (column, df), and the number of texts under column -1."""

    def run(batches):
        df, texts, seen = np.zeros(NONE + 1, np.int64), 0, np.zeros(NONE + 1, bool)
        for batch in slices(batches, text, 1 << 19):
            points, offsets, _ = code_points(batch.column(text))
            grams = [columns(points, offsets, n) for n in SIZES]
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                seen[:] = False
                for g in grams:
                    seen[g[a:b]] = True
                df += seen
            texts += batch.num_rows
        at = np.flatnonzero(df[:NONE])
        if texts:
            yield pa.record_batch([pa.array(np.append(-1, at).astype(np.int32)), pa.array(np.append(texts, df[at]))], names=["column", "df"])

    return run


def vectors(text: str):
    """Sparse term frequencies of labelled texts (label, h, text), each (label, h) once a task."""

    def run(batches):
        told: set[tuple[str, int]] = set()
        for batch in slices(batches, text, 1 << 19):
            new = [k for k, x in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)) if not (x in told or told.add(x))]
            batch = batch.take(pa.array(new, pa.int64()))
            if not batch.num_rows:
                continue
            points, offsets, _ = code_points(batch.column(text))
            grams = np.concatenate([columns(points, offsets, n) for n in SIZES])
            of = np.tile(np.repeat(np.arange(batch.num_rows), np.diff(offsets)), len(SIZES))
            key, n = np.unique(of[grams != NONE].astype(np.int64) << 17 | grams[grams != NONE], return_counts=True)
            ends = pa.array(np.searchsorted(key >> 17, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key & ((1 << 17) - 1), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["label", "h", "at", "n"])

    return run


Sample = tuple[np.ndarray, np.ndarray, int]  # columns, values, class


class Ftrl:
    """Follow the regularised leader, proximal: per-coordinate rates, elastic net."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> None:
        self.z, self.n = np.zeros((NONE + 1, classes)), np.zeros((NONE + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def matrix(self) -> np.ndarray:
        """All weights, made in stretches so that no second table of this size is needed."""
        out = np.empty(self.z.shape, np.float32)
        for k in range(0, len(out), 4096):
            out[k : k + 4096] = self.weights(slice(k, k + 4096))
        return out

    def learn(self, sample: Sample) -> None:
        at, x, y = sample
        w = self.weights(at)
        p = _softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores that makes held-back labels most likely."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    grid = np.exp(np.linspace(np.log(0.5), np.log(50), 121))
    return float(grid[int(np.argmin([loss(t) for t in grid]))])


class Model:
    """classes in order, weights with idf folded in (float32, last row the intercept), temperature."""

    def __init__(self, classes: list[str], weights: np.ndarray, heat: float) -> None:
        self.classes, self.weights, self.heat = classes, weights, heat

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(calibrated probabilities, texts with letters)."""
        points, offsets, n_letters = code_points(column)
        total, n = np.zeros((len(column), len(self.classes))), np.zeros(len(column))
        full = np.flatnonzero(np.diff(offsets))
        starts = offsets[:-1][full]
        w = self.weights.copy()
        w[NONE] = 0
        for size in SIZES if len(full) else ():
            at = columns(points, offsets, size)
            total[full] += np.add.reduceat(w[at], starts, axis=0, dtype=np.float64)
            n[full] += np.add.reduceat((at != NONE).astype(np.int64), starts)
        return _softmax((total / np.maximum(n, 1)[:, None] * SCALE + self.weights[NONE]) / self.heat), n_letters > 0


SCALE = 30.0  # TF-IDF values are small shares; this brings them near one


def to_samples(rows: pa.Table, idf: np.ndarray, classes: list[str]) -> list[tuple[int, Sample]]:
    """(hash, sample) of each vector with a term, in the order of hash and label."""
    at_, n_ = (rows[c].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32())) for c in ("at", "n"))
    ends = np.append(0, np.cumsum(at_.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    cols, counts = at_.flatten().to_numpy(), n_.flatten().to_numpy()
    number = {c: k for k, c in enumerate(classes)}
    order = sorted(zip(rows["h"].to_pylist(), rows["label"].to_pylist(), range(rows.num_rows), strict=True))
    out = []
    for h, label, k in order:
        a, c = cols[ends[k] : ends[k + 1]], counts[ends[k] : ends[k + 1]]
        if len(a):
            out.append((h, (np.append(a, NONE), np.append(c / c.sum() * idf[a] * SCALE, 1.0).astype(np.float32), number[label])))
    return out


PART = 4_000_000  # terms of sampled texts that the driver holds at once
EPOCHS = 4


def train(docs: DataFrame, text: str = "text", label: str = "lang", per_class: int = 1500, sample: int = 24_000, seed: int = 7) -> Model | None:
    """Fit on rows with a label; statistics over all of them, weights on the bounded sample. None: there is none."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "langid")
    own = docs.select(F.col(f"`{label}`").cast("string").alias("__label"), F.xxhash64(F.col(f"`{text}`")).alias("__h"), F.col(f"`{text}`").alias("__text")).filter(F.col("__label").isNotNull() & F.col("__text").isNotNull())
    sizes = {r[0]: (r[1], r[2]) for r in own.groupBy("__label").agg(F.approx_count_distinct("__h", 0.02), F.min("__h")).collect()}  # a row a language
    if not sizes:
        return None
    classes = sorted(sizes)
    df = own.select("__text").mapInArrow(frequencies("__text"), "column int, df long").groupBy("column").agg(F.sum("df").alias("df")).toArrow()
    at, n = df["column"].to_numpy(), df["df"].to_numpy()
    texts = int(n[at == -1].sum())
    idf = np.full(NONE + 1, np.log(1 + texts) + 1)
    idf[at[at >= 0]] = np.log((1 + texts) / (1 + n[at >= 0])) + 1
    each = max(1, min(per_class, sample // len(classes)))
    # hashes are spread evenly over the longs, so about ``each`` of v lie below this; the smallest one always does
    below = lambda v, least: (1 << 63) - 1 if v <= each else max(least, int(-(1 << 63) + each / v * ((1 << 64) - 1024)))
    # an Arrow table stays in the JVM; from a list it would take Python workers of another environment, with a daemon of their own
    upto = spark.createDataFrame(pa.table({"__label": pa.array(list(sizes), pa.string()), "__upto": pa.array([below(*v) for v in sizes.values()], pa.int64())}))
    drawn = own.join(F.broadcast(upto), "__label").filter("__h <= __upto").select("__label", "__h", "__text")
    made = drawn.mapInArrow(vectors("__text"), "label string, h long, at array<int>, n array<int>")
    rows = scratch.keep(made.groupBy("label", "h").agg(F.first("at").alias("at"), F.first("n").alias("n")))
    count, terms = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("at").cast("long")), F.lit(0))).first()
    if not terms:
        return None
    parts = max(1, -(-terms // PART))
    read = lambda k: to_samples(rows.filter(F.pmod("h", F.lit(parts)) == k).toArrow(), idf, classes)
    least = [sizes[c][1] for c in classes]
    held_back = lambda h, y: h // parts % 5 == 0 and count >= 50 and h != least[y]  # noqa: E731 (a language's first text is always learned from)
    model, rng, only = Ftrl(len(classes)), np.random.default_rng(seed), read(0) if parts == 1 else None
    for _ in range(EPOCHS):
        for k in rng.permutation(parts).tolist():
            fit = [x for h, x in (only or read(k)) if not held_back(h, x[2])]
            for j in rng.permutation(len(fit)):
                model.learn(fit[j])
    w = model.matrix()
    held = [(x @ w[a], y) for k in range(parts) for h, (a, x, y) in (only or read(k)) if held_back(h, y)]
    heat = temperature(np.array([x for x, _ in held]), np.array([y for _, y in held])) if held else 1.0
    w[:NONE] *= idf[:NONE, None].astype(np.float32)
    del model, only, held
    give_back()
    return Model(classes, w, heat)


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with lang_pred and score; input columns of these names are replaced."""
    small_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    own = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in slices(batches, "__text", 1 << 19):
            column = batch.column(batch.num_columns - 1)
            names, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if m is not None:
                p, known = m.scores(column)
                best = p.argmax(axis=1)
                names[known] = np.array(m.classes, object)[best[known]]
                score[known] = p[np.arange(len(p)), best][known]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    return own.mapInArrow(run, T.StructType(own.schema.fields[:-1] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def language_id(docs: DataFrame, learn: Column, text: str = "text", label: str = "lang", keep: list[str] | None = None, per_class: int = 1500) -> DataFrame:
    """Train on the rows for which ``learn`` holds and identify every row."""
    return identify(docs, train(docs.filter(learn), text, label, per_class), text, keep)

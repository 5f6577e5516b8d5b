"""Best-fit packing by exact complements.

Only the histogram of piece lengths (at most ``cap`` numbers, whatever the corpus)
decides the packing, so the plan is made once on the driver: from the longest
length down, combinations of one, two or three available lengths that fill the
gap exactly are consumed under their counts; what has no exact complement is
packed best-fit-decreasing.  The plan is a short list of runs "this pattern of
lengths, so many times"; every piece then finds its sequence from its rank
among pieces of its length, which is numbered in salted groups so that one hot
length never lands in one task.

Defined cases: a null or empty text is the single id 0; equal documents are
packed one by one; an empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.llm.bpe import encoder
from barflow.llm.common import Scratch, slices

Run = tuple[tuple[int, ...], int]


def _exact(free: np.ndarray, gap: int, sums: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three available lengths (the longest first) that add up to gap; sums: which sums two present lengths have."""
    if free[gap]:
        return (gap,)
    a = np.arange((gap + 1) // 2, gap)
    ok = a[(free[a] > 0) & (free[gap - a] > (a * 2 == gap))]
    if len(ok):
        return int(ok[-1]), gap - int(ok[-1])
    a = np.arange(gap - 2, 0, -1)
    for x in a[(free[a] > 0) & sums[gap - a]].tolist():
        rest = gap - x
        b = np.arange((rest + 1) // 2, rest)
        need = 1 + (b * 2 == rest)
        c = rest - b
        ok = b[(free[b] >= 1 + (b == x)) & (free[c] >= need + (c == x))]
        if len(ok):
            return x, int(ok[-1]), rest - int(ok[-1])
    return None


def plan(counts: np.ndarray, cap: int) -> list[Run]:
    """Runs (pattern, times) that place counts[n] pieces of each length n in 1..cap."""
    left, runs, rest = counts.astype(np.int64).copy(), [], defaultdict(int)
    left[0] = 0
    sums, shown = None, None
    for n in range(cap, 0, -1):
        while left[n]:
            if n == cap:
                runs.append(((n,), int(left[n])))
                left[n] = 0
                break
            free = left.copy()
            free[n] -= 1
            present = free > 0
            if shown is None or not np.array_equal(present, shown):
                wave = np.fft.rfft(present.astype(float), 4 * (cap + 1))
                sums, shown = np.fft.irfft(wave * wave, 4 * (cap + 1))[: cap + 1] > 0.5, present
            more = _exact(free, cap - n, sums)
            if more is None:
                rest[n] += int(left[n])
                left[n] = 0
                break
            pattern = (n, *more)
            times = min(int(left[x]) // pattern.count(x) for x in pattern)
            runs.append((pattern, times))
            for x in pattern:
                left[x] -= times
    return runs + _best_fit(rest, cap)


def _best_fit(counts: dict[int, int], cap: int) -> list[Run]:
    bins: dict[int, list[Run]] = defaultdict(list)
    for n in sorted(counts, reverse=True):
        c = counts[n]
        while c:
            gap = min((g for g, b in bins.items() if g >= n and b), default=None)
            if gap is None:
                each = cap // n
                if c >= each:
                    bins[cap - each * n].append(((n,) * each, c // each))
                if c % each:
                    bins[cap - c % each * n].append(((n,) * (c % each), 1))
                c = 0
            else:
                pattern, times = bins[gap].pop()
                used = min(c, times)
                if times > used:
                    bins[gap].append((pattern, times - used))
                bins[gap - n].append(((*pattern, n), used))
                c -= used
    return [run for b in bins.values() for run in b]


def places(runs: list[Run]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks (sorted), the sequence of that rank, the offset in it."""
    found, rank, sequence = defaultdict(list), defaultdict(int), 0
    for pattern, times in runs:
        offset = 0
        for n in pattern:
            found[n].append((rank[n], sequence, offset))
            rank[n] += times
            offset += n
        sequence += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in found.items()}


def token_pieces(docs: DataFrame, tokenizer: str, cap: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",), end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids and one end id: longer ones are cut so that only the first piece is short."""
    own = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    made = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    made += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def cut(batches):
        e = encoder(tokenizer)
        for batch in slices(batches, "__text"):
            n, ids = e.encode(batch.column(batch.num_columns - 1))
            ends = np.cumsum(n)
            of, rows, flat = [], [], []
            for k, end in enumerate(ends.tolist()):
                own_ids = np.append(ids[end - n[k] : end], end_id).astype("<u4")
                start, size = 0, len(own_ids) % cap or cap
                piece = 0
                while start < len(own_ids):
                    part = own_ids[start : start + size]
                    of.append(k)
                    rows.append((piece, start, size, zlib.crc32(part)))
                    flat.append(part)
                    start, size, piece = start + size, cap, piece + 1
            a = [pa.array(np.array(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            if with_ids:
                a.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, flat)]), pa.int32()), pa.array(np.concatenate(flat).astype(np.int32))))
            yield pa.RecordBatch.from_arrays([c.take(pa.array(of)) for c in batch.columns[:-1]] + a, names=[*batch.schema.names[:-1], *[f.name for f in made]])

    return own.mapInArrow(cut, T.StructType(own.schema.fields[:-1] + made))


def place(pieces: DataFrame, cap: int, key: tuple[str, ...] = ("doc_id", "piece"), group_rows: int = 50_000) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of 1..cap. ``pieces`` is read twice: give a written table."""
    by_length = pieces.groupBy("length").count().toArrow()
    counts = np.zeros(cap + 1, np.int64)
    counts[by_length["length"].to_numpy()] = by_length["count"].to_numpy()
    at = pieces.sparkSession.sparkContext.broadcast(places(plan(counts, cap)))
    salts = max(8, int(counts.max()) // group_rows)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*key), F.lit(salts)))
    order = [F.col(c) for c in (*key, "ids_crc32") if c in pieces.columns]
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)) - 1)
    before = salted.groupBy("length", "__salt").count().select("length", "__salt", (F.sum("count").over(Window.partitionBy("length").orderBy("__salt")) - F.col("count")).alias("__before"))
    numbered = ranked.join(before, ["length", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__before")).select(*pieces.columns, "__rank")

    def put(batches):
        where = at.value
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(n) else []:
                first, start, own = where[int(n[part[0]])]
                k = np.searchsorted(first, rank[part], "right") - 1
                sequence[part], offset[part] = start[k] + rank[part] - first[k], own[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return numbered.mapInArrow(put, T.StructType(pieces.schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def best_fit_packing(docs: DataFrame, tokenizer: str, cap: int = 2048, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """One row a piece: ``keep``, piece, start, length, ids_crc32 (and ids), sequence_id, offset. The ids are encoded once and written."""
    pieces = Scratch(docs.sparkSession, "pack").keep(token_pieces(docs, tokenizer, cap, text, keep, with_ids=with_ids))
    return place(pieces, cap, (keep[0], "piece"))

"""Exact top-k inner products in three phases with a uniform threshold.

The nodes of the method are slices of the dimensions: each has a score list (the
partial inner products), and a total is their sum.  Queries and candidates are
dealt by hash into blocks; a tile is one query block against one candidate block.

1. In every tile each node gathers its k best partial scores a query; the exact
   totals of these candidates are merged into the k-th best so far: a total that
   the k-th result reaches for certain.
2. This safe cutoff goes back to the tiles with its query.  A candidate whose
   partial scores all lie below cutoff / nodes cannot reach it; the others are
   collected.  (With negative parts this holds as well: the parts' sum is the
   total.)
3. The totals of the collected are resolved exactly; what reaches the cutoff is
   ranked, ties to the smaller id.

Every query meets every candidate, in blocks, as numbers only: nothing is emitted
for a pair that cannot be in the result.

Defined cases: vectors that are null, hold null or non-finite components or have
no id take no part; every row is a candidate, and a query if its id is asked for,
so of repeated ids each row answers for itself and meets the others; vectors of
different lengths do not meet; fewer than k candidates give them all;
a total beyond 64 bits is held at the largest or smallest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import Scratch

BLOCK_CANDIDATES, BLOCK_QUERIES = 4096, 2048


def quantized(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id long, v array<double>): floor(scale * x) of every component."""
    x = F.transform(F.col(f"`{vector}`"), lambda e: e.cast("double"))
    sound = F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    # F.floor would go through a long; a double holds every floor(scale * x) as it is
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), x.alias("v")).filter(sound)
    return rows.mapInArrow(_floor(scale), "id long, v array<double>")


def _floor(scale: int):
    def run(batches):
        for batch in batches:
            v = batch.column(1).combine_chunks() if isinstance(batch.column(1), pa.ChunkedArray) else batch.column(1)
            flat = np.floor(v.flatten().to_numpy(zero_copy_only=False) * scale)
            ends = np.append(0, np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], names=["id", "v"])

    return run


def _matrix(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: (row numbers, matrix)."""
    column = table["v"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(sizes) - sizes
    out = {}
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        out[n] = rows, flat[begin[rows][:, None] + np.arange(n)]
    return out


def _kind(q: np.ndarray, c: np.ndarray):
    """The fastest number type in which every inner product is exact."""
    most = (np.abs(q).max(initial=0) * np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if most < 1 << 24:
        return np.float32
    if most < 1 << 53:
        return np.float64
    return np.int64 if most < 1 << 62 else object


def _as(a: np.ndarray, kind) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) if kind is object else a.astype(kind)


def _long(x: np.ndarray) -> np.ndarray:
    if x.dtype == object:
        return np.array([max(min(int(v), (1 << 63) - 1), -(1 << 63)) for v in x.ravel()], np.int64).reshape(x.shape)
    return x.astype(np.int64)


def _blocks(table: pa.Table, nodes: int):
    """For each dimension of a tile: (queries' (row, id), candidates' (row, id), each node's partial scores, the queries' cutoffs)."""
    asked = table["asked"].to_numpy(zero_copy_only=False)
    queries, others = table.filter(pa.array(asked)), table.filter(pa.array(~asked))
    if not queries.num_rows or not others.num_rows:
        return
    by_q, by_c = _matrix(queries), _matrix(others)
    ids_q, ids_c, rows_q, rows_c = queries["id"].to_numpy(), others["id"].to_numpy(), queries["u"].to_numpy(), others["u"].to_numpy()
    cuts = queries["cutoff"].to_numpy(zero_copy_only=False) if "cutoff" in table.column_names else None
    for n, (rows, q) in by_q.items():
        if n not in by_c:
            continue
        at, c = by_c[n]
        order = np.argsort(ids_c[at], kind="stable")
        at, c = at[order], c[order]
        kind = _kind(q, c)
        q, c = _as(q, kind), _as(c, kind)
        edges = np.linspace(0, n, min(nodes, max(n, 1)) + 1).astype(int)
        parts = [q[:, a:b] @ c[:, a:b].T for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield (rows_q[rows], ids_q[rows]), (rows_c[at], ids_c[at]), parts, None if cuts is None else cuts[rows]


def _gather(k: int, nodes: int):
    """Phase 1: a query's k best exact totals among each node's k best partial scores."""

    def run(table: pa.Table) -> pa.Table:
        asked, lists = [], []
        for (own, _), (others, _), parts, _ in _blocks(table, nodes):
            total = sum(parts)
            near = [np.argpartition(-p.astype(float), min(k, p.shape[1] - 1), axis=1)[:, : k + 1] for p in parts]
            for i, row in enumerate(np.concatenate(near, axis=1)):
                row = np.unique(row)
                row = row[others[row] != own[i]]
                best = np.sort(_long(total[i, row]))[::-1][:k]
                asked.append(own[i])
                lists.append(best)
        return pa.table({"u": pa.array(asked, pa.int64()), "best": pa.array(lists, pa.list_(pa.int64()))})

    return run


def _resolve(k: int, nodes: int):
    """Phases 2 and 3: what may reach the cutoff, with its exact total; at most the k best of a tile."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        for (own, asked), (others, ids), parts, cuts in _blocks(table, nodes):
            m = len(parts)
            for i in range(len(own)):
                if cuts[i] is None or np.isnan(cuts[i]):
                    row = np.arange(len(others))
                else:
                    cut = int(cuts[i])
                    may = parts[0][i] * m >= cut
                    for p in parts[1:]:
                        may |= p[i] * m >= cut
                    row = np.flatnonzero(may)
                score = _long(sum(p[i, row] for p in parts))
                keep = others[row] != own[i]
                if not (cuts[i] is None or np.isnan(cuts[i])):
                    keep &= score >= int(cuts[i])
                row, score = row[keep], score[keep]
                if len(row) > k:
                    best = np.lexsort((ids[row], -score.astype(float) if np.abs(score).max() < 1 << 53 else [-int(s) for s in score]))[:k]
                    row, score = row[best], score[best]
                out.append((np.full(len(row), own[i]), np.full(len(row), asked[i]), ids[row], score))
        a = [np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), (), ()))]
        return pa.table(dict(zip(("u", "query_id", "vec_id", "score"), (pa.array(x, pa.int64()) for x in a), strict=True)))

    return run


def exact_top_k(vectors: DataFrame, asked: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64, nodes: int = 2) -> DataFrame:
    """The k best candidates of each row for which ``asked`` (on the id, named ``id``) holds: query_id, rank, vec_id, score."""
    # rows are numbered as they are written: of repeated ids each row is one of its own
    rows = Scratch(vectors.sparkSession, "topk").keep(quantized(vectors, key, vector, scale).withColumn("u", F.monotonically_increasing_id()))
    n, n_asked = rows.agg(F.count("*"), F.coalesce(F.sum(asked.cast("long")), F.lit(0))).first()
    blocks, deals = max(1, -(-n // BLOCK_CANDIDATES)), max(1, -(-n_asked // BLOCK_QUERIES))
    of = lambda count: F.pmod(F.xxhash64("u"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    others = rows.select(of(blocks).alias("block"), every(deals).alias("deal"), F.lit(False).alias("asked"), "u", "id", "v")
    queries = rows.filter(asked).select("u", "id", "v")
    spread = lambda q: q.select(every(blocks).alias("block"), of(deals).alias("deal"), F.lit(True).alias("asked"), "u", "id", "v", *[c for c in q.columns if c == "cutoff"])
    lists = others.unionByName(spread(queries)).groupBy("block", "deal").applyInArrow(_gather(k, nodes), "u long, best array<long>")
    best = lambda c: F.slice(F.sort_array(F.flatten(F.collect_list(c)), False), 1, k)
    merged = lists.groupBy("u", F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("part")).agg(best("best").alias("best")).groupBy("u").agg(best("best").alias("best"))
    cut = merged.select("u", F.get("best", F.lit(k - 1)).cast("double").alias("cutoff"))
    # a cutoff beyond 2**53 is rounded as a double: lower it so that it stays safe
    cut = cut.withColumn("cutoff", F.when(F.abs("cutoff") < float(1 << 53), F.col("cutoff")).otherwise(F.floor(F.col("cutoff") - F.abs("cutoff") * 1e-15).cast("double")))
    second = others.withColumn("cutoff", F.lit(None).cast("double")).unionByName(spread(queries.join(cut, "u", "left")))
    found = second.groupBy("block", "deal").applyInArrow(_resolve(k, nodes), "u long, query_id long, vec_id long, score long")
    order = Window.partitionBy("u").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

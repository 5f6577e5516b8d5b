"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table (sorted 64-bit chunk hashes and their lengths) of the
most frequent pre-token chunks, broadcast to every worker; its size is fixed by
``hot_size``.  Tier two is each worker's own bounded cache of what it had to
encode.  No pre-token is ever shuffled: the only exchange is the small frequency
table of a sample, which decides what is fast and never what is counted.

Defined cases: a null or empty text has 0 bytes and 0 tokens; long texts are
counted whole; repeated rows give repeated rows; an empty table gives none; an
input column called like an output column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.llm.bpe import LONGEST_CACHED, encoder
from barflow.llm.common import slices, small_batches, spans_hash, text_buffers


def hot_table(docs: DataFrame, tokenizer: str, text: str = "text", hot_rows: int = 4000, hot_size: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and token lengths of the ``hot_size`` most frequent chunks of about ``hot_rows`` sampled texts."""
    small_batches(docs.sparkSession)
    rows = docs.count()
    none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    if not rows:
        return none

    def tally(batches):
        e = encoder(tokenizer)
        for batch in slices(batches, text):
            raw, offsets = text_buffers(batch.column(0))
            starts = e.cuts(raw, offsets)
            if not e.byte_level or not len(starts):
                continue
            ends = np.append(starts[1:], len(raw))
            short = ends - starts <= LONGEST_CACHED
            starts, ends = starts[short], ends[short]
            keys, first, n = np.unique(spans_hash(raw, starts, ends), return_index=True, return_counts=True)
            best = np.argsort(-n, kind="stable")[:hot_size]
            lens, _ = e.encode_chunks(raw, starts[first[best]], ends[first[best]])
            yield pa.record_batch([pa.array(keys[best].view(np.int64)), pa.array(lens), pa.array(n[best])], names=["key", "len", "n"])

    sample = docs.select(text).sample(False, min(1.0, hot_rows / rows), 7)
    best = sample.mapInArrow(tally, "key long, len int, n long").groupBy("key").agg(F.first("len").alias("len"), F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(hot_size).toArrow()
    if not best.num_rows:
        return none
    keys = best["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], best["len"].to_numpy()[order]


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, limit: int = 1024, hot_rows: int = 4000, hot_size: int = 1 << 16) -> DataFrame:
    """``keep`` columns (all but ``text`` by default) with n_bytes, n_tokens and over_limit (n_tokens > limit) of each whole text."""
    made = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made.names and (c != text or keep)]
    first = hot_table(docs, tokenizer, text, hot_rows, hot_size)
    hot = docs.sparkSession.sparkContext.broadcast(first)
    own = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))

    def count(batches):
        e = encoder(tokenizer)
        for batch in slices(batches, "__text"):
            column = batch.column(batch.num_columns - 1)
            n = e.count(column, hot.value)
            sizes = np.diff(text_buffers(column)[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes), pa.array(n), pa.array(n > limit)], names=[*batch.schema.names[:-1], *made.names])

    return own.mapInArrow(count, T.StructType(own.schema.fields[:-1] + made.fields))

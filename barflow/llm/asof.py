"""A tolerant as-of join of events to the latest order at or before them, per client.

Both sides become records of bytes whose order is that of a composite key: client, time,
side (orders before events of that time), then the rank within a tie (smaller priority,
then larger id, nulls last) or the event's id.  ``repartitionAndSortWithinPartitions``
deals the records by ranges of (client, time) and sorts them; equal (client, time) never
part, but a client may be cut at any time, so one client with a third of all rows is
spread over as many tasks as anyone's third.  The ranges come from a sample of a fixed
number of keys a range.

In a partition one generator streams over the sorted records and holds only the current
tie group of the current client: its winner (the group's first record) and its size so
far.  An event takes what is held.  Events at a partition's beginning may belong to an
order group before it: each partition also says which group it ended with, one record a
partition, and what a range begins with is the last group of the nearest range before it
that has orders.  Nothing else crosses partitions, and nothing that grows with the rows
goes to the driver: one record a partition, 60 sampled keys a partition.

Records travel in blocks, so rows are handled one at a time only inside the generator.

Defined cases: an event without a client or a time, or whose latest order is older than
the tolerance, is unmatched; orders without a client or a time take no part; equal orders
all count in ``n_tied``; events are matched as often as they are given; either side may
be empty; only the named columns are read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from barflow.llm.common import Scratch, batches_of

KEY = [("client", ">u8"), ("t", ">u8"), ("side", "u1")]
ORDER = np.dtype([*KEY, ("no_priority", "u1"), ("priority", ">u8"), ("no_id", "u1"), ("id", ">u8"), ("no_value", "u1"), ("value", ">u8")])
EVENT = np.dtype([*KEY, ("no_id", "u1"), ("id", ">u8")])
MATCH = np.dtype([("event", EVENT), ("order", ORDER), ("n_tied", ">u8")])
GROUP = np.dtype([("order", ORDER), ("n_tied", ">u8")])
NO_ORDER = bytes(ORDER.itemsize + 8)
SAMPLED, ROWS_A_RANGE, RECORDS_A_BLOCK = 60, 500_000, 4096
_SIGN = np.uint64(1 << 63)


def _raise(x: np.ndarray) -> np.ndarray:
    """Longs as unsigned numbers of the same order."""
    return x.view(np.uint64) ^ _SIGN


def _lower(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint64) ^ _SIGN).view(np.int64)


def _longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values with 0 for null, which are null)."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)


def _records(batch: pa.RecordBatch, kind: np.dtype) -> np.ndarray:
    """A batch (client, t, id[, priority, value]) as packed records; their bytes sort as they should."""
    out = np.zeros(batch.num_rows, kind)
    client, t, (own, no_id) = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _longs(batch.column(2))
    out["client"], out["t"], out["no_id"] = _raise(client), _raise(t), no_id
    if "priority" not in kind.names:
        out["side"], out["id"] = 1, _raise(own)
    else:
        (priority, no_priority), (value, no_value) = _longs(batch.column(3)), _longs(batch.column(4))
        out["priority"], out["no_priority"], out["value"], out["no_value"] = _raise(priority), no_priority, _raise(value), no_value
        out["id"] = np.where(no_id, 0, ~_raise(own))  # the larger comes first
    return out


def _pack(kind: np.dtype):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, RECORDS_A_BLOCK):
                batch = whole.slice(at, RECORDS_A_BLOCK)
                yield pa.record_batch([pa.array([kind.itemsize], pa.int32()), pa.array([batch.num_rows], pa.int32()), pa.array([_records(batch, kind).tobytes()], pa.binary())], names=["width", "n", "data"])

    return run


def split(data: bytes, width: int) -> list[tuple[bytes, None]]:
    return [(data[k : k + width], None) for k in range(0, len(data), width)]


def bounds_of(blocks: DataFrame, ranges: int, rows: int) -> list[bytes]:
    """The lower ends of all ranges but the first: (client, t) quantiles of about SAMPLED records a range, drawn by a hash of their bytes."""
    part = min(1.0, SAMPLED * ranges / max(rows, 1))

    def draw(batches):
        for batch in batches:
            for width, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at = np.frombuffer(data.as_buffer(), EVENT if width == EVENT.itemsize else ORDER)
                seed = np.arange(len(at), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ at["t"].astype(np.uint64) ^ at["id"].astype(np.uint64)
                drawn = at[(seed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(11) < np.uint64(int(part * (1 << 53)))]
                yield pa.record_batch([pa.array([x.tobytes()[:16] for x in drawn], pa.binary())], names=["key"])

    keys = sorted(bytes(r.key) for r in blocks.select("width", "data").mapInArrow(draw, "key binary").collect())
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []


def merge(records: Iterator[tuple[bytes, None]]) -> Iterator[bytes]:
    """For every event of the sorted records: its bytes, the winner's and the size of the tie group it meets; at the end, apart, the last group."""
    group, winner, n, held = b"", b"", 0, NO_ORDER
    order_side = EVENT.itemsize
    for record, _ in records:
        if len(record) != order_side:
            if record[:16] != group:
                group, winner, n = record[:16], record, 0
            n += 1
            held = b""
        else:
            if group[:8] != record[:8]:
                yield record + NO_ORDER
                continue
            held = held or winner + n.to_bytes(8, "big")
            yield record + held
    yield winner + n.to_bytes(8, "big") if group else b""


def _merged(part: int, records: Iterator[tuple[bytes, None]]) -> Iterator[tuple[int, bool, bytes]]:
    """(range, False, block of matches) and, once, (range, True, last order group)."""
    out: list[bytes] = []
    for x in merge(records):
        if len(x) != MATCH.itemsize:
            yield part, True, x
        else:
            out.append(x)
            if len(out) == RECORDS_A_BLOCK:
                yield part, False, b"".join(out)
                out = []
    if out:
        yield part, False, b"".join(out)


def _finish(carried: dict[int, bytes], tolerance: int):
    """Blocks as rows: what a range has not seen comes from the group it begins with; too old is unmatched."""

    def run(batches):
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(data.as_buffer(), MATCH).copy()
                if before := carried.get(part):
                    group = np.frombuffer(before, GROUP)[0]
                    open_ = (got["n_tied"] == 0) & (got["event"]["client"] == group["order"]["client"])
                    got["order"][open_], got["n_tied"][open_] = group["order"], group["n_tied"]
                event, order = got["event"], got["order"]
                t, then = _lower(event["t"]), _lower(order["t"])
                n = got["n_tied"].astype(np.int64)
                # apart by more than 63 bits hold is apart by more than any tolerance
                far = (event["t"].astype(np.uint64) - order["t"].astype(np.uint64)) > np.uint64(tolerance)
                none = (n == 0) | far
                column = lambda x, null: pa.array(x, pa.int64(), mask=null)
                own = column(_lower(event["id"]), event["no_id"] == 1)
                order_id = column(_lower(~order["id"].astype(np.uint64)), none | (order["no_id"] == 1))
                value = column(_lower(order["value"]), none | (order["no_value"] == 1))
                yield pa.RecordBatch.from_arrays([own, pa.array(_lower(event["client"])), pa.array(t), order_id, column(t - then, none), value, pa.array(np.where(none, 0, n))], names=OUT)

    return run


OUT = ["event_id", "client", "t", "order_id", "lag", "value", "n_tied"]


def tolerant_asof(events: DataFrame, orders: DataFrame, tolerance: int) -> DataFrame:
    """(event_id, client, t, order_id, lag, value, n_tied), all long, of every event.

    events: client, t, event_id; orders: client, t, order_id, priority, value; all longs.  The match is the client's latest order
    with t at or before the event's and at most ``tolerance`` earlier; of equal times the smaller priority, then the larger id.
    """
    spark = events.sparkSession
    scratch = Scratch(spark, "asof")
    spark_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = F.col("client").isNotNull() & F.col("t").isNotNull()
    sides = [(events.select(*[F.col(c).cast("long") for c in ("client", "t", "event_id")]), EVENT), (orders.select(*[F.col(c).cast("long") for c in ("client", "t", "order_id", "priority", "value")]), ORDER)]
    with batches_of(spark, 10_000):
        packed = [rows.filter(whole).mapInArrow(_pack(kind), "width int, n int, data binary") for rows, kind in sides]
        blocks = scratch.keep(packed[0].unionByName(packed[1]))
    rows = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(spark_ranges, -(-rows // ROWS_A_RANGE))
    bounds = bounds_of(blocks, ranges, rows)
    records = blocks.select("width", "data").rdd.flatMap(lambda r: split(bytes(r[1]), r[0]))
    dealt = records.repartitionAndSortWithinPartitions(ranges, lambda record: bisect_right(bounds, record[:16]))
    met = scratch.keep(spark.createDataFrame(dealt.mapPartitionsWithIndex(_merged), "part int, is_last boolean, data binary", verifySchema=False))
    scratch.drop(blocks)
    carried, latest = {}, b""
    for part, data in sorted((r.part, bytes(r.data)) for r in met.filter("is_last").collect()):  # one record a range
        carried[part] = latest
        latest = data or latest
    found = met.filter("NOT is_last").select("part", "data").mapInArrow(_finish(carried, tolerance), ", ".join(f"{c} long" for c in OUT))
    none = F.lit(None).cast("long")
    alone = sides[0][0].filter(~whole).select("event_id", "client", "t", none.alias("order_id"), none.alias("lag"), none.alias("value"), F.lit(0).cast("long").alias("n_tied"))
    return found.unionByName(alone)


def micros(rows: DataFrame, c: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is read as UTC, whatever the session's zone."""
    if isinstance(rows.schema[c].dataType, TimestampType):
        return F.unix_micros(c)
    return F.expr(f"datediff({c}, date'1970-01-01') * 86400000000L + (hour({c}) * 3600 + minute({c}) * 60) * 1000000L + cast(extract(SECOND FROM {c}) * 1000000 AS bigint)")


def once(rows: DataFrame, key: str, t: str, client: str) -> DataFrame:
    """One row a key; of copies that differ, the earliest time, then the smallest client (nulls last)."""
    late = F.lit((1 << 63) - 1)
    by_key = rows.repartition(F.col(key)).groupBy(key, t).agg(F.min(client).alias(client))
    return by_key.groupBy(key).agg(F.min(t).alias(t), F.min_by(client, F.coalesce(F.col(t), late)).alias(client))

"""Paged candle sources as a Spark data source: every symbol and stretch of time is a partition that pages by itself.

A client is a plain function ``module:function`` (or ``module:function?place``, with the place
as its first argument) that is called with (symbol, interval, start, end, limit), times in epoch milliseconds, and returns at most ``limit`` rows of
the exchange's landing columns from ``start`` on.  No exchange is contacted here: the
client brings the connection, so the paging is the same for a service and for a test.
"""

from __future__ import annotations

import datetime as dt
import importlib
import time
from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from barflow.operators.bars import minutes_of
from barflow.sources.tables import LANDING, SECONDS, landing, landing_rows

# The most candles a request gives.
LIMITS = {"binance": 1500, "bybit": 1000, "kraken": 2000, "mt5": 50_000}


def to_millis(text: str, now: dt.datetime | None = None) -> int:
    """yyyy-MM-dd HH:mm:ss or yyyy-MM-dd in UTC, or now."""
    if text.strip().lower() == "now":
        return int((now or dt.datetime.now(dt.timezone.utc)).timestamp() * 1000)
    for shape in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
        try:
            return int(dt.datetime.strptime(text.strip(), shape).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        except ValueError:
            continue
    raise ValueError(f"date {text!r} is neither yyyy-MM-dd nor yyyy-MM-dd HH:mm:ss nor now")


def client_of(path: str) -> Callable:
    """The function of ``module:function``; of ``module:function?place``, the function with that place."""
    name, _, place = path.partition("?")
    module, _, name = name.partition(":")
    found = getattr(importlib.import_module(module), name)
    return partial(found, place) if place else found


def pages(fetch: Callable, exchange: str, symbol: str, interval: str, start: int, end: int, limit: int, pause: float = 0.0) -> Iterator[tuple]:
    """All candles that open in [start, end], in order and once each, in as many requests as it takes.

    The next request starts after the last candle of a page.  An empty page, or one that brings nothing later, is the end.
    """
    unit = 1000 if exchange in SECONDS else 1
    at = start
    while at <= end:
        page = sorted(r for r in fetch(symbol, interval, at, end, limit) if at <= r[0] * unit <= end)
        if not page:
            return
        last = None
        for row in page:
            if row[0] != last:
                yield row
            last = row[0]
        at = last * unit + (1 if unit == 1 else minutes_of(interval) * 60_000)
        if pause:
            time.sleep(pause)


class Stretch(InputPartition):
    def __init__(self, symbol: str, start: int, end: int) -> None:
        self.symbol, self.start, self.end = symbol, start, end


class CandleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.exchange, self.client = options["exchange"].lower(), options["client"]
        self.symbols = [s.strip().upper() for s in options["symbols"].split(",") if s.strip()]
        self.interval = options.get("interval", "1m")
        self.start, self.end = to_millis(options["start"]), to_millis(options.get("end", "now"))
        if self.start >= self.end:
            raise ValueError("start must be earlier than end")
        self.limit = int(options.get("limit", LIMITS[self.exchange]))
        self.pause = float(options.get("pause", 0))
        self.hours = int(options.get("hours", 24 * 30))  # the stretch of one partition

    def partitions(self) -> list[InputPartition]:
        return self.stretches(self.start, self.end)

    def stretches(self, start: int, end: int) -> list[InputPartition]:
        step = self.hours * 3_600_000
        return [Stretch(s, at, min(at + step - 1, end)) for s in self.symbols for at in range(start, end + 1, step)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        for row in pages(client_of(self.client), self.exchange, partition.symbol, self.interval, partition.start, partition.end, self.limit, self.pause):
            yield (*row, partition.symbol)


class CandleStream(DataSourceStreamReader):
    """Candles as they come: the offset is the last millisecond that the batches have taken in, for every symbol alike.

    A batch reaches from the offset to the newest candle that is closed and has had ``settle`` seconds to show (default: an interval),
    a task for every symbol and ``hours``; whether a symbol has candles there does not hold up the others. Offsets are in the
    query's checkpoint, so a restart goes on after the last batch: no candle is lost or told twice, and a batch that was
    under way is read again with the same ends.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.settings = CandleReader(options)
        self.step = minutes_of(self.settings.interval) * 60_000
        self.settle = int(float(options["settle"]) * 1000) if "settle" in options else self.step
        self.fixed = options.get("end", "now").strip().lower() != "now"

    def initialOffset(self) -> dict:
        return {"at": self.settings.start - 1}

    def latestOffset(self) -> dict:
        newest = self.settings.end if self.fixed else to_millis("now") - self.step - self.settle
        return {"at": max(newest, self.settings.start - 1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.settings.stretches(start["at"] + 1, end["at"])

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return self.settings.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class Candles(DataSource):
    """spark.read.format("candles") or spark.readStream.format("candles") with exchange, client, symbols (comma-separated), start, end, interval, limit, hours, pause."""

    @classmethod
    def name(cls) -> str:
        return "candles"

    def schema(self) -> str:
        return f"{LANDING[self.options['exchange'].lower()]}, symbol string"

    def reader(self, schema) -> DataSourceReader:
        return CandleReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CandleStream(dict(self.options))


def read_candles(spark: SparkSession, exchange: str, client: str, symbols: list[str], start: str, end: str = "now", interval: str = "1m", **options) -> DataFrame:
    """(exchange, symbol, datetime, OHLCV) of many symbols; partitions page in parallel."""
    spark.dataSource.register(Candles)
    given = {"exchange": exchange, "client": client, "symbols": ",".join(symbols), "start": start, "end": end, "interval": interval} | {k: str(v) for k, v in options.items()}
    return landing(spark.read.format("candles").options(**given).load(), exchange.lower(), F.col("symbol"))


def stream_candles(spark: SparkSession, exchange: str, client: str, symbols: list[str], start: str, end: str = "now", interval: str = "1m", **options) -> DataFrame:
    """The same as a stream; with a trigger of its own (``trigger(processingTime=...)``, ``trigger(availableNow=True)``)."""
    spark.dataSource.register(Candles)
    given = {"exchange": exchange, "client": client, "symbols": ",".join(symbols), "start": start, "end": end, "interval": interval} | {k: str(v) for k, v in options.items()}
    return landing_rows(spark.readStream.format("candles").options(**given).load(), exchange.lower(), F.col("symbol"))


def table_client(place: str, symbol: str, interval: str, start: int, end: int, limit: int) -> list[tuple]:
    """A service over a stored table of ``binance`` landing candles, a folder ``symbol=<name>`` each in ``place``: only the rows of [start, end] are read."""
    import pyarrow.compute as pc
    import pyarrow.dataset as ds
    from pyarrow.fs import FileSelector, FileSystem

    files, root = FileSystem.from_uri(place)
    if f"{root}/symbol={symbol}" not in {x.path for x in files.get_file_info(FileSelector(root))}:
        return []
    at = pc.field("timestamp")
    found = ds.dataset(f"{root}/symbol={symbol}", format="parquet", filesystem=files).to_table(filter=(at >= start) & (at <= end)).sort_by("timestamp").slice(0, limit)
    return list(zip(*[c.to_pylist() for c in found.columns], strict=True)) if found.num_rows else []


def store_candles(bars: DataFrame, place: str, interval: str) -> None:
    """Bars as the table that ``table_client`` answers from."""
    step = minutes_of(interval) * 60_000
    at = F.unix_millis(F.col("datetime").cast("timestamp"))
    text = [F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")]
    zero = F.lit("0")
    rest = [zero.alias("quote_asset_volume"), F.lit(1).cast("long").alias("number_of_trades"), zero.alias("taker_buy_base_volume"), zero.alias("taker_buy_quote_volume"), zero.alias("ignore")]
    bars.select(F.upper("symbol").alias("symbol"), at.alias("timestamp"), *text, (at + step - 1).alias("close_time"), *rest).repartition("symbol").write.partitionBy("symbol").parquet(place)


def rule_client(symbol: str, interval: str, start: int, end: int, limit: int) -> list[tuple]:
    """Candles made by a rule, in the landing shape of ``binance``: what a service would answer, for tests and demos."""
    step = minutes_of(interval) * 60_000
    first = -(-start // step) * step
    out = []
    for at in range(first, min(end, first + (limit - 1) * step) + 1, step):
        n = at // 60_000 % 997 + len(symbol)
        out.append((at, f"{n / 10}", f"{n / 10 + 1}", f"{n / 10 - 1}", f"{n / 10 + 0.5}", str(n), at + step - 1, "0", 1, "0", "0", "0"))
    return out

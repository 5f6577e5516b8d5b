"""Window specifications and guarded aggregates over ordered series."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


class Series:
    """One ordered series a key: windows are always partitioned, warm-up rows are null."""

    def __init__(self, keys: tuple[str, ...] = ("symbol",), time: str = "datetime") -> None:
        self.keys, self.time = keys, time
        self.order: WindowSpec = Window.partitionBy(*keys).orderBy(time)
        self.whole: WindowSpec = Window.partitionBy(*keys)

    def last(self, n: int) -> WindowSpec:
        return self.order.rowsBetween(-(n - 1), 0)

    @property
    def running(self) -> WindowSpec:
        return self.order.rowsBetween(Window.unboundedPreceding, 0)

    def full(self, x: Column, value: Column, n: int) -> Column:
        """value where the frame holds n non-null x."""
        return F.when(F.count(x).over(self.last(n)) == n, value)

    def mean(self, x: Column, n: int) -> Column:
        return self.full(x, F.avg(x).over(self.last(n)), n)

    def sum(self, x: Column, n: int) -> Column:
        return self.full(x, F.sum(x).over(self.last(n)), n)

    def max(self, x: Column, n: int) -> Column:
        return self.full(x, F.max(x).over(self.last(n)), n)

    def min(self, x: Column, n: int) -> Column:
        return self.full(x, F.min(x).over(self.last(n)), n)

    def stddev(self, x: Column, n: int) -> Column:
        return self.full(x, F.stddev_pop(x).over(self.last(n)), n)

    def variance(self, x: Column, n: int) -> Column:
        return self.full(x, F.var_pop(x).over(self.last(n)), n)

    def values(self, x: Column, n: int) -> Column:
        """The last n values, oldest first."""
        return self.full(x, F.collect_list(x).over(self.last(n)), n)

    def lag(self, x: Column, n: int = 1) -> Column:
        return F.lag(x, n).over(self.order)

    def lead(self, x: Column, n: int = 1) -> Column:
        return F.lead(x, n).over(self.order)

    def dot(self, x: Column, weights: list[float]) -> Column:
        """Weighted sum of the last values, the last weight for the newest."""
        w = F.array(*[F.lit(float(v)) for v in weights])
        return F.aggregate(F.zip_with(self.values(x, len(weights)), w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def correlation(a: Column, b: Column, over: WindowSpec | None = None) -> Column:
    """Pearson's r, null where a side does not vary."""
    parts = [F.covar_pop(a, b), F.stddev_pop(F.when(b.isNotNull(), a)), F.stddev_pop(F.when(a.isNotNull(), b))]
    both, x, y = (p.over(over) for p in parts) if over is not None else parts
    return F.try_divide(both, x * y)

"""Registered queries: a callable, and the SQL of an independent engine where one can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources.views import view, with_views

DIGITS = 6


def rounded_to(value: Column, digits: int) -> Column:
    """Rounded as the independent engine does: the scaled double to a whole number, halves away from zero.

    Spark's own round to some digits decides by the shortest decimal text of the double instead,
    which may read as a half where the double is just below one.
    """
    value, scale = value.cast("double"), F.lit(10.0**digits)
    held = F.round(value * scale) / scale
    return F.when(F.isnan(held) | (F.abs(held) == float("inf")), value).otherwise(held) + F.lit(0.0)


class Registry:
    def __init__(self) -> None:
        self.calls: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, call: Callable, sql: str | None = None, views: tuple[str, ...] = (), doubles: str = "", digits: int = DIGITS) -> None:
        """doubles: names of double columns, which are rounded on both sides as sums depend on order.

        call(spark, sf_dir, *views) returns the result.
        """
        rounded = doubles.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = call(spark, sf_dir, *[view(spark, sf_dir, v) for v in views])
            return df.withColumns({c: rounded_to(F.col(c), digits) for c in rounded}) if rounded else df

        run.__name__ = name
        self.calls[name] = run
        if sql is not None:
            inner = with_views(sql, *views) if views else sql.strip()
            replaced = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in rounded)
            self.sql[name] = f"SELECT * REPLACE ({replaced}) FROM ({inner})" if rounded else inner

"""Query catalogue: each entry is a Spark query over the given tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


# values that end exactly on a rounding boundary are moved off it the same way in both engines
_NUDGE = 1.00000000001


def _steps(x: str) -> str:
    x = f"({x} * {_NUDGE}::DOUBLE)"
    return (f"CASE WHEN ABS({x}) >= 1000000.0::DOUBLE THEN ROUND({x}, 1) "
            f"WHEN ABS({x}) >= 1000.0::DOUBLE THEN ROUND({x}, 3) ELSE ROUND({x}, 6) END + 0.0::DOUBLE")


def tidy(df: DataFrame) -> DataFrame:
    """Round floats (fewer decimals for large values) so that summation order does not show."""
    def rounded(c):
        c = c * F.lit(_NUDGE)
        size = F.abs(c)
        return F.when(size >= 1e6, F.round(c, 1)).when(size >= 1e3, F.round(c, 3)).otherwise(F.round(c, 6)) + F.lit(0.0)
    return df.select(*[
        rounded(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f"`{f.name}`") for f in df.schema])


def query(name: str, sql: str | None = None, floats: str = ""):
    """Register a query; `floats` names the float columns of the SQL result, rounded like `tidy` does."""
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return tidy(f(spark, sf))
        run.__name__ = f.__name__
        QUERIES[name] = run
        if sql is not None:
            cols = [c.strip() for c in floats.split(",") if c.strip()]
            if cols:
                swaps = ", ".join(f'{_steps(chr(34) + c + chr(34))} AS "{c}"' for c in cols)
                ORACLES[name] = f"SELECT * REPLACE ({swaps}) FROM ({sql}) AS result"
            else:
                ORACLES[name] = sql
        return f
    return add

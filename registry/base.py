"""Registration of queries with their SQL oracles."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registry.context import Context
from registry.sqlbase import with_blocks

QUERIES: dict[str, Callable[[Context], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *needs: str):
    def register(fn: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_blocks(sql, *needs)
        return fn
    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round doubles (no negative zero), counts as long.

    A nudge far below the last digit moves values off exact ties (x.xxxx5), which engines round
    to different sides.
    """
    nudge = 3.0 / 10 ** (digits + 3)
    def shape(f: T.StructField):
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return (F.round(F.col(f"`{f.name}`").cast("double") + F.lit(nudge), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.DecimalType)):
            return F.col(f"`{f.name}`").cast("long").alias(f.name)
        return F.col(f"`{f.name}`")
    return df.select(*[shape(f) for f in df.schema])


def r(*columns: str, digits: int = 4) -> str:
    """SQL counterpart of ``rounded`` for double columns: 'expr AS name' or a plain column name."""
    out, nudge = [], f"{3.0 / 10 ** (digits + 3)}::DOUBLE"
    for c in columns:
        expr, _, name = c.rpartition(" AS ")
        out.append(f"round(({expr or name})::DOUBLE + {nudge}, {digits}) + 0.0::DOUBLE AS {name}")
    return ", ".join(out)


def n(*columns: str) -> str:
    """SQL: whole numbers as bigint."""
    out = []
    for c in columns:
        expr, _, name = c.rpartition(" AS ")
        out.append(f"({expr or name})::BIGINT AS {name}")
    return ", ".join(out)

"""Queries by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..ship import shipped
from .fixtures import FIXTURES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The input tables and the relations derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        shipped(spark)

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def fixture(self, name: str) -> DataFrame:
        text, tables = FIXTURES[name]
        return self.spark.sql(text, **{t: self(t) if t not in FIXTURES else self.fixture(t) for t in tables})


def duck(name: str) -> str:
    """A derived relation as DuckDB SQL."""
    text, tables = FIXTURES[name]
    return text.format(**{t: t if t not in FIXTURES else f"({duck(t)})" for t in tables})


def query(sql: str | None = None, fixtures: tuple[str, ...] = ()) -> Callable:
    """Register a function of Tables under its own name; fixtures are CTEs in front of its SQL."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ctes = ", ".join(f"{n} AS ({duck(n)})" for n in fixtures)
            ORACLES[f.__name__] = (f"WITH RECURSIVE {ctes} {', ' + sql.strip()[5:] if sql.strip().upper().startswith('WITH ') else sql}" if ctes else sql)
        return f

    return add

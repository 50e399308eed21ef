"""Named checks: a Spark query and, where SQL can say it, the DuckDB oracle."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .fixtures import Fixtures

from .extra_views import VIEWS
from .fixture_sql import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@lru_cache(maxsize=8)
def _fixtures(spark: SparkSession, app: str, folder: str) -> Fixtures:
    return Fixtures(spark, folder)


def fixtures(spark: SparkSession, folder: str) -> Fixtures:
    return _fixtures(spark, spark.sparkContext.applicationId, folder)


def query(name: str, oracle: str | None = None):
    """Register ``fn(fx) -> DataFrame`` under ``name``."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(fixtures(spark, folder))
        if oracle:
            ORACLES[name] = with_views(oracle)
        return fn
    return wrap


def extra(fx: Fixtures, name: str) -> DataFrame:
    """One of the further derived inputs, built by Spark from the fixture tables."""
    def build() -> DataFrame:
        text = VIEWS[name]
        bound = {}
        for used in set(re.findall(r"\b(?:fx_\w+|lineitem|part)\b(?= (?:[a-z]\b|ON|JOIN|GROUP|WHERE|$))|(?<=FROM )(?:fx_\w+|lineitem|part)\b", text)):
            bound[used] = extra(fx, used) if used in VIEWS else (
                getattr(fx, _NAMES.get(used, used[3:])) if used.startswith("fx_") else fx.raw(used))
        for used in bound:
            text = re.sub(rf"(FROM|JOIN) {used}\b", rf"\1 {{{used}}}", text)
        return fx.spark.sql(text, **bound)
    return shared(fx, name, build)


def shared(fx: Fixtures, name: str, build: Callable[[], object]):
    """A result that several queries read, computed by the first of them."""
    done = fx.__dict__.setdefault("_shared", {})
    if name not in done:
        done[name] = build()
    return done[name]


_NAMES = {"fx_occurrence": "edges_by_revision"}


def grid(col, scale: int = 1_000_000) -> Column:
    """A double as a whole number of 1/scale units, so that engines which add in
    another order still agree."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c * scale + 0.5).cast("bigint")


def grid_sql(expr: str, scale: int = 1_000_000) -> str:
    return f"CAST(FLOOR(({expr}) * {scale} + 0.5) AS BIGINT)"

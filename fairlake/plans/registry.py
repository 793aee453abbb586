"""Registers each query together with the SQL that must give the same rows.

SQL text is written once for two engines: ``@table`` stands for a given table
and ``$view`` for one of the derived views in :mod:`fairlake.plans.views`.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fairlake.plans.views import VIEWS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_TABLE = re.compile(r"@(" + "|".join(TABLES) + r")\b")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _inline_views(sql: str) -> str:
    while re.search(r"\$[a-z_]+", sql):
        sql = re.sub(r"\$([a-z_]+)", lambda m: f"({VIEWS[m[1]]})", sql)
    return sql


def spark_text(sql: str, sf_dir: str) -> str:
    sql = _TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", _inline_views(sql))
    return sql.replace("OCTETS(", "octet_length(")


def oracle_text(sql: str) -> str:
    return _TABLE.sub(r"\1", _inline_views(sql)).replace("OCTETS(", "strlen(")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(spark_text(VIEWS[name], sf_dir))


def query(name: str, sql: str | None = None):
    """Decorator: register a query, and its SQL when one exists."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle_text(sql)
        return fn

    return register

"""Query registry and input views shared by Spark and the SQL check.

Input views are written once, in SQL both engines read. ``@name`` stands for a table,
``$name`` for a view.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_TABLE = re.compile(r"@([a-z]+)\b")
_VIEW = re.compile(r"\$([a-z_]+)\b")


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


REGISTRY: dict[str, Query] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def _needed(text: str) -> list[str]:
    """Views a text names, those they build on first."""
    out: list[str] = []
    for name in _VIEW.findall(text):
        out += [n for n in [*_needed(VIEWS[name]), name] if n not in out]
    return out


def _with_views(text: str) -> str:
    parts = [f"{n} AS (\n{VIEWS[n]}\n)" for n in _needed(text)]
    if parts and text.lstrip().upper().startswith("WITH "):
        text = "WITH " + ",\n".join(parts) + ",\n" + text.lstrip()[5:]
    elif parts:
        text = "WITH " + ",\n".join(parts) + "\n" + text
    return _VIEW.sub(lambda m: m.group(1), text)


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a text over the parquet tables of ``sf_dir``."""
    full = _with_views(text)
    return spark.sql(_TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`", full))


def from_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark_sql(spark, sf_dir, f"SELECT * FROM ${name}")


def check_sql(text: str) -> str:
    return _TABLE.sub(lambda m: m.group(1), _with_views(text.strip()))


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` with the SQL that must give the same rows."""

    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(fn, None if sql is None else check_sql(sql), covers)
        return fn

    return add


MODULES = [
    "views", "text", "order", "runs", "enrich", "cells", "geometry", "calls", "refs", "errors", "metrics",
    "files", "scoring",
]


def load_all() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(f"scoreframe.catalog.{m}")
    return REGISTRY

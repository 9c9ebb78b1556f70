"""How a query and its oracle are declared once and shaped alike.

The column list drives both sides: ``name`` as is, ``name~`` a double rounded to
6 places, ``name~2`` to 2 places, ``name[]`` an array of doubles as text in
millionths, ``name[s]`` an array of plain values as text.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.sources.sample_tables import SampleTables, with_tables

_MODULES = (
    "sources", "rows", "joins", "aggregates", "series", "ranks", "features", "samples",
    "text", "splits", "decisions", "evaluation", "streams",
)
_ENTRIES: dict[str, "Entry"] = {}
_SPEC = re.compile(r"^(\w+)(~(\d*)|\[(s?)\])?$")


@dataclass(frozen=True)
class Entry:
    build: Callable[[SampleTables], DataFrame]
    columns: tuple[str, ...]
    sql: str | None

    def run(self, spark: SparkSession, path: str) -> DataFrame:
        df = self.build(SampleTables(spark, path))
        return df.select(*[_spark_column(c) for c in self.columns])


def query(columns: str, sql: str | None = None, uses: str = "", name: str | None = None):
    """Register a builder under its own name."""
    specs = tuple(columns.split())

    def wrap(build: Callable[[SampleTables], DataFrame]):
        key = name or build.__name__
        text = None
        if sql is not None:
            outer = ", ".join(_sql_column(c) for c in specs)
            text = f"SELECT {outer} FROM ({with_tables(sql, tuple(uses.split()))}) AS result"
        if key in _ENTRIES:
            raise ValueError(f"query {key} is registered twice")
        _ENTRIES[key] = Entry(build, specs, text)
        return build

    return wrap


def load() -> dict[str, Entry]:
    for module in _MODULES:
        importlib.import_module(f"barline.catalog.{module}")
    return dict(_ENTRIES)


def _parts(spec: str) -> tuple[str, str | None, int]:
    match = _SPEC.match(spec)
    if not match:
        raise ValueError(f"bad column spec {spec!r}")
    name, kind, places, plain = match.groups()
    if kind is None:
        return name, None, 0
    if kind.startswith("~"):
        return name, "double", int(places) if places else 6
    return name, "plain" if plain else "array", 0


def _spark_column(spec: str) -> Column:
    name, kind, places = _parts(spec)
    c = F.col(name)
    if kind == "double":
        # adding 0.0 turns a negative zero into zero
        c = F.round(c.cast("double"), places) + F.lit(0.0)
    elif kind == "array":
        c = F.array_join(F.transform(c, lambda x: F.round(x * 1e6).cast("long").cast("string")), ",", "-")
    elif kind == "plain":
        c = F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "-")
    return c.alias(name)


def _sql_column(spec: str) -> str:
    name, kind, places = _parts(spec)
    if kind == "double":
        return f'round(CAST("{name}" AS DOUBLE), {places}) + 0.0 AS "{name}"'
    if kind == "array":
        item = f"coalesce(CAST(CAST(round(x * 1e6) AS BIGINT) AS VARCHAR), '-')"
        return f"array_to_string(list_transform(\"{name}\", lambda x: {item}), ',') AS \"{name}\""
    if kind == "plain":
        return f"array_to_string(list_transform(\"{name}\", lambda x: coalesce(CAST(x AS VARCHAR), '-')), ',') AS \"{name}\""
    return f'"{name}"'

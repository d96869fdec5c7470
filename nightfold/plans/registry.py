"""The query catalogue: each entry names its plan, the survey rows it covers and, where SQL can say the
same thing, the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    plan: Plan
    covers: str
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(fn: Plan) -> Plan:
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Entry(name, fn, covers, sql)
        return fn

    return add

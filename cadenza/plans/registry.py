"""Named queries: a Spark builder and, where SQL can say it, an oracle text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cadenza.plans.views import Views, duckdb_views
from cadenza.session import ship_package

Build = Callable[[Views], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        # time axes are UTC, whatever the zone of the session's machine
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return self.build(Views(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register `build` under `name`; `sql` may use the fixture views."""

    def add(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return add


def oracle_text(sql: str) -> str:
    """The oracle statement with the views it uses in front."""
    text = sql.strip()
    views = duckdb_views(text)
    head = re.match(r"WITH(\s+RECURSIVE)?\s+", text)
    recursive = " RECURSIVE" if head and head.group(1) else ""
    if not views:
        return text
    body = ", " + text[head.end():] if head else " " + text
    return f"WITH{recursive} {', '.join(views)}{body}"

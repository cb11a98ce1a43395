"""The registered queries and, for each that SQL can express, the same rows in DuckDB's SQL.

In the SQL, <name> stands for a derived input of plans.inputs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import inputs

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(make: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(lambda name: inputs.frame(spark, sf_dir, name))

        run.__name__, run.__doc__ = make.__name__, make.__doc__
        _QUERIES[make.__name__] = run
        if sql:
            _SQL[make.__name__] = re.sub(r"<(\w+)>", lambda m: inputs.duck(m[1]), sql)
        return make

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import checks_graph, checks_product, checks_rollup, checks_text  # noqa: F401  (they register)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)

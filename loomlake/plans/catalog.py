"""The registered queries over the reference's operators, with their DuckDB SQL.

library and have SQL written apart from it (``log_rows``, ``fact_rows``); plain selections of one
statement are one text for both engines (``texts``). No query sorts or gathers a whole table in one task:
windows are keyed by session, user, order or type, and limits are top-k.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fact_rows, log_rows
from .dialect import render
from .texts import TEXTS

Query = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(text: str) -> Query:
    used = [t for t in TABLES if re.search(rf"@{t}\b", text)]
    spark_sql = render(re.sub(r"@(\w+)", r"{\1}", text.replace("{", "{{").replace("}", "}}")), duckdb=False)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(spark_sql, **{t: table(spark, sf_dir, t) for t in used})

    return run


_ROWS = log_rows.ROWS | fact_rows.ROWS
_numbers = {name.split("_")[0] for name in _ROWS}
#: A row that calls an operator stands in place of a statement for the same row.
_TEXTS = {name: text for name, text in TEXTS.items() if name.split("_")[0] not in _numbers}

QUERIES: dict[str, Query] = {name: _query(text) for name, text in _TEXTS.items()} | {name: row[0] for name, row in _ROWS.items()}
SQL: dict[str, str] = {name: render(text.replace("@", ""), duckdb=True) for name, text in _TEXTS.items()} | {name: row[1] for name, row in _ROWS.items() if row[1]}

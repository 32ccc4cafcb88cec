"""What __spark_entry__ registers: the ten operators' queries, the pipeline, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import oracles, queries as _queries


def queries() -> dict:
    return _queries.queries() | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    found = dict(oracles.SQL)
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found

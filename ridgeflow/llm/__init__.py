"""Operators of a training-data pipeline.

Every module holds one operator with its own general interface, the thin
query ``opN_<name>`` that reports its contract columns, and, where DuckDB can
say the same, the SQL of that query.  Nothing outside this package imports it.
"""

from __future__ import annotations


def queries() -> dict:
    """All queries of the subpackage by name, the pipeline included."""
    import corpus_pipeline

    from . import registry

    return registry.queries() | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    """DuckDB SQL of the queries that SQL can express."""
    import corpus_pipeline

    from . import registry

    found = registry.oracle_sql()
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found

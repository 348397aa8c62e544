"""All queries of the library by name, with their DuckDB SQL."""

from __future__ import annotations

from callweft.plans import code_queries, graph_queries, table_queries

FLAGSHIP = "trace_reach_depth"


def queries():
    return {**table_queries.QUERIES, **graph_queries.QUERIES, **code_queries.QUERIES}


def oracle_sql():
    return {**table_queries.SQL, **graph_queries.SQL, **code_queries.SQL}

"""Registered queries and the SQL that says what they must return."""

from . import lake_queries, sql_queries


def queries():
    return {**sql_queries.queries(), **lake_queries.queries()}


def oracle_sql():
    return {**sql_queries.oracle_sql(), **lake_queries.oracle_sql()}

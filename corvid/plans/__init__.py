"""Registered queries and the SQL that checks them."""

from . import evaluation, exports, indexes, retrieval, streams, systems, tables, text  # noqa: F401  they register
from .common import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)

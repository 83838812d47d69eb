"""Every query of the library, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sextant.plans import changes, composites, corpus, doc_tools, graphs, looked_up, parsed, ranked, symbols, traces

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
for _part in (symbols, corpus, graphs, changes, traces, composites, parsed, ranked, doc_tools, looked_up):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE

"""All registered queries of the library proper: name -> function(spark, sf_dir), and name -> DuckDB SQL."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}
FLAGSHIP = "F13_ranked_page"


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


from . import ingest, places, search, vectors, privacy, alerts, runs, streams  # noqa: E402, F401

"""Runs the SQL of a query over a few titles, to hold it against the same cases as the column functions."""

from __future__ import annotations

import duckdb

from quern.plans import registry


def run(titles: list[str]) -> list[str | None]:
    con = duckdb.connect()
    con.execute("CREATE TABLE norm (id VARCHAR, title VARCHAR, ingested_at TIMESTAMP)")
    con.executemany("INSERT INTO norm VALUES (?, ?, now()::timestamp)", [[f"{i:04}", t] for i, t in enumerate(titles)])
    out = con.execute(f"SELECT key, slug FROM ({registry.ORACLE['document_names']}) ORDER BY key").fetchall()
    return [r[1] for r in out]

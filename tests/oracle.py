"""Compares registered queries with their DuckDB SQL."""

from __future__ import annotations

import glob
import os
from collections import Counter
from contextlib import contextmanager

import duckdb


def rounded(v):
    return round(v, 9) if isinstance(v, float) else v


def same(spark, sf_dir: str, query, sql: str) -> None:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    found = query(spark, sf_dir)
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    expected = Counter(tuple(rounded(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall())
    got = Counter(tuple(rounded(r[c]) for c in sorted(columns)) for r in found.collect())
    assert got == expected


@contextmanager
def without_broadcasts(spark):
    """Plans as they are first, and as large tables have them: no table is broadcast that the code doesn't have broadcast."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def shuffles(df) -> list[tuple]:
    """The shuffles of a plan: their columns with types, and the rows that they have written by now."""
    found, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange":
            columns = [node.output().apply(i) for i in range(node.output().size())]
            found.append(({f"{a.name()}: {a.dataType().simpleString()}" for a in columns}, node.metrics().apply("shuffleRecordsWritten").value()))
    return found

"""Compare registered queries with their DuckDB twins; usable as a script and from tests."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def difference(df, con, sql: str) -> str | None:
    """None when names, types and the multiset of rows are equal."""
    expected = con.execute(sql)
    names = [c[0] for c in expected.description]
    order = sorted(names)
    if sorted(df.columns) != order:
        return f"columns {sorted(df.columns)} against {order}"
    types = {c[0]: str(c[1]) for c in expected.description}
    for name, kind in df.dtypes:
        if SPARK_TYPES.get(kind) != types[name]:
            return f"type of {name}: {kind} against {types[name]}"
    at = [names.index(n) for n in order]
    theirs = Counter(tuple(row[i] for i in at) for row in expected.fetchall())
    ours = Counter(tuple(row) for row in df.select(*order).collect())
    if ours == theirs:
        return None
    extra, missing = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
    return f"rows {sum(ours.values())} against {sum(theirs.values())}; only ours {extra}; only theirs {missing}"


if __name__ == "__main__":
    import __spark_entry__ as contract
    from sqlcorpus.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    sqls = contract.oracle_sql()
    bad = 0
    for name, fn in contract.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            result = difference(fn(spark, sf), con, sqls[name]) if name in sqls else "no twin"
        except Exception as error:
            result = "error " + str(error)[:700]
        bad += result is not None
        print(f"{name:32s} {time.time() - start:6.2f}s {result or 'equal'}"[:1800], flush=True)
    print("different:", bad)

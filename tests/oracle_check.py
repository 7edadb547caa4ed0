"""Compare every registered query with its SQL, from the command line: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def normal(rows, columns):
    """Rows as sorted tuples with columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return "~" if v is None else f"{type(v).__name__}:{v}"

    return sorted(tuple(value(row[i]) for i in order) for row in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """Number of rows, or the first differences."""
    df = query(spark, sf_dir)
    mine = normal(df.collect(), df.columns)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = normal(cursor.fetchall(), names)
    assert sorted(df.columns) == sorted(names), (name, df.columns, names)
    if mine != theirs:
        only_mine, only_theirs = sorted(set(mine) - set(theirs))[:3], sorted(set(theirs) - set(mine))[:3]
        raise AssertionError(f"{name}: {len(mine)} vs {len(theirs)} rows; {only_mine} vs {only_theirs}")
    return len(mine)


if __name__ == "__main__":
    import __spark_entry__ as contract
    from slotledger.session import local_session

    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    session, con = local_session(), connect(where)
    session.sparkContext.setLogLevel("ERROR")
    sqls = contract.oracle_sql()
    for name, query in contract.queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            print(name, "ok", compare(session, con, name, query, sqls[name], where), f"{time.time() - began:.2f}s", flush=True)
        except Exception as error:  # report and go on
            print(name, "FAILED", str(error)[:1500], flush=True)

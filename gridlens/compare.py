"""Run queries beside their SQL twins in DuckDB and compare rows: python -m gridlens.compare [sf_dir] [name ...]."""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterable
from decimal import Decimal
from pathlib import Path
from typing import Any


def plain(value: Any) -> Any:
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows(columns: list[str], data: Iterable) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in data)


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    return con


def differences(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty if both sides agree; else what differs."""
    df = query(spark, sf_dir)
    own = rows(df.columns, df.collect())
    there = con.execute(sql)
    names = [d[0] for d in there.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    other = rows(names, there.fetchall())
    if own == other:
        return ""
    return f"{sum(own.values())} and {sum(other.values())} rows; only ours: {list((own - other).items())[:3]}; only SQL: {list((other - own).items())[:3]}"


def main(args: list[str]) -> int:
    from .session import session
    from .staging import clear
    from .plans.catalogue import ORACLE_SQL, QUERIES

    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark, con, bad = session(), connect(sf_dir), 0
    for name in args[1:] or QUERIES:
        try:
            said = differences(spark, con, sf_dir, QUERIES[name], ORACLE_SQL[name]) if name in ORACLE_SQL else f"no SQL; {QUERIES[name](spark, sf_dir).count()} rows"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        clear(spark)
        bad += bool(said) and not said.startswith("no SQL")
        print(name, "ok" if not said else said, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))

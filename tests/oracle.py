"""Runs queries beside their SQL: python tests/oracle.py FOLDER [NAME...]."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings nodes edges files unresolved_refs eval_items file_types".split()


def plain(value):
    """A value that is equal in both engines."""
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return value


def spark_rows(df) -> Counter:
    names = sorted(df.columns)
    return Counter(tuple(plain(r[n]) for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect())


def duck_rows(folder: str, sql: str) -> tuple[list[str], Counter]:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = Path(folder, f"{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def compare(spark, folder: str, query, sql: str) -> str:
    """Empty if both give the same rows."""
    df = query(spark, folder)
    mine = spark_rows(df)
    names, theirs = duck_rows(folder, sql)
    if names != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {names}"
    if mine != theirs:
        return f"{sum(mine.values())} and {sum(theirs.values())} rows; only here {list((mine - theirs).items())[:3]}; only there {list((theirs - mine).items())[:3]}"
    return ""


def main(folder: str, names: list[str]) -> None:
    import __spark_entry__ as entry

    from graphloom.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name in names or queries:
        began = time.time()
        try:
            said = compare(spark, folder, queries[name], oracles[name]) if name in oracles else f"no SQL, {queries[name](spark, folder).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:900]}"
        bad += bool(said) and not said.startswith("no SQL")
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from quarry.session import ship

    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"}
    s = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    s.stop()


def plain(x):
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, float):
        return round(x, 9)
    if hasattr(x, "asDict"):
        return tuple(plain(v) for v in x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x


def rows(df, *cols):
    """All rows as sorted plain tuples, columns in the given order (by name otherwise)."""
    cols = cols or sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def sql_rows(sql, folder):
    import duckdb

    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(x[i]) for i in order) for x in r.fetchall()), key=repr)

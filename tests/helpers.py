"""Comparison of a query with its SQL."""

from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def views(folder: str = DATA):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(frame) -> list:
    def plain(x):
        if isinstance(x, float):
            return None if x != x else round(x, 6)
        if x is None or (not hasattr(x, "__len__") and x != x):
            return None
        return list(x) if hasattr(x, "__len__") and not isinstance(x, str) else x

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(repr(plain(x)) for x in r) for r in frame.itertuples(index=False)))


def same(spark_frame, con, sql: str) -> None:
    got, want = spark_frame.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:  # nullable integers come as floats
        if got[c].dtype.kind == "i" or want[c].dtype.kind == "i":
            got[c], want[c] = got[c].astype("float64"), want[c].astype("float64")
    assert rows(got) == rows(want)

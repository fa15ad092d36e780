"""Compares a query with its SQL on the same tables."""

import os

import duckdb


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = frame.astype(object).where(frame.notna(), None).values.tolist()
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in clean), key=repr)


def same(spark, query, sql, folder):
    got = query(spark, folder).toPandas()
    with duckdb.connect() as db:
        for f in os.listdir(folder):
            db.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{folder}/{f}')")
        want = db.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)

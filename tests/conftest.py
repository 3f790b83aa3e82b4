from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from keelson.session import get_session

    session = get_session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    db = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db


def rows(frame, digits: int = 9) -> list[tuple]:
    """Rows with columns in name order, as a sorted list; doubles rounded."""
    columns = sorted(frame.columns)
    tidy = lambda v: None if v is None or v != v else round(v, digits) if isinstance(v, float) else v
    out = [tuple(tidy(r[c]) for c in columns) for r in frame.collect()]
    return sorted(out, key=repr)


def duck_rows(db, sql: str, digits: int = 9) -> list[tuple]:
    found = db.sql(sql)
    columns = sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    tidy = lambda v: None if v is None or v != v else round(v, digits) if isinstance(v, float) else v
    return sorted((tuple(tidy(r[k]) for k in at) for r in found.fetchall()), key=repr)

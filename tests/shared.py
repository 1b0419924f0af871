"""What tests of both parts use."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.6f}"
    return str(value)


def rows_of(columns, rows):
    """Rows as a sorted list of texts, columns by name."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_plain(r[k]) for k in order) for r in rows)


def same_as_duckdb(spark, duck, fn, sql):
    got = fn(spark, DATA)
    have = rows_of(got.columns, [tuple(r) for r in got.collect()])
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert have == rows_of(names, cursor.fetchall())

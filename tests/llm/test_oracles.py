"""Every registered query with SQL, row by row against DuckDB on the smallest tables."""

import pytest

from quillon.llm.queries import ORACLES, QUERIES


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: "null" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    rel = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rel.fetchall(), rel.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0

"""Every registered query against its SQL, and none of them vacuous."""

import pytest

from millrace.plans.catalog import ORACLE_SQL, QUERIES

#: Empty at the smallest scale for want of such rows.
MAY_BE_EMPTY = {"exact_copies"}


def rows(names, found):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(r[i] for i in at) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    got = rows(df.columns, df.collect())
    relation = duck.sql(ORACLE_SQL[name])
    assert got == rows(relation.columns, relation.fetchall())
    assert got or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"screen_latency"}))
def test_returns_rows(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.count() > 0 and len(df.columns) == len(set(df.columns))


def test_flagship_counts(spark, small):
    r = QUERIES["confusion_matrix"](spark, small).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (6, 0, 5, 76)

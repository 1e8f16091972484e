import sys

import duckdb
import pytest

from sonde import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(engine.CATALOGUE))
def test_query_equals_its_sql(spark, sf_dir, oracle, name):
    run, sql = engine.CATALOGUE[name]
    df = run(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if sql:
        found = oracle.execute(sql)
        names = [d[0] for d in found.description]
        assert got == canonical(names, found.fetchall())


def test_entry_points(spark, sf_dir):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


def test_everything_else_works_without_the_subpackage(monkeypatch):
    import importlib

    import __spark_entry__ as e

    try:
        for name in [n for n in sys.modules if n.startswith("sonde.llm") or n == "corpus_pipeline"]:
            monkeypatch.delitem(sys.modules, name)
        monkeypatch.setitem(sys.modules, "sonde.llm", None)
        monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
        alone = importlib.reload(e)
        assert set(alone.queries()) == set(engine.CATALOGUE)
    finally:
        monkeypatch.undo()
        importlib.reload(e)

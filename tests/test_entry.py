import importlib
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("absent", ["corpus_pipeline", "docmill.llm.queries", "regex"])
def test_other_queries_do_without_the_training_data_parts(monkeypatch, absent):
    """Their absence, or that of a library which only they need, leaves the rest."""
    import __spark_entry__ as entry

    names = [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("docmill.llm")]
    saved = {n: sys.modules.pop(n) for n in names}
    monkeypatch.setitem(sys.modules, absent, None)
    try:
        with pytest.warns(UserWarning, match="without the training-data operators"):
            again = importlib.reload(entry)
        assert again.llm_queries is None and "pipeline" not in again.queries()
        assert "doc_text_stats" in again.queries() and "doc_text_stats" in again.oracle_sql()
    finally:
        monkeypatch.undo()
        for n in [n for n in sys.modules if n.startswith("docmill.llm")]:
            del sys.modules[n]
        sys.modules.update(saved)
        importlib.reload(entry)


def _values(frame, columns):
    return sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


def _names():
    sys.path.insert(0, ROOT)
    from docmill.plans import catalogue

    return sorted(catalogue.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", _names())
def test_catalogue_matches_sql(spark, name):
    from docmill.plans import catalogue

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    got = catalogue.queries()[name](spark, DATA).toPandas()
    want = db.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert _values(got, columns) == _values(want, columns)

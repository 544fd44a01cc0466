"""Sessions over several tables, and ingestion that goes on after it was killed."""

import threading

import pytest
from pyspark.sql import functions as F
from test_sources_and_lifecycle import documents

from docmill.config import StoreConfig
from docmill.errors import CommitConflict
from docmill.operators import commits as C
from docmill.operators import store
from docmill.plans import lifecycle as L


class Killed(BaseException):
    pass


def numbers(df):
    return sorted(r[0] for r in df.select("n").collect())


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n long")


def test_tables_become_visible_together(spark, tmp_path):
    catalog, a, b = C.Catalog(spark, f"{tmp_path}/c"), f"{tmp_path}/a", f"{tmp_path}/b"
    with C.session_scope(catalog) as s:
        s.append(a, rows(spark, 1))
        assert C.committed(spark, a) == [] and numbers(s.read(a, rows(spark).schema)) == [1]
        s.append(b, rows(spark, 10, 11))
        assert catalog.manifest().tables == {}
    assert numbers(catalog.read(a)) == [1] and numbers(C.read_table(spark, b)) == [10, 11]
    with pytest.raises(ZeroDivisionError), C.session_scope(catalog) as s:
        s.append(a, rows(spark, 2))
        s.replace(b, rows(spark, 12))
        1 / 0  # noqa: B018
    assert numbers(catalog.read(a)) == [1] and numbers(catalog.read(b)) == [10, 11]
    assert len(list((tmp_path / "a").glob("txn=*"))) == 1  # rolled back, files and all


def test_a_killed_session_leaves_no_trace(spark, tmp_path, monkeypatch):
    catalog, a = C.Catalog(spark, f"{tmp_path}/c"), f"{tmp_path}/a"
    with C.session_scope(catalog) as s:
        s.append(a, rows(spark, 1))
    monkeypatch.setattr(C.Session, "rollback", lambda self: None)  # nothing runs in a process that is gone
    with pytest.raises(Killed), C.session_scope(catalog) as s:
        s.append(a, rows(spark, 2))
        raise Killed
    assert numbers(catalog.read(a)) == numbers(C.read_table(spark, a)) == [1]
    assert len(list((tmp_path / "a").glob("txn=*"))) == 2
    assert catalog.vacuum() == [] and len(catalog.vacuum(older_than=-1)) == 1
    assert len(list((tmp_path / "a").glob("txn=*"))) == 1 and numbers(catalog.read(a)) == [1]


def test_two_writers_on_one_table_both_survive(spark, tmp_path):
    catalog, a = C.Catalog(spark, f"{tmp_path}/c"), f"{tmp_path}/a"
    first, second = C.Session(catalog), C.Session(catalog)
    first.append(a, rows(spark, 1))
    second.append(a, rows(spark, 2))
    second.commit()
    first.commit()
    assert numbers(catalog.read(a)) == [1, 2] and catalog.manifest().number == 2
    seen = set()

    def write(k):
        with C.session_scope(catalog) as s:
            s.append(a, rows(spark, k))
        seen.add(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(10, 16)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(seen) == 6 and numbers(catalog.read(a)) == [1, 2, *range(10, 16)] and catalog.manifest().number == 8


def test_replacing_what_another_changed_is_a_conflict(spark, tmp_path):
    catalog, a = C.Catalog(spark, f"{tmp_path}/c"), f"{tmp_path}/a"
    with C.session_scope(catalog) as s:
        s.append(a, rows(spark, 1))
    late = C.Session(catalog)
    late.replace(a, rows(spark, 5))
    with C.session_scope(catalog) as s:
        s.append(a, rows(spark, 2))
    with pytest.raises(CommitConflict):
        late.commit()
    late.rollback()
    calls = []

    def more(s):
        calls.append(1)
        if len(calls) == 1:  # another writer comes in between
            with C.session_scope(catalog) as other:
                other.append(a, rows(spark, 3))
        s.replace(a, s.read(a).withColumn("n", F.col("n") * 10))

    C.transact(catalog, more)
    assert len(calls) == 2 and numbers(catalog.read(a)) == [10, 20, 30]
    catalog.compact(a)
    assert numbers(catalog.read(a)) == [10, 20, 30] and len(catalog.manifest().tables[a]) == 1
    with C.session_scope(catalog) as s:
        s.drop(a)
    assert catalog.read(a, rows(spark).schema).count() == 0


def test_names_are_taken_once(spark, tmp_path):
    assert C._publish(spark, str(tmp_path), "x", "one") and not C._publish(spark, str(tmp_path), "x", "two")
    assert C._text(spark, f"{tmp_path}/x") == "one" and [p.name for p in tmp_path.iterdir()] == ["x"]


# -- resuming ---------------------------------------------------------------

DOCS = [(1, "pending", "http://p/1", None), (2, "parsed", "x", "# Two\n\n## Sub\n\nbody"), (3, "pending", "no.docx", None), (4, "pending", "http://p/1", None)]
DOCS += [(5, "completed", "x", "y"), (6, "failed", "x", "# Six")]


def contents(spark):
    return spark.createDataFrame([("http://p/1", "# One\n\nhello")], "file_path string, markdown string")


def state(spark, outcome, config):
    vectors = store.read_vectors(spark, config).select("vector_id", "chunk_text").collect()
    docs = outcome.documents.select("id", "status", "status_details", F.size("chunks").alias("n")).collect()
    return sorted(map(tuple, docs)), sorted(map(tuple, vectors))


@pytest.fixture(scope="module")
def undisturbed(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("plain")
    config = StoreConfig(f"{base}/v")
    return state(spark, L.ingest(documents(spark, DOCS), contents(spark), config, f"{base}/w"), config)


@pytest.mark.parametrize(("when", "last"), [*(("before", k) for k in range(2, 7)), ("after", 6)])
def test_resume_after_a_kill_at_any_commit(spark, tmp_path, monkeypatch, undisturbed, when, last):
    """A run is killed right before or after its commit number ``last``: marks
    (odd) and stages (even) in turn."""
    config, work = StoreConfig(f"{tmp_path}/v"), f"{tmp_path}/w"
    publish, made = C.Catalog.publish, []

    def dying(self, manifest):
        if len(made) == last and when == "before":
            raise Killed
        made.append(manifest.number)
        done = publish(self, manifest)
        if len(made) == last + 1 and when == "after":
            raise Killed
        return done

    monkeypatch.setattr(C.Catalog, "publish", dying)
    monkeypatch.setattr(C.Session, "rollback", lambda self: None)
    with pytest.raises(Killed):
        L.ingest(documents(spark, DOCS), contents(spark), config, work)
    monkeypatch.undo()
    stage = L.STAGES[(last - 1) // 2]
    marked = last % 2 == 0 if when == "before" else last % 2 == 1
    left = {r["id"]: r["status"] for r in L.Work(spark, work).table().collect()}
    if marked:
        assert left[2 if stage != "parsing" else 1] == stage
    outcome = L.resume(spark, config, work)
    assert state(spark, outcome, config) == undisturbed
    log = {}
    for r in outcome.log.rows().orderBy("seq").collect():
        log.setdefault(r["id"], []).append(r["status"])
    for s, end in zip(L.STAGES, ("parsed", "chunked", "completed")):
        for i in (1, 2, 4):
            # A stage that was marked and not committed is begun once more, no other.
            again = int(marked and s == stage)
            assert log[i].count(s) == (0 if (s, i) == ("parsing", 2) else 1 + again)


def test_resume_needs_a_begun_folder_and_can_retry(spark, tmp_path):
    config, work = StoreConfig(f"{tmp_path}/v"), f"{tmp_path}/w"
    with pytest.raises(ValueError, match="no documents"):
        L.resume(spark, config, work)
    L.ingest(documents(spark, [(6, "failed", "http://p/1", None)]), contents(spark), config, work)
    assert L.resume(spark, config, work).documents.first()["status"] == "failed"
    outcome = L.resume(spark, config, work, retry=True)
    assert outcome.documents.first()["status"] == "completed"
    assert [(t.stage, t.documents, t.failures) for t in outcome.times] == [(s, 1, 0) for s in L.STAGES]
    again = L.ingest(outcome.documents, contents(spark), config, work)  # a table of the folder goes in again
    assert again.documents.count() == 1 and [t.documents for t in again.times] == [0, 0, 0]


def test_a_document_that_gets_no_vector_loses_its_old_ones(spark, tmp_path):
    config, work = StoreConfig(f"{tmp_path}/v"), f"{tmp_path}/w"
    rows = [(1, "parsed", "x", "# One\n\ntext"), (2, "parsed", "x", "# Two\n\ntext")]
    L.ingest(documents(spark, rows), contents(spark), config, work)
    assert store.read_vectors(spark, config).count() == 2
    chunked = documents(spark, [(2, "chunked", "x", "# Two")])
    assert chunked.first()["chunks"] is None
    outcome = L.ingest(chunked, contents(spark), config, work)
    assert {r["id"]: r["status"] for r in outcome.documents.collect()} == {1: "completed", 2: "failed"}
    assert [r["document_id"] for r in store.read_vectors(spark, config).collect()] == [1]
    assert [t.failures for t in outcome.times] == [0, 0, 1]

import corpus_pipeline
import pytest
from helpers import words

from docmill.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages_chain(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.collect()}
        docs = stage(spark, docs, DATA)
        after = [r["doc_id"] for r in docs.collect()]
        assert set(after) <= before and len(set(after)) == len(after)
        sizes.append(len(after))
        if name != "bpe encoding":
            assert docs.columns == columns
    assert sizes[0] > sizes[2] and sizes[-1] == sizes[-2] > 0
    assert corpus_pipeline.run(spark, DATA).count() == sizes[-1]
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]


def test_planted_cases(spark, tmp_path):
    good = " ".join(f"tok{i % 89}en{i}" for i in range(300))
    passage = " ".join(f"bench{i}" for i in range(30))
    rows = [(1, good), (2, good), (3, good + " tail"), (4, passage + " and more"), (5, None), (6, "clean words apart from others")]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], kind)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {1, 5, 6}


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from docmill.llm import storage

    conf = SimpleNamespace(get=lambda *_: None)
    fake = lambda master: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf), conf=conf)
    assert storage.shared_dir(fake("local[4]")).startswith("file:")
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1000]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_dir(fake(master))


def test_intermediate_tables_are_deleted(spark, tmp_path, monkeypatch):
    from docmill.llm import storage

    monkeypatch.setattr(storage, "shared_dir", lambda _: f"file://{tmp_path}")
    left = corpus_pipeline.run(spark, DATA)
    assert left.count() > 0
    assert len([p for p in tmp_path.iterdir() if any(p.iterdir())]) == 1


def test_stages_take_nulls_and_repeats(spark, tmp_path):
    """Every stage on rows with nulls in all columns, repeated rows and no rows."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None)] * 2 + [(1, "", "en", "s", 0)] * 2 + [(2, "some words here", None, None, 1), (None, "x" * 70_000, "", "", 0)]
    docs = spark.createDataFrame(rows, kind)
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(None, None, None), (1, None, 0), (2, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        sizes[name] = stage(spark, docs, str(tmp_path)).count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    # Null and empty texts are equal, and so alike; nothing else is.
    assert sizes == {
        "quality classifier": 6, "exact dedup": 3, "simhash near-dedup": 4, "benchmark decontamination": 6, "bpe encoding": 6,
    }


def test_all_are_registered():
    names = {n.split("_")[0] for n in queries.queries()}
    assert names == {f"op{n}" for n in range(1, 14)}
    assert set(queries.ORACLE_SQL) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    import os

    import duckdb

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    found, want = queries.queries()[name](spark, DATA), db.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    # Rows as they are: pandas would turn whole numbers beside nulls into floats.
    got = found.select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
    assert words("A b-c") == ["a", "b", "c"]

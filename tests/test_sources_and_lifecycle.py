import pytest
from pyspark.sql import functions as F

from docmill.config import ChunkConfig, StoreConfig
from docmill.errors import DatabaseConnectionError, EmbeddingError, VectorStoreError
from docmill.functions import embedding
from docmill.functions.html import markdown_of
from docmill.operators import store
from docmill.plans.lifecycle import StatusLog, ingest, process, reopen
from docmill.schema import DOCUMENTS, STATUSES, valid_status
from docmill.sources import documents as sources
from docmill.sources.pages import fetched, pages_as_markdown, write_markdown
from docmill.sources.pdf import join_pages, page_preview, pdf_pages


def test_html_to_markdown():
    html = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<!-- c --><h1>Head &amp; <b>bold</b></h1><p><b>open<br>next<p>two <em>it</em> <a href='/x'>link</a></p>"
        "<ul><li>one<li>two</ul><ol><li>a</li><li>b</li></ol>&copy;</body></html>"
    )
    got = markdown_of(html)
    assert "# Head & **bold**" in got and "[link](/x)" in got and "*it*" in got
    assert "* one\n* two" in got and "1. a\n2. b" in got and "©" in got
    assert "var t" not in got and "p{}" not in got and " c " not in got
    assert markdown_of("") == "" and markdown_of("<p>unclosed") == "unclosed"


def test_stored_and_fetched_pages(spark):
    pages = spark.createDataFrame([(1, "http://a", "<h1>A</h1>"), (2, "http://b", None)], "page_id long, url string, html string")
    assert {r[0]: r[2] for r in pages_as_markdown(pages).collect()} == {1: "# A", 2: None}
    got = fetched(pages, "url", lambda u: None if u.endswith("b") else "<p>x").collect()
    assert {r[0]: r[1] for r in got} == {"http://a": "<p>x", "http://b": None}


def test_failed_fetches_are_tried_again(spark, monkeypatch):
    from docmill.functions import retry

    assert retry.waits(1) == [] and retry.waits(5) == [4, 4, 8, 10]
    seen, paused = [], []

    def flaky():
        seen.append(1)
        if len(seen) < 3:
            raise OSError("not yet")
        return "done"

    assert retry.retrying(flaky, 3, sleep=paused.append) == "done" and paused == [4, 4]
    with pytest.raises(OSError):
        retry.retrying(lambda: (_ for _ in ()).throw(OSError("never")), 2, sleep=paused.append)


def test_markdown_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"# {i}\n\nb") for i in range(40)] + [(99, None)], "page_id long, markdown string")
    write_markdown(pages, str(tmp_path / "md"), folders=3)
    files = list((tmp_path / "md").rglob("part-*"))
    assert {f.parent.name for f in files} == {"folder=0", "folder=1", "folder=2"}
    text = "".join(f.read_text() for f in files)
    assert sorted(text.split("<!-- ")[1:]) == sorted(f"{i} -->\n# {i}\n\nb\n" for i in range(40))


def test_created_documents_and_log(spark, tmp_path):
    rows = spark.createDataFrame([("A", "# A", ["x"]), ("B", None, None)], "title string, markdown string, tags array<string>")
    docs = sources.create_documents(rows, 7, str(tmp_path / "docs"))
    assert {(r["title"], r["status"]) for r in docs.collect()} == {("A", "pending"), ("B", "pending")}
    assert docs.agg(F.min("id")).first()[0] >= 7
    assert docs.collect() == docs.collect()  # ids and times stay as they are
    with pytest.raises(Exception, match="a document needs a title"):
        sources.create_documents(rows.withColumn("title", F.lit(None).cast("string")), 1, str(tmp_path / "docs"))
    log = sources.log_status(docs, 1).union(sources.log_status(docs.withColumn("status", F.lit("parsed")), 2))
    assert {r["status"] for r in sources.latest_status(log).collect()} == {"parsed"}


def test_pdf_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two|three")
    (tmp_path / "bad.PDF").write_bytes(b"!")

    def parser(data):
        if data == b"!":
            raise ValueError("broken")
        return data.decode().split("|")

    pages = pdf_pages(spark, str(tmp_path), parser)
    texts = {r[0].rsplit("/", 1)[1]: r[1] for r in join_pages(pages).collect()}
    assert texts == {"a.pdf": "one\ntwo\nthree", "bad.PDF": None}
    assert pages.filter("error is not null").count() == 1
    assert [r["text"] for r in page_preview(pages, 2).collect()] == ["one", "two"]


def documents(spark, rows):
    """Rows of (id, status, file_path, markdown)."""
    df = spark.createDataFrame(rows, "id long, status string, file_path string, markdown string")
    now = F.current_timestamp()
    values = {n: F.col(n) for n in df.columns} | {"title": F.lit("t"), "created_at": now, "updated_at": now}
    return df.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in DOCUMENTS.fields])


def test_lifecycle(spark):
    rows = [(i, s, f"http://p/{i}", "# M\n\ntext" if i != 3 else None) for i, s in enumerate(STATUSES)]
    rows += [(20, "pending", "note.docx", None), (21, "pending", "http://p/none", None), (22, "parsed", "x", "")]
    docs = documents(spark, rows)
    contents = spark.createDataFrame([("http://p/0", "# Zero\n\nhello"), ("http://p/1", "one")], "file_path string, markdown string")
    done, vectors = process(docs, contents, StoreConfig("unused"))
    got = {r["id"]: r for r in done.collect()}
    status = {i: r["status"] for i, r in got.items()}
    assert [status[i] for i in range(8)] == [
        "completed", "completed", "completed", "chunking", "failed", "embedding", "completed", "failed",
    ]
    assert got[4]["status_details"] == "Cannot embed doc 4, chunks are missing."
    assert got[0]["title"] == "Zero" and got[1]["title"] == "t"
    assert got[20]["status_details"] == "Parsing failed: Unsupported file type for: note.docx"
    assert got[21]["status_details"] == "Parsing failed: Parsing resulted in empty content."
    assert got[22]["status_details"] == "Cannot chunk doc 22, markdown content is missing."
    assert got[0]["status_details"] == "Successfully embedded 1 chunks."
    assert {r["document_id"] for r in vectors.collect()} == {0, 1, 2}
    nowhere, _ = process(documents(spark, [(1, "pending", None, None)]), contents, StoreConfig("unused"))
    assert nowhere.first()["status_details"] == "Parsing failed: Unsupported file type for: "
    back = {r["id"]: r["status"] for r in reopen(docs).collect()}
    assert back[3] == "parsed" and back[5] == "chunked" and back[7] == "pending" and back[6] == "completed"
    empty, none = process(docs.limit(0), contents, StoreConfig("unused"))
    assert empty.count() == 0 and none.count() == 0


def test_failed_batches_are_skipped(spark):
    with pytest.raises(EmbeddingError):
        embedding.embedder("unknown")
    chunk = "struct<page_content:string,chunk_index:int>"
    texts = ["a", "b", "bad", "c", "d"]
    df = spark.createDataFrame([(1, "t", [(t, i) for i, t in enumerate(texts)])], f"id long, title string, chunks array<{chunk}>")

    rows = store.embed_chunks(df, StoreConfig("x", batch_size=2, model_name="hashing-64"))
    counts = store.embedded_counts(rows).first()
    assert (counts["expected"], counts["embedded"], counts["mismatch"]) == (5, 5, False)
    assert sorted(r["vector_id"] for r in rows.collect()) == [f"1-{i}" for i in range(5)]
    failing = store.embed_chunks(df, StoreConfig("x", batch_size=2, model_name="not-there"))
    got = failing.orderBy("chunk_index").collect()
    assert [r["error"].split(":")[0] for r in got] == [f"Failed to process batch {i // 2 + 1}" for i in range(5)]
    assert store.embedded_counts(failing).first()["mismatch"]


CHUNKS = "id long, title string, chunks array<struct<page_content:string,chunk_index:int>>"


def test_registered_models_work_on_the_workers(spark, tmp_path):
    """Made once in each worker, called once for each batch."""
    folder = str(tmp_path)

    class Counting:
        def __init__(self):
            self._note("made")

        def _note(self, what):
            import os
            import uuid

            open(f"{folder}/{what}-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def __call__(self, texts):
            self._note("called")
            if "bad" in texts:
                raise ValueError("no vector for that")
            return [[float(len(t)), 1.0] for t in texts]

    embedding.register("counting", Counting)
    rows = [(i, "t", [("bad" if (i, k) == (1, 2) else f"c{k}", k) for k in range(5)]) for i in range(6)]
    df = spark.createDataFrame(rows, CHUNKS).repartition(2)
    out = store.embed_chunks(df, StoreConfig("x", batch_size=2, model_name="counting")).collect()
    assert len(out) == 30
    failed = {r["vector_id"]: r["error"] for r in out if r["error"]}
    assert failed == {f"1-{k}": "Failed to process batch 2: no vector for that" for k in (2, 3)}
    names = [p.name for p in tmp_path.iterdir()]
    called = [n for n in names if n.startswith("called")]
    made = [n.split("-")[1] for n in names if n.startswith("made")]
    assert len(called) == 6 * 3 and len(made) == len(set(made))

    class Short:
        def __call__(self, texts):
            return [[1.0]]

    embedding.register("counting", Short)  # the newest registration counts
    again = store.embed_chunks(df, StoreConfig("x", batch_size=5, model_name="counting")).collect()
    assert {r["error"] for r in again} == {"Failed to process batch 1: 1 vectors for 5 chunks"}


def test_failing_models_are_tried_again(spark, tmp_path):
    marker = str(tmp_path / "tried")

    def make():
        def embed(texts):
            import os

            if not os.path.exists(marker):
                open(marker, "w").close()
                raise OSError("first call")
            return [[1.0] for _ in texts]

        return embed

    embedding.register("flaky", make)
    df = spark.createDataFrame([(1, "t", [("a", 0)])], CHUNKS)
    row = store.embed_chunks(df, StoreConfig("x", model_name="flaky", attempts=2)).first()
    assert row["error"] is None and row["vector"] == [1.0]


def test_vector_table(spark, tmp_path):
    config = StoreConfig(str(tmp_path / "v"), collection_name="c")
    kind = "collection_name string, vector_id string, document_id long, chunk_index int, chunk_text string, vector array<float>, error string"
    rows = spark.createDataFrame(
        [
            ("c", "1-0", 1, 0, "x", [1.0, 0.0], None),
            ("c", "1-1", 1, 1, "y", None, "failed"),
            ("c", "2-0", 2, 0, "z", [0.0, 1.0], None),
            ("c", "2-1", 2, 1, "w", [0.0, 1.0], None),
        ],
        kind,
    )
    store.write_vectors(rows, config)
    # The second document now has one chunk, with another text.
    store.write_vectors(spark.createDataFrame([("c", "2-0", 2, 0, "new", [0.0, 2.0], None)], kind), config)
    table = store.read_vectors(spark, config)
    assert sorted((r["vector_id"], r["chunk_text"]) for r in table.collect()) == [("1-0", "x"), ("2-0", "new")]
    assert sources.embeddings_of(table, 2).count() == 1
    assert store.nearest(table, [1.0, 0.1], 1).first()["vector_id"] == "1-0"
    assert store.collection_info(spark, config).first().asDict()["batch_size"] == 100
    with pytest.raises(ValueError):
        StoreConfig("")
    assert issubclass(EmbeddingError, VectorStoreError)
    with pytest.raises(DatabaseConnectionError, match="Failed to connect to database"):
        store.read_vectors(spark, StoreConfig("nofs://nowhere/v"))
    with pytest.raises(DatabaseConnectionError, match="Failed to connect to database"):
        store.write_vectors(rows, StoreConfig("nofs://nowhere/v"))


def test_ingest_logs_every_state(spark, tmp_path):
    """Statuses in progress are logged, vectors carry metadata, nothing runs twice."""
    import json

    rows = [(1, "pending", "http://p/1", None), (2, "parsed", "x", "# Two\n\n## Sub\n\nbody"), (3, "pending", "no.docx", None), (4, "failed", "http://p/1", None)]
    rows += [(5, "completed", "x", "y"), (6, "chunking", "x", "# Six\n\ntext")]
    contents = spark.createDataFrame([("http://p/1", "# One\n\nhello")], "file_path string, markdown string")
    config = StoreConfig(str(tmp_path / "v"))
    outcome = ingest(documents(spark, rows), contents, config, str(tmp_path / "w"), retry=True)
    got = {r["id"]: r["status"] for r in outcome.documents.collect()}
    assert got == {1: "completed", 2: "completed", 3: "failed", 4: "completed", 5: "completed", 6: "completed"}
    latest = {r["id"]: r["status"] for r in outcome.log.latest().collect()}
    assert latest == {k: v for k, v in got.items() if k != 5}
    log = spark.read.parquet(str(tmp_path / "w" / "status_log"))
    states = {}
    for r in log.orderBy("seq").collect():
        states.setdefault(r["id"], []).append(r["status"])
    assert states[1] == ["parsing", "parsed", "chunking", "chunked", "embedding", "completed"]
    assert states[3] == ["parsing", "failed"] and states[6] == states[1][2:]
    assert [(t.stage, t.documents) for t in outcome.times] == [("parsing", 3), ("chunking", 4), ("embedding", 4)]
    assert all(t.seconds > 0 for t in outcome.times)
    two = [json.loads(r["metadata"]) for r in store.read_vectors(spark, config).filter("document_id = 2").collect()]
    assert two[0]["Header 2"] == "Sub" and two[0]["section_path"] == "t > Two > Sub" and two[0]["original_doc_id"] == 2
    assert two[0]["original_doc_title"] == "t" and "is_combined" not in two[0]


def test_a_stage_that_died_can_be_taken_up_again(spark, tmp_path):
    rows = [(1, "parsed", "x", "# One\n\ntext")]
    config = StoreConfig("nofs://nowhere/v")
    with pytest.raises(DatabaseConnectionError):
        ingest(documents(spark, rows), spark.createDataFrame([], "file_path string, markdown string"), config, str(tmp_path / "w"))
    log = StatusLog(spark, str(tmp_path / "w" / "status_log")).latest()
    assert [(r["id"], r["status"]) for r in log.collect()] == [(1, "embedding")]


def test_extra_columns_survive_the_lifecycle(spark):
    df = documents(spark, [(1, "pending", "http://p", None)])
    extra = ["_title", "_sections", "content", "opened", "failure", "old", "taken", "_content"]
    df = df.withColumns({c: F.lit("kept") for c in extra})
    contents = spark.createDataFrame([("http://p", "# P\n\nx")], "file_path string, markdown string")
    done, _ = process(df, contents, StoreConfig("unused"))
    assert done.columns == df.columns
    row = done.first()
    assert row["status"] == "completed" and {row[c] for c in extra} == {"kept"}


def test_resume_and_new_documents(spark, tmp_path):
    docs = documents(spark, [(1, "parsed", "a", "m")])
    wanted = spark.createDataFrame([(1,), (9,)], "id long")
    got = {r["id"]: r["resume_error"] for r in sources.resume(docs, wanted).collect()}
    assert got == {1: None, None: "No document found with ID 9"}
    new = sources.new_documents(spark.createDataFrame([("s1",), ("s2",), (None,)], "source string"), 100, str(tmp_path / "docs"))
    rows = new.collect()
    assert len({r["id"] for r in rows}) == 3 and min(r["id"] for r in rows) >= 100
    assert {r["status"] for r in rows} == {"pending"} and {r["title"] for r in rows} == {"s1", "s2", ""}
    assert new.select(valid_status("status")).first()[0]
    assert sources.by_id(docs, 1).count() == 1 and sources.by_id(docs, 2).count() == 0


def test_serialised_chunks_come_back(spark):
    import json

    from docmill.operators.chunking import with_chunks

    df = spark.createDataFrame([(1, "# A\n\nx", "t")], "id long, markdown string, title string")
    out = with_chunks(df, config=ChunkConfig(enable_semantic=False))
    row = out.select("chunks", store.serialise("chunks").alias("text"), store.deserialise(store.serialise("chunks")).alias("again")).first()
    assert row["chunks"] == row["again"]
    assert json.loads(row["text"]) == [
        {
            "page_content": "# A  \nx",
            "metadata": {
                "Header 1": "A", "chunk_index": 0, "doc_title": "t", "word_count": 3, "char_count": 7,
                "primary_header": "A", "header_level": 1, "section_path": "t > A",
            },
        }
    ]


def test_streaming_ingest(spark, tmp_path):
    from docmill.streaming.ingest import ingest_pages

    spark.createDataFrame([(1, "http://a", "<h1>A</h1><p>b")], "page_id long, url string, html string").write.parquet(
        str(tmp_path / "in")
    )
    stream = spark.readStream.schema("page_id long, url string, html string").parquet(str(tmp_path / "in"))
    config = StoreConfig(str(tmp_path / "v"))
    ingest_pages(stream, str(tmp_path / "d"), config, str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "d")).first()["status"] == "completed"
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1
    spark.createDataFrame([(2, "http://a", "<p>other"), (3, "http://a", "<p>third")], "page_id long, url string, html string").write.mode(
        "append"
    ).parquet(str(tmp_path / "in"))
    ingest_pages(stream, str(tmp_path / "d"), config, str(tmp_path / "c")).awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "d")).collect()) == [1, 2, 3]
    texts = sorted(r["chunk_text"] for r in store.read_vectors(spark, config).collect())
    assert texts == ["# A  \nb", "other", "third"]


def test_tables_are_created_once(spark):
    store.init_tables(spark, "docmill_test")
    store.init_tables(spark, "docmill_test")
    assert {t.name for t in spark.catalog.listTables("docmill_test")} == {"documents", "embeddings"}


def test_pages_that_share_a_url_are_all_ingested(spark, tmp_path):
    import duckdb

    from docmill.plans import catalogue

    urls = ["http://a", "http://a", "http://b", None, None, "http://a", "http://c"]
    rows = [(11 + i, u, f"<h1>P{i}</h1><p>text {i}</p>") for i, u in enumerate(urls)]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows[::-1], "page_id long, url string, html string").coalesce(1).write.parquet(path)
    vectors = catalogue.queries()["ingest_vectors"](spark, str(tmp_path)).collect()
    assert sorted(r["document_id"] for r in vectors) == [11, 12, 13, 14, 16, 17]
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{path}/*.parquet'")
    want = db.sql(catalogue.oracle_sql()["ingest_pages"]).fetchall()
    got = catalogue.queries()["ingest_pages"](spark, str(tmp_path)).select("id", "status", "failure").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    every = catalogue.queries()["ingest_every_page"](spark, str(tmp_path)).select("id", "status", "failure").collect()
    assert sorted(r["id"] for r in every) == [r[0] for r in sorted(rows)]
    assert sorted(map(tuple, every)) == sorted(db.sql(catalogue.oracle_sql()["ingest_every_page"]).fetchall())


def cut_pages(spark, folder):
    """Pages with titles cut at every place of a line of references, as the
    driver's are; and a database that reads them."""
    import duckdb

    line = "A &quot;b&quot; &amp; c &copy; &middot; d"
    html = "<html><head><title>{0}</title></head><body><h1>{0}</h1><p><b>{1}<br></p></body></html>"
    rows = [(11 + n, f"http://a/{n}", html.format(line[: n + 1], line)) for n in range(len(line))]
    path = f"{folder}/pages.parquet"
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(path)
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{path}/*.parquet'")
    return db


def test_references_without_their_semicolon():
    html = "<p>&quot &copy2 &amp &ampx &quotx; &notin; &notit; &lt; &#34 &none &am</p>"
    assert markdown_of(html) == '" ©2 & &x "x; ∉ ¬it; < " &none &am'
    assert markdown_of(html, ["amp"]) == '&quot &copy2 & &x &quotx; ∉ &notit; < " &none &am'
    assert markdown_of("<a href='/?a&copy=1&amp;b'>l</a>", ["amp"]) == "[l](/?a&copy=1&b)"
    assert markdown_of("&quot &amp", ["quot"]) == '" &amp'


def test_markdown_of_cut_titles_is_as_in_sql(spark, tmp_path):
    from docmill.plans import catalogue

    db = cut_pages(spark, tmp_path)
    got = catalogue.queries()["html_to_md"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(db.sql(catalogue.oracle_sql()["html_to_md"]).fetchall())


def test_vectors_of_cut_titles_are_as_in_sql(spark, tmp_path):
    from docmill.plans import catalogue

    db = cut_pages(spark, tmp_path)
    got = catalogue.queries()["ingest_vectors"](spark, str(tmp_path))
    want = db.sql(catalogue.oracle_sql()["ingest_vectors"])
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


def test_resumed_run_over_cut_titles_is_as_in_sql(spark, tmp_path):
    from docmill.plans import catalogue

    db = cut_pages(spark, tmp_path)
    got = catalogue.queries()["resume_from_log"](spark, str(tmp_path))
    want = db.sql(catalogue.oracle_sql()["resume_from_log"])
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())

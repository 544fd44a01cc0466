import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.config import ChunkConfig
from docmill.operators.chunking import chunk_stats, explode_chunks, with_chunks
from docmill.operators.combine import combine_small
from docmill.operators.experimental import (
    budget_pieces,
    chunk_text,
    context_similarities,
    recursive_sections,
    search_threshold,
    statistical_pieces,
)
from docmill.operators.headers import header_context, sections, split_by_headers
from docmill.operators.semantic import breakpoints, semantic_pieces, split_oversized
from docmill.functions.embedding import HashingEmbedder
from docmill.schema import CHUNK


def test_sections_follow_headers():
    text = "intro\n\n# A\n## B\n\nbody\n\n### D\ndeep\n# E\n"
    got = [(s["content"], s["headers"]) for s in sections(text)]
    assert got == [
        ("intro", {}),
        ("# A  \n## B  \nbody", {"Header 1": "A", "Header 2": "B"}),
        ("### D\ndeep", {"Header 1": "A", "Header 2": "B", "Header 3": "D"}),
        ("# E", {"Header 1": "E"}),
    ]


def test_sections_skip_fences_and_deeper_levels():
    fenced = "# A\n```\n# not\n```\n~~~\n## nor\n~~~\nend"
    assert [s["headers"] for s in sections(fenced)] == [{"Header 1": "A"}]
    assert [s["headers"] for s in sections("# A\n\n### C\n\nx", 2)] == [{"Header 1": "A"}]
    jump = [s["headers"] for s in sections("# A\nx\n### C\ny\n## B\nz\n# A\nq")]
    assert jump == [
        {"Header 1": "A"},
        {"Header 1": "A", "Header 3": "C"},
        {"Header 1": "A", "Header 2": "B"},
        {"Header 1": "A"},
    ]
    assert sections("") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["# A", "## B", "### C", "x", "y z", "", "```", "  w  "]), max_size=14))
def test_sections_keep_all_text(lines):
    joined = " ".join(s["content"] for s in sections("\n".join(lines)))
    assert joined.split() == " ".join(lines).split()


def test_header_context_is_not_fence_aware(spark):
    cases = {
        "# A\n## B\n# C": {"Header 1": "C"},
        "# A\n### C\n## B": {"Header 1": "A", "Header 2": "B"},
        "```\n# F\n```": {"Header 1": "F"},
        "####### no\nplain": {},
        "": {},
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for text, got in df.select("t", header_context("t")).collect():
        assert got == cases[text]


def test_shallow_split_takes_context_from_text(spark):
    df = spark.createDataFrame([("### Only\n\ntext",)], "t string")
    got = df.select(split_by_headers("t", 2)).first()[0]
    assert got[0]["headers"] == {"Header 3": "Only"}


def merged(chunks, most, least, tiny):
    """The merge rules, stated as a plain walk."""
    out, i = [], 0
    shared = lambda a, b: {k: v for k, v in a.items() if b.get(k) == v}
    while i < len(chunks):
        text, headers, flag = chunks[i]
        words = len(text.split())
        if words < tiny and i + 1 < len(chunks):
            out.append((text + "\n\n" + chunks[i + 1][0], shared(headers, chunks[i + 1][1]), flag, True))
            i += 2
        elif words >= least:
            out.append((text, headers, flag, None))
            i += 1
        else:
            parts, size, j = [text], words, i + 1
            while j < len(chunks) and size + len(chunks[j][0]) <= most:
                parts.append(chunks[j][0])
                headers = shared(headers, chunks[j][1])
                size += len(chunks[j][0])
                j += 1
                if size >= least:
                    break
            out.append(("\n\n".join(parts), headers, flag, True if len(parts) > 1 else None))
            i = j
    return out


@pytest.mark.parametrize("most,least,tiny", [(2000, 700, 50), (60, 20, 4), (30, 10, 15), (25, 3, 2)])
def test_combine_matches_a_plain_walk(spark, most, least, tiny):
    import random

    rng = random.Random(most)
    docs = []
    for i in range(150):
        n = rng.randrange(0, 9)
        docs.append(
            (
                i,
                [
                    (
                        " ".join("w" * rng.randrange(1, 6) for _ in range(rng.choice([1, 3, 9, 20]))),
                        {"Header 1": rng.choice("ab"), "Header 2": rng.choice("ab")},
                        rng.choice([True, None]),
                        None,
                    )
                    for _ in range(n)
                ],
            )
        )
    df = spark.createDataFrame(docs, f"id long, chunks array<{CHUNK.simpleString()}>")
    config = ChunkConfig(max_size=most, min_size=least, tiny_chunk_threshold=tiny)
    for row, (_, chunks) in zip(df.select("id", combine_small("chunks", config).alias("c")).orderBy("id").collect(), docs):
        got = [(c["content"], c["headers"], c["is_semantic_split"], c["is_combined"]) for c in row["c"]]
        assert got == merged([c[:3] for c in chunks], most, least, tiny)


def test_oversized_chunks_move_to_the_end(spark):
    long = ". ".join(f"alpha beta {i} gamma" for i in range(60)) + ". Zebra."
    chunks = [("a", {"Header 1": "h"}, None, None), (long, {"Header 1": "k"}, None, None), ("b", {}, None, None)]
    df = spark.createDataFrame([(1, chunks)], f"id long, c array<{CHUNK.simpleString()}>")
    got = df.select(split_oversized("c", 500)).first()[0]
    assert [c["content"] for c in got[:2]] == ["a", "b"]
    assert len(got) > 3 and all(c["is_semantic_split"] and c["headers"] == {"Header 1": "k"} for c in got[2:])
    assert " ".join(c["content"] for c in got[2:]) == long
    one = spark.createDataFrame([(1, [("x" * 600, {}, None, None)])], f"id long, c array<{CHUNK.simpleString()}>")
    kept = one.select(split_oversized("c", 500)).first()[0]
    assert kept[0]["is_semantic_split"] is None


def test_breakpoints():
    assert breakpoints([[1, 0], [1, 0], [0, 1], [0, 1]], 50) == [1]
    assert breakpoints([[1, 0]]) == []
    assert semantic_pieces("One sentence", HashingEmbedder()) == ["One sentence"]


def test_whole_chunker(spark):
    rows = [
        (1, "# T\n\nintro words here\n\n## S\n\n" + "word " * 800, None),
        (2, "   \n\t", "x"),
        (3, None, "x"),
        (4, "plain", ""),
        (5, "# Own\n\nx", "Given"),
    ]
    df = spark.createDataFrame(rows, "id long, markdown string, title string")
    out = with_chunks(df)
    errors = {r["id"]: r["chunk_error"] for r in out.collect()}
    assert errors == {1: None, 2: "Text cannot be empty", 3: "Text cannot be empty", 4: None, 5: None}
    chunks = explode_chunks(out)
    got = {(r["id"], r["chunk_index"]): r for r in chunks.collect()}
    assert {i for i, _ in got} == {1, 4, 5}
    assert got[1, 0]["doc_title"] == "T" and got[4, 0]["doc_title"] == "Untitled" and got[5, 0]["section_path"] == "Given > Own"
    for r in got.values():
        assert r["word_count"] == len(r["page_content"].split()) and r["char_count"] == len(r["page_content"])
        assert r["header_level"] == len(r["headers"])
    for i in {i for i, _ in got}:
        assert sorted(k for d, k in got if d == i) == list(range(sum(d == i for d, _ in got)))
    stats = {r["id"]: r["total_chunks"] for r in chunk_stats(chunks).collect()}
    assert stats[4] == 1
    assert with_chunks(df.limit(0)).count() == 0


def test_config_is_checked():
    with pytest.raises(ValueError):
        ChunkConfig(max_size=700, min_size=700)
    with pytest.raises(ValueError):
        ChunkConfig(max_header_level=7)


def test_experimental_chunkers(spark):
    text = "# A\n" + "x " * 600 + "\n## B\n" + "y " * 600 + "\n## C\nz"
    got = recursive_sections(text)
    # A piece that is split again only knows the headers in its own text.
    assert [s["headers"] for s in got] == [{"Header 1": "A"}, {"Header 2": "B"}, {"Header 1": "A", "Header 2": "C"}]
    assert got[0]["content"].startswith("# A\nx x") and got[2]["content"] == "# A\n## C\nz"
    pieces = budget_pieces(". ".join(f"s{i} one two three" for i in range(300)) + "\0", HashingEmbedder(), 50, 100)
    assert all("\0" not in p and len(p.split()) <= 100 for p in pieces) and len(pieces) > 5
    df = spark.createDataFrame([("# A\n\nb",), (None,)], "t string")
    assert [r[0] for r in df.select(chunk_text("t", "markdown")).collect()] == [["# A\nb"], None]
    with pytest.raises(ValueError):
        chunk_text("t", "other")


def test_failures_keep_the_text(spark, monkeypatch):
    """A model that isn't there, or a split that fails, leaves chunks whole."""
    from docmill.errors import ChunkingError
    from docmill.operators.chunking import check_chunked

    long = "# A\n\n" + "Some words here. " * 300
    df = spark.createDataFrame([(1, long, "t"), (2, "", "t")], "id long, markdown string, title string")
    out = with_chunks(df, config=ChunkConfig(model="not-there"))
    chunks = explode_chunks(out).collect()
    assert len(chunks) == 1 and chunks[0]["is_semantic_split"] is None and len(chunks[0]["page_content"]) > 4000
    with pytest.raises(ChunkingError, match="Text cannot be empty"):
        check_chunked(out)
    check_chunked(out.filter("id = 1"))
    bad = spark.createDataFrame([("# A\n\nx",)], "t string").select(split_by_headers("t", "six")).first()[0]
    assert [(s["content"], s["headers"]) for s in bad] == [("# A\n\nx", {"Header 1": "A"})]


def topics(n, size):
    """Sentences of 40 words, which change with every ``size`` sentences."""
    return [" ".join(f"w{i // size}x{k}" for k in range(40)) + "." for i in range(n)]


def test_context_similarity_looks_back_over_the_window():
    import numpy as np

    rng = np.random.default_rng(3)
    v = [*rng.normal(size=(6, 5)), np.zeros(5), np.ones(5)]
    for window in (1, 2, 3):
        for i, got in enumerate(context_similarities(v, window), 1):
            mean = np.mean(v[max(0, i - window) : i], axis=0)
            size = np.linalg.norm(mean) * np.linalg.norm(v[i])
            assert got == (round(float(mean @ v[i] / size), 9) if size > 1e-9 else 0)


def test_threshold_brings_the_median_split_into_range():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(100, 800))
        similarity, tokens = np.round(rng.random(n - 1), 9), rng.integers(1, 40, n).tolist()
        threshold = search_threshold(similarity, tokens, 50, 400)
        ends = [0, *(np.flatnonzero(similarity < threshold) + 1), n]
        median = np.median([sum(tokens[a:b]) for a, b in zip(ends, ends[1:])])
        low, high = np.median(similarity) - np.std(similarity), np.median(similarity) + np.std(similarity)
        assert 40 <= median <= 410 or not low + 0.02 < threshold < high - 0.02


def test_statistical_chunker():
    embed = HashingEmbedder()
    text = " ".join(topics(36, 6)) + "  End\0ing.\n"
    pieces = statistical_pieces(text, embed, 200, 2000)
    assert "".join(pieces) == text.replace("\0", "")
    # The document's own threshold finds the changes of topic, which the fixed
    # percentile does not.
    firsts = [p.split()[0][:3] for p in pieces]
    assert firsts[:6] == ["w0x", "w1x", "w2x", "w3x", "w4x", "w5x"]
    assert [p.split()[0][:3] for p in budget_pieces(text, embed, 200, 2000)] != firsts
    assert all(200 <= len(p.split()) < 2000 for p in pieces[:-1])
    assert statistical_pieces("", embed) == [] and statistical_pieces("one", embed) == ["one"]
    long = statistical_pieces("same words here. " * 2000, embed, 200, 500)
    assert max(len(p.split()) for p in long) <= 500 and "".join(long) == "same words here. " * 2000


def test_no_split_where_similarities_leave_no_threshold():
    """Where median plus deviation is negative, no threshold is ever tried."""
    import numpy as np

    turning = lambda texts: [[[1.0, 0.0], [-1.0, 2.0], [-1.0, -2.2]][k % 3] for k in range(len(texts))]
    text = " ".join("word " * 19 + "end." for _ in range(30))
    similarity = context_similarities(turning([0] * 30))
    assert np.median(similarity) + np.std(similarity) < 0
    assert search_threshold(similarity, [20] * 30) == float("-inf")
    assert statistical_pieces(text, turning, 200, 2000) == [text]

import hashlib
import random
import zlib

import pytest
from helpers import TEXTS, documents
from pyspark.sql import functions as F

from docmill.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """(root, for each node its siblings from below, "" where it has none)."""
    paths = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
        for i, ids in enumerate(below):
            for k in ids:
                paths[k].append("".join(nodes[i // 2 * 2 : i // 2 * 2 + 2][:1] if i % 2 else nodes[i + 1 : i + 2]))
        nodes = [H(*run) for run in runs]
        below = [sum(below[i : i + 2], []) for i in range(0, len(below), 2)]
    return (nodes[0] if nodes else None), paths


def plain(rows):
    """doc rows (doc_id, source, lang, n_chars, text) to sorted result rows."""
    groups = {}
    for doc_id, source, lang, n, text in rows:
        leaf = lambda m: H(*map(field, (doc_id, source, lang, m, text)))  # noqa: B023, E731
        bad = zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 0
        groups.setdefault(lang, []).append(((doc_id is not None, doc_id or 0), leaf(n), leaf(n + 1 if bad and n is not None else n), doc_id))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots, out = [], []
    for g in names:
        groups[g].sort(key=lambda r: (r[0], r[1]))
        subroots.append(tree([r[1] for r in groups[g]]))
    root, tops = tree([r for r, _ in subroots])
    for k, g in enumerate(names):
        for i, (_, leaf, seen, doc_id) in enumerate(groups[g]):
            path = subroots[k][1][i] + tops[k]
            fold, at = seen, [(i, n) for n in range(len(subroots[k][1][i]))] + [(k, n) for n in range(len(tops[k]))]
            for sibling, (place, level) in zip(path, at):
                odd = (place >> level) % 2
                fold = H(fold) if sibling == "" else H(sibling, fold) if odd else H(fold, sibling)
            out.append((doc_id, leaf, subroots[k][0], root, H(*path), fold, fold == root))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    made = M.document_manifest(docs)
    cols = ["doc_id", "leaf", "subroot", "root", M.proof_digest().alias("p"), "folded_root", "verified"]
    return sorted(map(tuple, made.select(*cols).collect()), key=str)


@pytest.mark.parametrize("levels", [1, 10])
def test_equals_plain_trees(spark, monkeypatch, levels):
    """Steps of one or two levels stand for groups of many blocks."""
    monkeypatch.setattr(M, "LEVELS", levels)
    rng = random.Random(levels)
    rows = [(i, "s", rng.choice(["en", "en", "en", "de", None, "é"]), i, f"text {i}") for i in range(37)]
    rows += [(i, "s", "one", 3, "x") for i in [5]] + [(7, "s", "en", 1, "again"), (7, "s", "en", 1, "again"), (None, None, "en", None, None)]
    assert run(spark, rows) == plain(rows)


def test_groups_of_many_sizes(spark, monkeypatch):
    monkeypatch.setattr(M, "LEVELS", 2)
    rows = [(i, "s", f"g{n}", 1, "t" * i) for n in (1, 2, 3, 4, 5, 8, 9, 16, 17) for i in range(n)]
    assert run(spark, rows) == plain(rows)


def test_one_row(spark):
    assert run(spark, [(1, "s", "en", 1, "t")]) == plain([(1, "s", "en", 1, "t")])


def test_sort_merge_joins_and_many_groups(spark, monkeypatch):
    monkeypatch.setattr(M, "LEVELS", 1)
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    rows = [(i, "s", f"g{i % 5}", 1, "t") for i in range(11)]
    assert run(spark, rows) == plain(rows)


def test_edge_cases(spark):
    docs = documents(spark).withColumns({"g": F.lit(1), "idx": F.lit(2), "leaf": F.lit("x"), "size": F.lit(0)})
    rows = [(i, s, "en", len(t or ""), t) for i, t, s in TEXTS]
    made = M.document_manifest(docs)
    got = made.select("doc_id", "leaf", "subroot", "root", M.proof_digest().alias("p"), "folded_root", "verified")
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
    assert M.document_manifest(docs.limit(0)).count() == 0


def test_a_changed_field_fails_and_only_its_row(spark):
    rows = [(i, "s", "en", i, f"t{i}") for i in range(20)]
    made = run(spark, rows)
    bad = {r[0] for r in made if not r[6]}
    assert bad == {i for i in range(20) if zlib.crc32(str(i).encode()) % 7 == 0} and bad


def test_largest_count(spark):
    top = 2**63 - 1
    rows = [(i, "s", "en", top, "t") for i in range(30)]
    assert run(spark, rows) == plain(rows)

import math
import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from helpers import TEXTS, documents

from docmill.llm import langid as G
from docmill.llm import queries

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")
SMALL = {p: i for i, p in enumerate([b" ", b"a", b"b", b" a", b"ab", b"ba", b"aba", b" ab", b"bb"])}


def cuts(unit):
    """All ways to cut a unit into pieces of SMALL."""
    if not unit:
        yield []
    for end in range(1, len(unit) + 1):
        if unit[:end] in SMALL:
            for rest in cuts(unit[end:]):
                yield [SMALL[unit[:end]], *rest]


def test_sums_over_all_cuts():
    rng = np.random.default_rng(2)
    logs = np.log(rng.dirichlet(np.ones(len(SMALL)), 3)).T
    pick = random.Random(2)
    for n in range(1, 7):
        units = [b" " + bytes(pick.choice(b"ab") for _ in range(n)) for _ in range(5)]
        sums = G.Lattices(units, SMALL, 3).forward(logs)[-1]
        weights = np.arange(1.0, 6)
        counts = G.Lattices(units, SMALL, 3).expected(logs[:, 1], weights)
        want = np.zeros(len(SMALL))
        for unit, row, weight in zip(units, sums, weights):
            ways = list(cuts(unit))
            for k in range(3):
                assert math.isclose(row[k], math.log(sum(math.exp(sum(logs[p, k] for p in way)) for way in ways)))
            total = math.exp(row[1])
            for way in ways:
                for p in way:
                    want[p] += weight * math.exp(sum(logs[q, 1] for q in way)) / total
        assert np.allclose(counts, want)


def test_sums_of_many_units_at_once():
    """By hashes and scaled sums the same as by dictionary and logarithms, also
    where scaled sums vanish."""
    pieces = G.read_vocabulary(VOCABULARY)
    table = G.PieceTable(pieces)
    rng, pick = np.random.default_rng(5), random.Random(5)
    logs = np.log(rng.dirichlet(np.ones(len(pieces)), 2).T + 1e-12)
    logs[[i for p, i in pieces.items() if max(p) >= 0x80]] = -60  # no language has them
    words = ["".join(pick.choice("etaoinéß中x") for _ in range(pick.randrange(1, 33))) for _ in range(300)] + ["\u4e2d" * 32, "a"]
    units = [b" " + w.encode() for w in words]
    got = G.unit_sums(units, pieces, table, table.scaled(logs), logs)
    want = np.array([G.Lattices([u], pieces, 33).forward(logs)[-1, 0] for u in units])
    assert np.allclose(got, want, rtol=1e-9) and got.min() < -1000
    for unit in units[:40]:
        rolled = table.rolled([unit], len(unit))
        for end in range(1, len(unit) + 1):
            for start in range(max(0, end - table.longest), end):
                assert table.find(rolled, start, end)[0] == pieces.get(unit[start:end], -1)


def test_a_step_raises_the_likelihood(spark):
    rows = [("x", b" abab", 3), ("x", b" bb", 1), ("y", b" aba", 2), ("y", b" b", 5)]
    units = spark.createDataFrame(rows, "lang string, unit binary, n long")
    size = len(G.read_vocabulary(VOCABULARY))
    pieces = G.read_vocabulary(VOCABULARY)
    logs, before = np.full((size, 2), -np.log(size)), -np.inf
    for _ in range(3):
        counts = G._expected_counts(units, ["x", "y"], logs, VOCABULARY)
        now = sum(n * G.Lattices([u], pieces, 33).forward(logs)[-1, 0, "xy".index(l)] for l, u, n in rows)
        assert now > before
        before, logs = now, np.log((counts + 1e-9) / (counts + 1e-9).sum(0))


def syllables(seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiouéü") for _ in range(2)) for _ in range(30)]


def corpus(n=240):
    rng = random.Random(4)
    own = {"aa": syllables(1), "bb": syllables(2), "cc": syllables(3)}
    rows = []
    for i in range(n):
        lang = rng.choice(["aa", "aa", "bb", "cc"])
        text = " ".join("".join(rng.choice(own[lang]) for _ in range(2)) for _ in range(rng.randrange(2, 40)))
        rows.append((i, text.capitalize() + f" {i}.", lang))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, l, "s", 1) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_held_out_accuracy_and_score(spark):
    rows = corpus()
    docs = table(spark, rows)
    model = G.train(docs, VOCABULARY)
    assert model.languages == ["aa", "bb", "cc"] and np.allclose(np.exp(model.logs).sum(0), 1, atol=1e-3)
    got = G.identify(docs, model).collect()
    truth = {i: l for i, _, l in rows}
    pieces, logs = G.read_vocabulary(VOCABULARY), model.logs.astype(float)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        total = model.shares + sum(G.Lattices([u], pieces, 33).forward(logs)[-1, 0] for u in G.units_of(texts[r["doc_id"]]))
        posterior = np.exp(total - np.logaddexp.reduce(total))
        assert r["lang_pred"] == model.languages[posterior.argmax()] and math.isclose(r["score"], posterior.max(), rel_tol=1e-6)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)


def test_held_out_languages_are_not_learned(spark):
    rows = corpus(80)
    flipped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else l) for i, t, l in rows]
    found = [sorted(map(tuple, G.identify(table(spark, x), G.train(table(spark, x), VOCABULARY)).collect())) for x in (rows, flipped)]
    assert found[0] == found[1]


def test_edge_cases(spark, monkeypatch):
    docs = documents(spark)
    nothing = G.train(docs.limit(0), VOCABULARY)
    assert {(r["lang_pred"], r["score"]) for r in G.identify(docs, nothing).collect()} == {("und", 0.0)}
    assert G.identify(docs.limit(0), nothing).count() == 0
    rows = [*corpus(60), (None, "no id", "qq"), (900, None, "ww"), (901, "12 34", "vv"), (902, "text", None)]
    twice = table(spark, rows + rows[:20])
    model = G.train(twice, VOCABULARY)
    again = G.train(table(spark, rows), VOCABULARY)
    assert model.languages == again.languages == ["aa", "bb", "cc"] and np.allclose(model.logs, again.logs)
    monkeypatch.setattr(G, "_SHORT", 5)
    monkeypatch.setattr(G, "BLOCK_UNITS", 3)
    monkeypatch.setattr(G, "REMEMBERED", 5)
    score = model.scorer()
    texts = [t or "" for _, t, _ in TEXTS if len(t or "") < 1000] + [t for _, t, _ in corpus(30)]
    blocks = score(texts)
    monkeypatch.undo()
    assert [b[0] for b in blocks] == [b[0] for b in model.scorer()(texts)]
    got = G.identify(docs, model).collect()
    assert len(got) == len(TEXTS)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {3, 4, 5}
    assert all(0 <= r["score"] <= 1 for r in got)


def test_long_runs_are_read_whole():
    units = list(G.units_of("X" * 100 + "ß" * 40 + " 7_ab"))
    assert b"".join(u[1:] for u in units).decode() == "x" * 100 + "ß" * 40 + "ab"
    assert max(len(u.decode()) for u in units) == 33


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_op12_langid(spark):
    """Columns, the split, and accuracy on the rows that weren't learned from."""
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.op12_langid(spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"] for r in got} == set(docs) and len(got) == len(docs)
    held = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in docs[r["doc_id"]]["text"] or ""))

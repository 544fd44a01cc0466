import pickle
import random

import numpy as np
import pytest
from helpers import TEXTS, documents, words

from docmill.llm import decontaminate as D
from docmill.llm.fm_index import FmIndex, WaveletTree, suffix_array


def test_index_finds_every_place():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 150))
        text = rng.integers(1, 6, n)
        index = FmIndex(text, sample=int(rng.integers(1, 9)))
        lengths = rng.integers(1, 6, 20)
        patterns = np.zeros((20, 5), int)
        for i, k in enumerate(lengths):
            patterns[i, :k] = rng.integers(1, 7, k)
        low, high = index.search(patterns, lengths)
        for i, k in enumerate(lengths):
            want = [p for p in range(n - k + 1) if (text[p : p + k] == patterns[i, :k]).all()]
            rows = np.arange(low[i], max(low[i], high[i]))
            assert sorted(index.locate(rows).tolist()) == want


def test_ranks_and_suffixes():
    values = np.array([3, 1, 4, 1, 5, 0, 2, 6])
    tree = WaveletTree(values, 3)
    at = np.arange(9)
    for s in range(8):
        want = [int((values[:i] == s).sum()) for i in at]
        assert tree.rank(np.full(9, s), at).tolist() == want
    assert tree.access(np.arange(8))[0].tolist() == values.tolist()
    text = np.array([2, 1, 2, 1, 2, 0])
    assert suffix_array(text).tolist() == sorted(range(6), key=lambda i: text[i:].tolist())


def brute(docs, items, window=13, share=20):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1)):
            if w:
                windows.setdefault(tuple(w[k : k + window]), set()).add(item)
    out = []
    for ident, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                owners = windows.get(tuple(w[k : k + n]))
                if owners:
                    hit.update(range(k, k + n))
                    found |= owners
        names = sorted(str(x) for x in found if x is not None)
        out.append((ident, len(w), len(hit), names, bool(hit) and share * len(hit) >= len(w)))
    return out


def tables(spark):
    rng = random.Random(4)
    pool = ["the", "of", "alpha", "beta", "Gamma", "é", "x9"]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, text(rng.choice([5, 13, 20, 40]))) for i in range(30)]
    items += [(30, "short one"), (31, ""), (32, None), (None, text(15)), (5, items[5][1])]
    docs = list(TEXTS) + [(200 + i, text(rng.choice([3, 60, 300])), "s") for i in range(60)]
    for i, (_, t) in enumerate(items):
        docs.append((400 + i, f"{text(30)} {(t or '').upper()}! {text(5)} {t}", "s"))
    docs.append((500, " zz ".join(["short one"] * 3 + ["pad"] * 200), "s"))
    return docs, items, spark.createDataFrame(items, "item_id long, text string")


def compare(got, want):
    rows = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in got]
    assert sorted(map(str, rows)) == sorted(map(str, want))


def test_matches_brute_force(spark):
    docs, items, benchmark = tables(spark)
    want = brute(docs, items)
    assert sum(w[4] for w in want) > 20
    compare(D.decontaminate(documents(spark, docs), benchmark).collect(), want)
    clean = D.drop_contaminated(documents(spark, docs), benchmark)
    assert clean.columns == documents(spark).columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(w[0]) for w in want if not w[4])


def test_many_blocks_and_split_runs(spark, monkeypatch):
    docs, items, benchmark = tables(spark)
    monkeypatch.setattr(D, "BLOCK_WORDS", 60)
    monkeypatch.setattr(D, "SHARD_WORDS", 50)
    compare(D.decontaminate(documents(spark, docs), benchmark).collect(), brute(docs, items))


def test_empty_tables(spark):
    docs, items, benchmark = tables(spark)
    assert D.decontaminate(documents(spark).limit(0), benchmark).count() == 0
    none = D.decontaminate(documents(spark), benchmark.limit(0)).collect()
    assert len(none) == len(TEXTS) and not any(r["n_hit"] or r["contaminated"] for r in none)
    assert D.drop_contaminated(documents(spark), benchmark.limit(0)).count() == len(TEXTS)


@pytest.mark.parametrize("filtered", [True, False])
def test_long_texts_go_to_several_shards(monkeypatch, filtered):
    """No index grows beyond its bound, and no window at a cut is lost."""
    monkeypatch.setattr(D, "SHARD_WORDS", 40)
    rng = random.Random(8)
    pool = [b"a", b"b", b"c", b"d", b"e"]
    items = [(str(i), [rng.choice(pool) for _ in range(rng.choice([2, 5, 9]))]) for i in range(40)] + [("none", []), (None, [b"a"] * 6)]
    texts = [b" ".join(rng.choice([*pool, b"zz"] if n % 2 else pool) for _ in range(n)) for n in (0, 1, 3, 700, 55, 39, 40, 41, 501)]
    phrases = D.Phrases(items, 5)
    shard, found, sizes = D.Shard(5, phrases if filtered else None), D.Found(), []

    def settle():
        sizes.append(shard.size)
        index = shard.index()
        found.take(pickle.loads(pickle.dumps(index)) if index else None, phrases)
        shard.clear()

    for doc, text in enumerate(texts):
        for _ in shard.add(doc, text.split()):
            settle()
    settle()
    assert max(sizes) <= 2 * D.SHARD_WORDS + 2 and len(sizes) > 20
    rows = [(i, t.decode()) for i, t in enumerate(texts)]
    for ident, n, hit, names, _ in brute(rows, [(i, b" ".join(w).decode()) for i, w in items], 5):
        assert sum(b - a for a, b in found.spans.get(ident, ())) == hit
        assert sorted(found.items.get(ident, ())) == names


def test_phrases_know_their_owners():
    items = [("x", list("abcd")), ("y", list("bcd")), (None, list("zz")), ("x", list("abcd")), ("w", [])]
    p = D.Phrases([(i, [c.encode() for c in w]) for i, w in items], 3)
    names = {v: k.decode() for k, v in p.vocabulary.items()}
    got = {"".join(names[v] for v in row if v): p.owners_of(i) for i, row in enumerate(p.patterns.tolist())}
    assert got == {"abc": ["x"], "bcd": ["x", "y"], "zz": []}
    assert p.named == ["x", "y"] and p.shortest == 2


def test_clashing_names_and_many_blocks_when_rows_are_kept(spark, monkeypatch):
    docs, items, benchmark = tables(spark)
    monkeypatch.setattr(D, "BLOCK_WORDS", 60)
    monkeypatch.setattr(D, "BROADCAST_ROWS", 3)
    clean = D.drop_contaminated(documents(spark, docs), benchmark)
    assert clean.columns == documents(spark).columns
    want = sorted(str(w[0]) for w in brute(docs, items) if not w[4])
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == want

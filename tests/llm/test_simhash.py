import re

import numpy as np
import pytest
import xxhash
from helpers import TEXTS, Links, documents, lower

from docmill.llm import simhash as S


def plain_print(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_prints(n, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
    out = [base]
    for _ in range(3):
        y = base[rng.integers(0, n, n // 3)].copy()
        for _ in range(rng.integers(1, 5)):
            y ^= np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64)
        out.append(y)
    return np.unique(np.concatenate(out))


def roots(fps, a, b):
    forest = S.Forest(len(fps))
    forest.link(np.searchsorted(fps, a), np.searchsorted(fps, b))
    return forest.roots().tolist()


@pytest.mark.parametrize("radius", [0, 1, 4, 9])
@pytest.mark.parametrize("most", [1, 60, 50_000])
def test_trees_find_all_classes(radius, most, monkeypatch):
    monkeypatch.setattr(S, "ASKED_ROWS", 200)
    fps = near_prints(700 if radius < 9 else 200, radius)
    split = set()
    for level in range(S.Trunk(radius).base, S._DEEPEST):
        shards, n = np.unique(S.Trunk(radius, split).place(fps, False)[0], return_counts=True)
        full = {int(s) for s, k in zip(shards, n) if k > most and S.Trunk.depth(int(s)) == level}
        split |= full
    trunk = S.Trunk(radius, split)
    shard, fp, budget = trunk.place(fps)
    assert (budget < 0).sum() == len(fps)
    assert most > 1 or radius < 9 or max(S.Trunk.depth(int(s)) for s in np.unique(shard)) > len(S._TRUNK)
    counts = dict(zip(*(x.tolist() for x in np.unique(shard, return_counts=True))))
    slices = S.Slices({k: n for k, n in counts.items() if n > S.ASKED_ROWS})
    shard, fp, budget = slices.deal(shard, fp, budget, radius)
    a, b = [], []
    for s in np.unique(shard):
        here = shard == s
        if (budget[here] < 0).any():
            x, y = S.shard_links(fp[here], budget[here], radius, S.Trunk.depth(int(s) // S._SLICES))
            a.append(x)
            b.append(y)
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius, 1))
    assert roots(fps, np.concatenate(a), np.concatenate(b)) == roots(fps, fps[i], fps[j])


def test_forest_joins_accepted_pairs():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 300, 900), rng.integers(0, 300, 900)
    fits = lambda x, y: (x * 7 + y * 7) % 3 != 0
    forest, plain = S.Forest(300, fits), Links(range(300))
    for at in range(0, 900, 250):
        forest.link(a[at : at + 250], b[at : at + 250])
    for x, y in zip(a.tolist(), b.tolist()):
        if fits(x, y):
            plain.link(x, y)
    assert forest.roots().tolist() == [plain.root(x) for x in range(300)]
    assert len(forest.edges) == 300 - len({plain.root(x) for x in range(300)})
    assert all(fits(x, y) for x, y in forest.edges)


def test_bands_bring_similar_sizes_together(monkeypatch):
    monkeypatch.setattr(S, "PART_NODES", 40)
    rng = np.random.default_rng(1)
    for similarity in (0.5, 0.8, 0.95):
        n = rng.integers(1, 90, 500)
        key = rng.integers(0, 2**62, 500)
        k, c = np.unique(S.Bands(similarity, {}).band(n), return_counts=True)
        bands = S.Bands(similarity, dict(zip(k.tolist(), ((x, x) for x in c.tolist()))))
        cell, row, asked = bands.deal(key, n)
        met, load = set(), []
        for x in np.unique(cell):
            here = cell == x
            stored, asks = row[here & ~asked].tolist(), row[here & asked].tolist()
            load.append(len(stored))
            met.update((min(i, j), max(i, j)) for i in stored for j in asks)
        assert max(load) < 120
        i, j = np.nonzero(np.triu(np.minimum.outer(n, n) >= similarity * np.maximum.outer(n, n), 1))
        assert set(zip(i.tolist(), j.tolist())) <= met


def test_classes_match_brute_force(spark):
    rows = list(TEXTS)
    base = [f"w{i % 97}q{i}" for i in range(400)]
    for n in range(12):
        changed = list(base)
        for k in range(n):
            changed[k * 30] = f"new{n}x{k}"
        rows.append((100 + n, " ".join(changed), "s"))
    got = S.simhash_classes(documents(spark, rows)).collect()
    prints = [plain_print(t) for _, t, _ in rows]
    links = Links(range(len(rows)))
    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 4:
                links.link(i, j)
    least = {}
    for i, (ident, _, _) in enumerate(rows):
        r = links.root(i)
        known = [x for x in (least.get(r), ident) if x is not None]
        least[r] = min(known) if known else None
    want = [(ident, f"{p:016x}", least[links.root(i)]) for i, ((ident, _, _), p) in enumerate(zip(rows, prints))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert S.simhash_classes(documents(spark).limit(0)).count() == 0


def test_one_document_of_each_class_stays(spark):
    base = [f"w{i % 97}q{i}" for i in range(400)]
    rows = [(i, " ".join([*base[:-1], f"end{i}"]), "s") for i in range(20)]
    rows += [(50 + i, " ".join(f"other{i}x{k}" for k in range(200)), "s") for i in range(5)] + [(90, None, "s"), (None, "", "s")]
    df = documents(spark, rows)
    left = S.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 50, 51, 52, 53, 54, 90]
    assert S.drop_near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [9, 100_000])
def test_links_are_verified_by_similarity(spark, monkeypatch, most):
    """Near copies far apart in bits go, documents close in bits stay."""
    monkeypatch.setattr(S, "PART_NODES", most)
    import random

    rng = random.Random(5)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    rows, similar = [], {}
    for i in range(60):
        base = fresh(rng.choice([60, 120, 240]))
        changed = list(base)
        for k in rng.sample(range(len(base)), rng.choice([1, 2, 3, 4, 6]) * len(base) // 120 + 1):
            changed[k] = f"new{i}x{k}"
        x, y = (set(zip(*[w[j:] for j in range(5)])) for w in (base, changed))
        similar[2 * i + 1] = len(x & y) / len(x | y) >= 0.8
        rows += [(2 * i, " ".join(base), "s"), (2 * i + 1, " ".join(changed), "s")]
    prints = [S.fingerprint(t.encode(), 5) for _, t, _ in rows]
    near = {2 * i + 1: (prints[2 * i] ^ prints[2 * i + 1]).bit_count() <= 9 for i in range(60)}
    assert any(similar[k] and not near[k] for k in near) and any(near[k] and not similar[k] for k in near)
    left = {r["doc_id"] for r in S.drop_near_duplicates(documents(spark, rows)).collect()}
    assert left == {i for i, _, _ in rows} - {k for k, s in similar.items() if s}


def test_parities_never_rule_out_similar_sets():
    rng = np.random.default_rng(3)
    ruled, sets = 0, []
    for n in [1, 4, 5, 9, 63, 64, 65, 300, 5000]:
        for apart in (0, n // 9, n // 4, n):
            pool = rng.integers(0, 2**63, n + apart, dtype=np.uint64)
            sets += [np.unique(pool[:n]), np.unique(pool[apart:])]
    parities = S.Parities(np.array([len(x) for x in sets]), [S.parity_of(x) for x in sets], 0.8)
    a, b = np.triu_indices(len(sets), 1)
    may = parities.may_be_similar(a, b)
    similar = np.array([S.jaccard(sets[i], sets[j]) >= 0.8 for i, j in zip(a, b)])
    assert not (similar & ~may).any() and similar.any() and (~may).sum() > 0.9 * (~similar).sum()


def plain_classes(texts, k=5, similarity=0.8):
    """Classes of all pairs of distinct texts, by their sets."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    links = Links(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or (x and y and len(x & y) / len(x | y) >= similarity):
                links.link(i, j)
    return [links.root(i) for i in range(len(texts))]


@pytest.mark.parametrize("most", [25, 100_000])
def test_dropped_documents_match_an_exact_join(spark, monkeypatch, most):
    """Chains and hubs of near copies, and templates just under the bound."""
    import random

    monkeypatch.setattr(S, "PART_NODES", most)
    rng = random.Random(9)
    texts = []
    for size, copies, edits in ((120, 60, 5), (200, 40, 4), (300, 25, 6), (30, 20, 1)):
        base = [f"t{size}w{rng.randrange(10**6)}" for _ in range(size)]
        for i in range(copies):
            words = list(base)
            for _ in range(rng.randrange(edits)):
                words[rng.randrange(size)] = f"n{rng.randrange(10**9)}"
            texts.append(" ".join(words))
            base = words if size == 300 else base  # a chain
    texts = list(dict.fromkeys(texts)) + ["", "one", "one two"]
    classes = plain_classes(texts)
    got = {r["doc_id"] for r in S.drop_near_duplicates(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got == {min(i for i, c in enumerate(classes) if c == root) for root in set(classes)}
    assert len(got) < 0.7 * len(texts)


def test_only_equal_sets_at_similarity_one(spark):
    rows = [(1, "a b c d e f", "s"), (2, "A  b c d e f", "s"), (3, "a b c d e g", "s")]
    got = {r["doc_id"] for r in S.drop_near_duplicates(documents(spark, rows), similarity=1.0).collect()}
    assert got == {1, 3}

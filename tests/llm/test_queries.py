"""The registered queries themselves, over a whole small table, against plain
restatements of what they are to return or the library that they stand for."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict
from math import log2

import numpy as np
import public_tokenizers as P
import pytest
from helpers import Links, words
from test_scans import base_spans
from test_simhash import plain_print
from tokenizers import Tokenizer

from docmill.llm import license_scan as L
from docmill.llm import queries
from docmill.llm import secret_scan as X

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def rows(spark, name):
    got = queries.queries()[name](spark, DATA).collect()
    return {r["doc_id"]: r for r in got}, len(got)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op4_simhash(spark, docs):
    got, n = rows(spark, "op4_simhash")
    prints = {i: plain_print(t) for i, t, _ in docs}
    links = Links(prints)
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                links.link(a, b)
    assert n == len(docs)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {
        i: (f"{p:016x}", links.root(i)) for i, p in prints.items()
    }


def live_spans(docs):
    """The added spans by a second reading of the method: owners of each value,
    and of values of one owner the irregular ones."""
    found, owners = defaultdict(list), defaultdict(set)
    for i, text, source in docs:
        for number, (kind, pattern, group, least) in enumerate(X.BASE + X.MORE):
            for m in pattern.finditer(text):
                if len(m.group(group)) >= least:
                    found[i].append((number, m.span(), m.span(group), m.group(group)))
                    owners[m.group(group)].add((source or "").split("/")[0])
    out = defaultdict(set)
    for i, matches in found.items():
        for number, whole, inner, value in matches:
            bits = -sum(c / len(value) * log2(c / len(value)) for c in Counter(value).values())
            if len(owners[value]) == 1 and bits >= X.LIVE_ENTROPY:
                base = number < len(X.BASE)
                out[i].add((*(inner if base else whole), len(X.KINDS) - 1 if base else number))
    return out


def test_op6_secret_scan(spark, docs, tmp_path):
    """The table's rows and made-up ones that share their values in many ways."""
    rng = random.Random(3)
    value = lambda n: "".join(rng.choice("abcdefABCDEF0123456789") for _ in range(n))
    values = [value(24) for _ in range(60)] + ["a" * 20, "0f" * 16, value(32).lower()]
    forms = ["password = '{}'", "see ghp_{0}{0}", "Bearer {}", "ftp://me:{}@h/", "eyJ{0}.{0}.{0}", "AKIA{}", "{}", "api_key:{} and token: {}"]
    made = list(docs)
    for i in range(400):
        v = values[min(rng.randrange(63), rng.randrange(63))]
        made.append((10_000 + i, f"é {rng.choice(forms).format(v, v)} end", f"own{rng.randrange(6)}/r{rng.randrange(3)}"))
    docs = made
    kind = "doc_id long, text string, source string"
    spark.createDataFrame(docs, kind).write.parquet(str(tmp_path / "documents.parquet"))
    result = queries.op6_secret_scan(spark, str(tmp_path)).collect()
    got, n = {r["doc_id"]: r for r in result}, len(result)
    added = live_spans(docs)
    assert n == len(docs) and len(added) > 20
    for i, text, _ in docs:
        base = base_spans(text)
        kinds = [k for _, k, _ in base]
        named = ",".join(f"{X.KINDS[k]}:{s}:{e}" for s, k, e in base)
        r = got[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [kinds.count(k) for k in range(3)]
        assert r["base_sha256"] == sha(named.encode())
        spans = sorted([*base, *((s, k, e) for s, e, k in added.get(i, ()))])
        assert r["spans"] == ",".join(f"{X.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_op7_token_counts(spark, docs):
    got, n = rows(spark, "op7_token_counts")
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert n == len(docs)
    for i, text, _ in docs:
        tokens = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(text.encode()), tokens, tokens > 512)


def test_op8_quality(spark, docs):
    """Columns, the split, and held-out accuracy on the largest table at hand."""
    got, n = rows(spark, "op8_quality")
    assert n == len(docs)
    for i, _, _ in docs:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    large = "/root/testdata/sf0.1"
    if os.path.isdir(large):
        labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
        held = [r for r in queries.op8_quality(spark, large).collect() if r["held_out"] and r["doc_id"] in labels]
        assert len(held) > 1000
        assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_op9_bpe_codec(spark, docs):
    got, n = rows(spark, "op9_bpe_codec")
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert n == len(docs)
    for i, text, _ in docs:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded.encode()))
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want


def license_spans(w):
    """(label, coverage, start, end, words in place) of every template that some
    part of ``w`` is near enough to, by the whole table of edit distances: no grams,
    no diagonals."""
    found = []
    for label, statement, must in L.TEMPLATES:
        t, must = statement.split(), set(must.split())
        n = len(t)
        free = n - -(-n * 80 // 100)
        if len(set(t) & set(w)) < n - free - (n - len(set(t))):
            continue
        row = [(0, 0, -1, -1)] * (len(w) + 1)
        for i in range(n):
            fixed = t[i] in must
            new = [(row[0][0] + (99 if fixed else 1), *row[0][1:])]
            for p, word in enumerate(w):
                cost, hits, first, last = row[p]
                same = (cost, hits - 1, p if first < 0 else first, p) if word == t[i] else (cost + (99 if fixed else 1), hits, first, last)
                out = (row[p + 1][0] + (99 if fixed else 1), *row[p + 1][1:])
                more = (new[p][0] + 1, *new[p][1:])
                new.append(min(same, out, more))
            row = new
        found += [(label, -h / n, s, e + 1, -h) for c, h, s, e in row if c <= free]
    return found


def license_labels(w):
    """The labels of ``license_spans``, without spans inside one that has more
    words in place."""
    found = license_spans(w)
    inside = lambda a, b: b[2] <= a[2] and a[3] <= b[3] and b[4] > a[4] and b[3] - b[2] >= a[3] - a[2]
    return {a[0] for a in found if not any(inside(a, b) for b in found)}


def edited(rng, statement):
    """A statement with a few words replaced, put in, left out or swapped."""
    w = statement.split()
    for _ in range(rng.randrange(1 + len(w) // 4)):
        at, kind = rng.randrange(len(w)), rng.randrange(4)
        if kind == 0:
            w[at] = f"new{rng.randrange(9)}"
        elif kind == 1:
            w.insert(at, f"put{rng.randrange(9)}")
        elif kind == 2 and len(w) > 2:
            del w[at]
        elif at:
            w[at - 1], w[at] = w[at], w[at - 1]
    return w


def test_op10_license_scan(spark, docs, tmp_path):
    """Base columns by a plain walk, the method's labels by whole tables of edit
    distances, over the table's rows and made-up ones: edited, shuffled and
    interleaved statements."""
    rng = random.Random(8)
    made = list(docs)
    statements = [s for _, s, _ in L.TEMPLATES]
    pad = lambda: [f"pad{rng.randrange(9)}" for _ in range(rng.randrange(4))]
    for k in range(600):
        a, b = rng.choice(statements), rng.choice(statements)
        w = edited(rng, a)
        if k % 5 == 1:
            rng.shuffle(w)
        if k % 5 == 2:
            w += edited(rng, b)
        if k % 5 == 3:
            other = b.split()
            w = [x for pair in zip(w, other) for x in pair] + w[len(other) :] + other[len(w) :]
        made.append((50_000 + k, " ".join(pad() + w + pad()), "s"))
    made.append((60_000, "licensed under cc by sa 4 0 nc 4 0", "s"))
    spark.createDataFrame(made, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op10_license_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(made)
    named = 0
    for i, text, _ in made:
        w = words(text)
        places = [(k, label) for p, label in L.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts, base = [k for k, _ in places], {label for _, label in places}
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted(base))
        labels = license_labels(w)
        named += bool(labels)
        assert r["labels"] == ",".join(sorted(base | labels)), text
        assert 0 <= r["score"] <= 1 and (r["score"] >= 0.8) == bool(r["labels"])
    assert got[60_000]["labels"] == "cc-by-sa" and named > 250


@pytest.mark.parametrize("name", ["op11_merkle", "op13_fim"])
def test_queries_match_their_sql(spark, tmp_path, name):
    """Over the table's rows, and over made-up ones with nulls and marks."""
    import duckdb

    made = [(1, None, None, None, None), (2, "<P> x", "en", "s", 5), (3, "", "en", None, 0), (9, "a b\nc é<S", None, "s", 9), (9, "a b", "de", "s", 3)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    for folder, files in ((DATA, f"{DATA}/documents.parquet"), (str(tmp_path), f"{tmp_path}/documents.parquet/*.parquet")):
        db = duckdb.connect()
        db.sql(f"create view documents as select * from '{files}'")
        found = queries.queries()[name](spark, folder)
        want = db.sql(queries.ORACLE_SQL[name])
        assert sorted(found.columns) == sorted(want.columns)
        got = found.select(*want.columns).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))

"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_codec import bpe_round_trip
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .fim import fill_in_middle
from .langid import identify
from .langid import train as train_languages
from .license_scan import license_scan
from .merkle import document_manifest, proof_digest
from .quality import quality_scores, train
from .secret_scan import added_spans, base_spans, secret_scan, span_list
from .simhash import simhash_classes
from .token_count import token_counts
from .url_filter import RULES, url_verdicts
from .warc import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, _table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages")).drop("alias_class")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned, judged = secret_scan(_table(spark, sf_dir, "documents"))
    rows = scanned.join(added_spans(judged), "row", "left").withColumn("base", base_spans())

    def count(kind: int):
        return F.size(F.filter("kinds", lambda k: k == kind)).cast("long")

    none = F.filter("base", lambda s: F.lit(False))
    return rows.select(
        F.col("id").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        span_list(F.concat("base", F.coalesce("added", none))).alias("spans"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, _table(spark, sf_dir, "labels")))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_round_trip(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents")).drop("spans")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = document_manifest(_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root", "verified"
    )


def op12_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return identify(docs, train_languages(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(_table(spark, sf_dir, "documents"), texts=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_url_filter": op2_url_filter,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_simhash": op4_simhash,
        "op5_decontaminate": op5_decontaminate,
        "op6_secret_scan": op6_secret_scan,
        "op7_token_counts": op7_token_counts,
        "op8_quality": op8_quality,
        "op9_bpe_codec": op9_bpe_codec,
        "op10_license_scan": op10_license_scan,
        "op11_merkle": op11_merkle,
        "op12_langid": op12_langid,
        "op13_fim": op13_fim,
    }


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = (
    "regexp_extract_all("
    + _LOWER.format("coalesce(text, '')")
    + r", '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')"
)


def _rule_sql(host: str, path: str, answer: str) -> str:
    """The longest rule that fits, as a CASE in the order of length."""
    cases = []
    for verdict, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"({host} = '{h}' OR suffix({host}, '.{h}')) AND prefix({path}, '{p}')"
        cases.append(f"WHEN {fits} THEN '{h + p if answer == 'rule' else verdict}'")
    return f"CASE {' '.join(cases)} END"


def _host_sql(url: str) -> str:
    return _LOWER.format(f"coalesce(regexp_extract({url}, '://([^/?#]*)', 1), '')")


def _path_sql(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '://[^/?#]*([^?#]*)', 1), '')"


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || {value}, '-')"


def _leaf_sql(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field_sql, ['doc_id', 'source', 'lang', n_chars, 'text']))})"


#: crc32 bit by bit: a byte is folded in, then eight shifts follow.
_CRC_SQL = """
    xor(list_reduce(
        list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
        lambda crc, byte: list_reduce([xor(crc, byte), 1, 2, 3, 4, 5, 6, 7, 8],
                                      lambda x, bit: xor(x >> 1, 3988292384 * (x & 1))),
        4294967295), 4294967295)
"""


def _tree_sql(nodes: str, leaves: str) -> str:
    """All nodes (g, n, lvl, idx, h) of binary trees over ``leaves`` (g, n, idx, h)."""
    return f"""
        {nodes} AS (
            SELECT g, n, 0::BIGINT AS lvl, idx, h FROM {leaves}
            UNION ALL
            SELECT g, n, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx))
            FROM {nodes} WHERE ((n - 1) >> lvl) > 0 GROUP BY g, n, lvl, idx // 2
        )
    """


def _walk_sql(walk: str, start: str, nodes: str) -> str:
    """From each row of ``start`` (k, g, n, idx, fold, proof) to its tree's root."""
    return f"""
        {walk} AS (
            SELECT k, g, n, 0::BIGINT AS lvl, idx, fold, proof FROM {start}
            UNION ALL
            SELECT w.k, w.g, w.n, w.lvl + 1, w.idx // 2,
                   sha256(CASE WHEN s.h IS NULL THEN w.fold WHEN w.idx % 2 = 1 THEN s.h || w.fold ELSE w.fold || s.h END),
                   w.proof || coalesce(s.h, '')
            FROM {walk} w LEFT JOIN {nodes} s ON s.g = w.g AND s.lvl = w.lvl AND s.idx = xor(w.idx, 1)
            WHERE ((w.n - 1) >> w.lvl) > 0
        )
    """


#: DuckDB SQL for the queries that SQL can express over whole tables.  That of
#: op2 reads canonical links in their plain form only.
ORACLE_SQL = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload FROM pages
        ), t AS (
            SELECT page_id, strlen(payload) AS n, sha1(payload) AS digest,
                   max(page_id) OVER (PARTITION BY payload) AS last_id
            FROM p
        )
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END
                   AS record_type,
               CASE WHEN n >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
        FROM t
    """,
    "op2_url_filter": f"""
        WITH RECURSIVE named AS (
            SELECT url AS a, regexp_extract(unnest(regexp_extract_all(
                       html, '(?i)<link [^>]*rel="canonical"[^>]*>')), 'href="([^"]*)"', 1) AS b
            FROM pages
        ), edges AS (
            SELECT a, b FROM named WHERE b <> '' UNION SELECT b, a FROM named WHERE b <> ''
        ), reach AS (
            SELECT a, a AS b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b
        ), classes AS (
            SELECT a AS url, bool_or({_rule_sql(_host_sql("b"), _path_sql("b"), "verdict")} = 'block') AS blocks,
                   bool_or({_rule_sql(_host_sql("b"), _path_sql("b"), "verdict")} = 'allow') AS allows
            FROM reach GROUP BY a
        ), p AS (
            SELECT page_id, url, {_host_sql("url")} AS host, {_path_sql("url")} AS path FROM pages
        )
        SELECT page_id, host, path, {_rule_sql("host", "path", "rule")} AS rule,
               coalesce({_rule_sql("host", "path", "verdict")},
                        CASE WHEN blocks AND NOT coalesce(allows, false) THEN 'block' END, 'allow') AS verdict
        FROM p LEFT JOIN classes USING (url)
    """,
    "op3_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY text) AS keep_id,
               count(*) OVER (PARTITION BY text) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text) AS kept,
               sha256(text) AS text_sha256
        FROM t
    """,
    "op5_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(13, len(ws)) AS n,
                   unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2),
                          lambda i: array_to_string(ws[i:i + least(13, len(ws)) - 1], ' '))) AS w
            FROM b WHERE len(ws) > 0
        ),
        grams AS (
            SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i,
                   unnest(list_transform(range(1, len(ws) - n + 2),
                          lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS w
            FROM d, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n
        ),
        found AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, w)),
        hits AS (
            SELECT doc_id, count(DISTINCT k) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id
        ),
        items AS (
            SELECT doc_id, count(DISTINCT item_id) AS n_items,
                   string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
            FROM found GROUP BY doc_id
        )
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op11_merkle": f"""
        WITH RECURSIVE seen AS (
            SELECT doc_id, coalesce('v' || lang, '') AS g, {_leaf_sql("n_chars")} AS leaf,
                   {_leaf_sql(f"(n_chars + ({_CRC_SQL} % 7 = 0)::INT)")} AS tampered
            FROM documents
        ), leaves AS (
            SELECT *, row_number() OVER () AS k, leaf AS h,
                   row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
                   count(*) OVER (PARTITION BY g) AS n
            FROM seen
        ), {_tree_sql("nodes", "leaves")}, subroots AS (
            SELECT g AS own, h, '' AS g, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n
            FROM nodes WHERE ((n - 1) >> lvl) = 0
        ), {_tree_sql("tops", "subroots")}, own AS (
            SELECT k, g, n, idx, tampered AS fold, '' AS proof FROM leaves
        ), {_walk_sql("walk", "own", "nodes")}, ends AS (
            SELECT w.k, s.own, s.h AS subroot, s.g, s.n, s.idx, w.fold, w.proof
            FROM walk w JOIN subroots s ON s.own = w.g WHERE ((w.n - 1) >> w.lvl) = 0
        ), {_walk_sql("rest", "ends", "tops")}
        SELECT doc_id, leaf, subroot, root.h AS root, sha256(r.proof) AS proof_sha256, r.fold AS folded_root,
               r.fold = root.h AS verified
        FROM rest r JOIN leaves USING (k) JOIN ends USING (k), (SELECT h FROM tops WHERE ((n - 1) >> lvl) = 0) root
        WHERE ((r.n - 1) >> r.lvl) = 0
    """,
    "op13_fim": r"""
        WITH units AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS seed,
                   regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
            FROM documents
        ), drawn AS (
            SELECT *, len(u)::BIGINT AS n,
                   ('0x' || substr(seed, 1, 8))::BIGINT % (len(u) + 1) AS c1, ('0x' || substr(seed, 9, 8))::BIGINT % (len(u) + 1) AS c2,
                   CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || substr(seed, 17, 8))::BIGINT % 100 >= 90
                        THEN 'plain' WHEN ('0x' || substr(seed, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM units
        ), parts AS (
            SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p,
                   array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
                   array_to_string(u[greatest(c1, c2) + 1:], '') AS s
            FROM drawn
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts
    """,
}

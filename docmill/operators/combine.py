"""Merging of small neighbouring chunks, and the metadata of finished chunks.

Everything here is an expression over the chunk array within a document's row,
so no chunk is ever shuffled to meet its neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions.text import char_count, word_count
from ..schema import CHUNK, FINAL_CHUNK

_CHUNK = CHUNK.simpleString()
_STATE = (
    f"struct<out:array<{_CHUNK}>,mode:string,size:int,parts:array<string>,"
    "headers:map<string,string>,semantic:boolean>"
)

#: States of the fold: nothing pending, a tiny chunk, or a run of small ones.
_NONE, _TINY, _SMALL = "none", "tiny", "small"


def common_headers(a: Column, b: Column) -> Column:
    """The headers that both maps hold with the same value."""
    return F.map_filter(a, lambda k, v: F.try_element_at(b, k).eqNullSafe(v))


def combine_small(chunks: Column | str, config: ChunkConfig = ChunkConfig()) -> Column:
    """Merge small chunks with their followers, in one fold from the left.

    A chunk of fewer words than ``tiny_chunk_threshold`` is joined with the next
    one, whatever the size, and the result is final.  One of at least
    ``min_size`` words stands alone.  Any other starts a run that takes
    followers while its size, in words for the first chunk plus characters for
    the others, stays within ``max_size``, and ends once it has reached
    ``min_size``.  A merged chunk keeps the headers that all parts share and the
    flags of its first part."""
    array = F.col(chunks) if isinstance(chunks, str) else chunks

    def state(out, mode, size, parts, headers, semantic) -> Column:
        return F.struct(
            out.alias("out"),
            F.lit(mode).alias("mode"),
            size.alias("size"),
            parts.alias("parts"),
            headers.alias("headers"),
            semantic.alias("semantic"),
        ).cast(_STATE)

    nothing = F.array().cast("array<string>")
    no_headers = F.create_map().cast("map<string,string>")

    def emitted(content, headers, semantic, combined) -> Column:
        chunk = F.struct(
            content.alias("content"),
            headers.alias("headers"),
            semantic.alias("is_semantic_split"),
            combined.alias("is_combined"),
        )
        return F.array(chunk.cast(_CHUNK))

    def pending(acc: Column) -> Column:
        """What the state still holds, as an array of no or one chunk."""
        merged = F.when(F.size(acc["parts"]) > 1, F.lit(True))
        one = emitted(F.array_join(acc["parts"], "\n\n"), acc["headers"], acc["semantic"], merged)
        return F.when(acc["mode"] == _NONE, F.array().cast(f"array<{_CHUNK}>")).otherwise(one)

    def idle(out: Column) -> Column:
        return state(out, _NONE, F.lit(0), nothing, no_headers, F.lit(None))

    def fresh(out: Column, x: Column) -> Column:
        words = word_count(x["content"])
        start = (words, F.array(x["content"]), x["headers"], x["is_semantic_split"])
        return (
            F.when(words < config.tiny_chunk_threshold, state(out, _TINY, *start))
            .when(words >= config.min_size, idle(F.concat(out, F.array(x.cast(_CHUNK)))))
            .otherwise(state(out, _SMALL, *start))
        )

    def step(acc: Column, x: Column) -> Column:
        size = acc["size"] + char_count(x["content"])
        parts = F.concat(acc["parts"], F.array(x["content"]))
        shared = common_headers(acc["headers"], x["headers"])
        done = F.concat(
            acc["out"], emitted(F.array_join(parts, "\n\n"), shared, acc["semantic"], F.lit(True))
        )
        grows = (acc["mode"] == _SMALL) & (size <= config.max_size)
        return (
            F.when(acc["mode"] == _TINY, idle(done))
            .when(grows & (size >= config.min_size), idle(done))
            .when(grows, state(acc["out"], _SMALL, size, parts, shared, acc["semantic"]))
            .otherwise(fresh(F.concat(acc["out"], pending(acc)), x))
        )

    empty = idle(F.array().cast(f"array<{_CHUNK}>"))
    return F.aggregate(array, empty, step, lambda acc: F.concat(acc["out"], pending(acc)))


def final_metadata(chunks: Column | str, title: Column | str) -> Column:
    """Chunks with index, sizes and their place in the header trail.

    ``header_level`` counts the headers in the trail, and ``section_path``
    begins with the document's title."""
    array = F.col(chunks) if isinstance(chunks, str) else chunks
    name = F.col(title) if isinstance(title, str) else title

    def final(x: Column, i: Column) -> Column:
        keys = F.array_sort(F.map_keys(x["headers"]))
        trail = F.transform(keys, lambda k: F.element_at(x["headers"], k))
        return F.struct(
            x["content"].alias("page_content"),
            x["headers"].alias("headers"),
            x["is_semantic_split"].alias("is_semantic_split"),
            x["is_combined"].alias("is_combined"),
            i.cast("int").alias("chunk_index"),
            name.alias("doc_title"),
            word_count(x["content"]).cast("int").alias("word_count"),
            char_count(x["content"]).cast("int").alias("char_count"),
            F.try_element_at(trail, F.lit(-1)).alias("primary_header"),
            F.size(trail).alias("header_level"),
            F.array_join(F.concat(F.array(name), trail), " > ").alias("section_path"),
        )

    return F.transform(array, final).cast(f"array<{FINAL_CHUNK.simpleString()}>")

"""Substring deduplication with fixed-block anchors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskmill.llm.common import (
    SECOND, found_in, free_names, mixed, pack, pack_sorted, released_group, text_bytes, unpack, unpack_sorted,
    window_hashes, word_hashes,
)

WINDOW = 13
# Texts are worked on in chunks of about this many bytes, each small in a task's memory.
CHUNK_BYTES = 6 * 1024 * 1024
# A bucket of hashes gets what texts of about this many bytes have; a chunk answers each bucket with one row.
BUCKET_BYTES = 16 * 1024 * 1024
# An anchor hash has 48 bits: a chance hit only adds windows that the full comparison turns down.
ANCHOR_BITS = np.uint64(48)
_NO_ID = np.iinfo(np.int64).max


class _Chunk:
    """Some documents in a row: the hash of every word and, if asked for, the words."""

    def __init__(self, ids: pa.ChunkedArray, texts: pa.ChunkedArray, words: bool = False) -> None:
        self.ids = ids.fill_null(_NO_ID).to_numpy().astype(np.int64)
        self.words, hashes, sizes = [], [], []
        for text in texts:
            here = (text.as_py() or b"").split()
            sizes.append(len(here))
            hashes.append(word_hashes(here))
            if words:
                self.words.append(here)
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def inside(self, size: int) -> np.ndarray:
        """Which windows of this many words lie in one document."""
        n = max(0, len(self.hashes) - size + 1)
        return self.doc[:n] == self.doc[size - 1 : size - 1 + n]

    def place(self, n: int) -> np.ndarray:
        """The place of the first n words in their documents."""
        return np.arange(n) - self.starts[self.doc[:n]]


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, int)


def _by_bucket(keys: np.ndarray, bits: int, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending keys: a bucket is a range of hashes."""
    top = (keys >> np.uint64(bits - 32)).astype(np.uint64)
    bucket = (top * np.uint64(buckets)) >> np.uint64(32)
    begin = _runs(bucket)
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(begin, [*begin[1:], len(keys)])]


_BLOBS = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("more", pa.binary())])
BLOBS = "chunk int, bucket int, keys binary, more binary"


def _blobs(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, _BLOBS)


def _read(table: pa.Table, words: bool = False) -> _Chunk:
    """The id comes last but two in every chunk, the text last but one."""
    return _Chunk(table.column(table.num_columns - 3), table.column(table.num_columns - 2), words)


def _anchors_of(buckets: int, anchor: int):
    """Every rolling window of a chunk as one entry per hash, marked if a reference block has it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        chunk = _read(table)
        inside = chunk.inside(anchor)
        hashes = (window_hashes(chunk.hashes, anchor) >> (np.uint64(64) - ANCHOR_BITS))[inside]
        block = (chunk.place(len(inside)) % anchor == 0)[inside]
        doc = chunk.doc[: len(inside)][inside]
        order = np.argsort(hashes, kind="stable")
        hashes, block, doc = hashes[order], block[order], doc[order]
        begin = _runs(hashes)
        if not len(begin):
            return _blobs([])
        ends = np.concatenate([begin[1:], [len(hashes)]])
        many = doc[begin] != doc[ends - 1]
        reference = np.logical_or.reduceat(block, begin)
        hashes = hashes[begin]
        entries = (hashes << np.uint64(2)) | (reference.astype(np.uint64) << np.uint64(1)) | many.astype(np.uint64)
        return _blobs([
            {"chunk": int(key[0].as_py()), "bucket": bucket, "keys": pack_sorted(entries[a:b])}
            for bucket, a, b in _by_bucket(hashes, int(ANCHOR_BITS), buckets)
        ])

    return run


def _split(table: pa.Table, unpacked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of all blobs of a bucket, which blob each is from, and the chunk of every blob."""
    sizes = pc.binary_length(table.column("keys")).to_numpy() // 8
    keys, done = np.empty(sizes.sum(), np.uint64), 0
    for x, size in zip(table.column("keys"), sizes):
        keys[done : done + size] = unpacked(x.as_py())
        done += size
    return keys, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.array(table.column("chunk").to_pylist())


def _shared_anchors(key: tuple, table: pa.Table) -> pa.Table:
    """For each chunk the hashes that a reference block and another document have.

    A bucket is the most that a task holds at once, so what is no longer needed goes at once.
    """
    hashes, blob, chunks = _split(table, unpack_sorted)
    # The marks are the lowest bits: equal hashes come together all the same.
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    blob = blob[order]
    del order
    marks = (hashes & np.uint64(3)).astype(np.uint8)
    hashes >>= np.uint64(2)
    begin = _runs(hashes)
    flags = np.bitwise_or.reduceat(marks, begin)
    del marks
    counts = np.diff(begin, append=len(hashes))
    del begin
    shared = ((flags & 2) > 0) & ((counts > 1) | ((flags & 1) > 0))
    keep = np.repeat(shared, counts)
    del counts
    hashes, blob = hashes[keep], blob[keep]
    order = np.argsort(blob, kind="stable")
    hashes, blob = hashes[order], blob[order]
    begin = _runs(blob)
    return _blobs([
        {"chunk": int(chunks[blob[a]]), "bucket": 0, "keys": pack_sorted(hashes[a:b])}
        for a, b in zip(begin, [*begin[1:], len(blob)])
    ])


def _gathered(table: pa.Table, unpacked=unpack_sorted) -> np.ndarray:
    parts = [unpacked(x.as_py()) for x in table.column("keys")]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _windows(chunk: _Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and 32 more bits of every window."""
    other = mixed(chunk.hashes ^ np.uint64(SECOND))
    return window_hashes(chunk.hashes, size), window_hashes(other, size, SECOND) >> np.uint64(32)


def _extended(buckets: int, anchor: int, size: int):
    """The hits extended to whole windows: per window sequence the smallest id of the chunk."""

    def run(key: tuple, docs: pa.Table, hits: pa.Table) -> pa.Table:
        anchors = np.sort(_gathered(hits))
        if not len(anchors) or not docs.num_rows:
            return _blobs([])
        chunk = _read(docs)
        inside = chunk.inside(size)
        hit = found_in(window_hashes(chunk.hashes, anchor) >> (np.uint64(64) - ANCHOR_BITS), anchors) >= 0
        upto = np.concatenate([[0], np.cumsum(hit)])
        n = len(inside)
        with_hit = upto[size - anchor + 1 : size - anchor + 1 + n] > upto[:n]
        at = np.flatnonzero(inside & with_hit)
        if not len(at):
            return _blobs([])
        first, second = _windows(chunk, size)
        first, second, ids, doc = first[at], second[at], chunk.ids[chunk.doc[at]], chunk.doc[at]
        order = np.lexsort((doc, ids, second, first))
        first, second, ids, doc = first[order], second[order], ids[order], doc[order]
        begin = np.union1d(_runs(first), _runs(second))
        ends = np.concatenate([begin[1:], [len(first)]])
        many = (doc[begin] != doc[ends - 1]).astype(np.uint64)
        first, second, ids = first[begin], second[begin] << np.uint64(1) | many, ids[begin]
        return _blobs([
            {"chunk": int(key[0].as_py()), "bucket": bucket, "keys": pack_sorted(first[a:b]),
             "more": pack(second[a:b]) + pack(ids[a:b].view(np.uint64))}
            for bucket, a, b in _by_bucket(first, 64, buckets)
        ])

    return run


def _halves(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return unpack(data[: len(data) // 2]), unpack(data[len(data) // 2 :])


def _first_holders(key: tuple, table: pa.Table) -> pa.Table:
    """For each chunk its window sequences that several documents have, with the smallest id overall."""
    first, blob, chunks = _split(table, unpack_sorted)
    more = [_halves(x.as_py()) for x in table.column("more")]
    second = np.concatenate([x for x, _ in more])
    ids = np.concatenate([x for _, x in more]).view(np.int64)
    many, second = second & np.uint64(1), second >> np.uint64(1)
    order = np.lexsort((ids, second, first))
    first, second, ids, many, blob = (x[order] for x in (first, second, ids, many, blob))
    begin = np.union1d(_runs(first), _runs(second))
    counts = np.diff(np.concatenate([begin, [len(first)]]))
    keep = np.repeat((counts > 1) | (np.maximum.reduceat(many, begin) > 0), counts)
    least = np.repeat(ids[begin], counts)[keep]
    first, second, blob = first[keep], second[keep], blob[keep]
    order = np.lexsort((first, blob))
    first, second, least, blob = (x[order] for x in (first, second, least, blob))
    begin = _runs(blob)
    return _blobs([
        {"chunk": int(chunks[blob[a]]), "bucket": 0, "keys": pack_sorted(first[a:b]),
         "more": pack(second[a:b]) + pack(least[a:b].view(np.uint64))}
        for a, b in zip(begin, [*begin[1:], len(blob)])
    ])


def _cut(size: int, schema: pa.Schema, unchanged: bool):
    """The documents of a chunk without the repeats, and where these were."""

    def run(key: tuple, docs: pa.Table, shared: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        chunk = _read(docs, words=True)
        covered = np.zeros(len(chunk.hashes) + 1, np.int64)
        if shared.num_rows:
            keys = _gathered(shared)
            more = [_halves(x.as_py()) for x in shared.column("more")]
            check = np.concatenate([x for x, _ in more])
            least = np.concatenate([x for _, x in more]).view(np.int64)
            order = np.argsort(keys, kind="stable")
            keys, check, least = keys[order], check[order], least[order]
            first, second = _windows(chunk, size)
            place = found_in(first, keys)
            at = np.flatnonzero((place >= 0) & chunk.inside(size))
            place = place[at]
            # Of windows whose first hash agrees the second decides; both agree for copies only.
            taken = (check[place] == second[at]) & (least[place] < chunk.ids[chunk.doc[at]])
            np.add.at(covered, at[taken], 1)
            np.add.at(covered, at[taken] + size, -1)
        removed = np.cumsum(covered)[:-1] > 0
        texts, counts, spans = [], [], []
        whole = docs.column(docs.num_columns - 2)
        for i, (words, a, b) in enumerate(zip(chunk.words, chunk.starts[:-1], chunk.starts[1:])):
            gone = removed[a:b]
            counts.append(int(gone.sum()))
            if not counts[-1]:
                texts.append(whole[i].as_py() if unchanged else b" ".join(words))
                spans.append([])
                continue
            texts.append(b" ".join([w for w, x in zip(words, gone) if not x]))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            spans.append([{"begin": int(x), "len": int(y - x)} for x, y in zip(edge[::2], edge[1::2])])
        out = {
            "n_words": pa.array(chunk.sizes, pa.int64()), "n_removed": pa.array(counts, pa.int64()),
            "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
            "removed": pa.array(spans, schema.field("removed").type),
        }
        columns = [out[f.name] if f.name in out else docs.column(i) for i, f in enumerate(schema)]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    keep: tuple[str, ...] | None = None,
    chunk_bytes: int = CHUNK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    unchanged: bool = False,
) -> DataFrame:
    """Take out of every document the passages that a document with a smaller id has too.

    A passage is a maximal run of words covered by windows of ``window`` words whose sequence also
    starts in a document with a smaller id. Adds ``n_words``, ``n_removed``, ``kept_text`` (kept words
    joined by one space) and ``removed`` (spans of word places); of the other columns ``keep`` stay, or
    all. Words are split at white space and compared as they are. With ``unchanged`` a text without a
    repeat is given back as it is, white space and null included.

    Reference blocks of (window + 1) / 2 words that do not overlap are the anchors: any repeated window
    has one of them whole. Every rolling window of that size probes them; where an anchor is shared, the
    windows around it are compared in full. Both comparisons get one entry per chunk and sequence,
    however often the chunk repeats it, and answer the chunks that asked. A chunk sends one row to each
    bucket, so with more memory to a task both sizes should grow.

    Null and empty texts have no words. A null id counts as larger than all others; rows with equal ids
    do not remove from each other. An empty table gives an empty result.
    """
    if window < 3:
        raise ValueError("a window has three words at least")
    spark = docs.sparkSession
    new = ("n_words", "n_removed", "kept_text", "removed")
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c not in new)
    anchor = (window + 1) // 2
    size = text_bytes(docs, text)
    chunks = max(1, math.ceil(size / chunk_bytes))
    buckets = max(1, math.ceil(size / bucket_bytes))
    parts = max(chunks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    id_, body, place = free_names(docs, "id", "text", "chunk")
    rows = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.col(f"`{doc_id}`").cast("long").alias(id_),
        F.col(f"`{text}`").cast("binary").alias(body),
        F.pmod(F.xxhash64(f"`{doc_id}`", f"`{text}`"), F.lit(chunks)).cast("int").alias(place),
    ).repartition(parts, place)
    by_chunk = lambda: rows.groupBy(place)

    probes = by_chunk().applyInArrow(released_group(_anchors_of(buckets, anchor)), BLOBS)
    hits = probes.groupBy("bucket").applyInArrow(released_group(_shared_anchors), BLOBS)
    found = by_chunk().cogroup(hits.groupBy("chunk")).applyInArrow(released_group(_extended(buckets, anchor, window)), BLOBS)
    shared = found.groupBy("bucket").applyInArrow(released_group(_first_holders), BLOBS)
    spans = "n_words bigint, n_removed bigint, kept_text string, removed array<struct<begin:int,len:int>>"
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [f for f in rows.schema.fields if f.name in keep]
    schema = T.StructType(fields + T.StructType.fromDDL(spans).fields)
    arrow = to_arrow_schema(schema)
    return by_chunk().cogroup(shared.groupBy("chunk")).applyInArrow(released_group(_cut(window, arrow, unchanged)), schema)

"""Removal of passages that occur earlier: fixed-block anchors, extended to maximal exact repeats.

1. Index and probe. Every document is cut into blocks of ``block`` words (half a window); the blocks are the index. Every
   rolling run of ``block`` words is a probe. Both go, packed, to the bucket of their hash. Since a window of 2 * block
   words holds at least one whole block of whatever document it lies in, each repeat of a window makes a hit.
2. Extend. A hit is extended over the words around it to all windows that contain it. Their full hashes meet in buckets:
   of equal windows the first, by document and place, stays, and all others are repeats. Overlapping repeated windows
   join into maximal repeats, which are what is removed.

Whatever is shared by many documents costs a row of a packet for each occurrence; no pairs are formed. Of equal windows of a
chunk only the first goes to a bucket, the others are repeats for certain. Documents travel in chunks dealt by a hash of their
id, of which the text's exchange is used three times. Windows are equal if two independent 64-bit hashes of their words
are; a word's hash is no polynomial of its bytes (see ``Words.hashes``), so texts made to collide in those do not.

Ids are whole numbers (others raise a TypeError). Null text has no words. Documents whose id is null count as last. Rows that
share an id count as one after the other, in the order of their texts; equal rows likewise, so the later one loses what both
have. Texts shorter than a window stay. A very long text is held whole by the task of its chunk. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import Words, group_count, mix, others, shuffle_partitions, single, whole_numbers, window_hashes

PACKET = "bucket int, chunk long, payload binary"
WINDOWS = "bucket int, chunk long, known boolean, payload binary"
REST = "_rest"
#: Stored bytes of documents to a chunk, and to a bucket.
CHUNK, BUCKET = 1 << 21, 1 << 25


def in_order(table: pa.Table) -> pa.Table:
    """Rows by id and text, so that a chunk's words have the same numbers whenever it is read."""
    return table.take(pc.sort_indices(table, sort_keys=[("_id", "ascending"), ("_text", "ascending")], null_placement="at_end"))


def planes(column: np.ndarray) -> bytes:
    """The values' lowest bytes, then their second bytes, and so on: of ascending numbers most planes are runs, which the shuffle's compression takes away."""
    return np.ascontiguousarray(column).view(np.uint8).reshape(len(column), column.itemsize).T.tobytes()


def packed(buckets: np.ndarray, n_buckets: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The rows of equally long columns as one packet for each bucket that has any, rows in their order."""
    order = np.argsort(buckets, kind="stable")
    bounds = np.searchsorted(buckets[order], np.arange(n_buckets + 1))
    columns = tuple(c[order] for c in columns)
    for b in np.flatnonzero(np.diff(bounds)):
        part = slice(bounds[b], bounds[b + 1])
        yield int(b), np.int64(part.stop - part.start).tobytes() + b"".join(planes(c[part]) for c in columns)


def unpacked(payload: bytes, *types) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(payload, np.int64, 1)[0]), 8, []
    for t in types:
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(payload, np.uint8, n * size, at).reshape(size, n).T).view(t).reshape(n))
        at += n * size
    return out


def steps(places: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences, in two bytes if they fit in; told apart by the packet's length."""
    d = np.diff(places, prepend=0)
    return d.astype(np.uint16 if not len(d) or d.max() < 65536 else np.uint32)


def table_of(schema: str, *columns) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def numbered(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word: the first word of its document, and how many words of it are left, itself included."""
    counts = words.counts()
    first = np.repeat(words.offsets[:-1], counts)
    return first, np.repeat(words.offsets[1:], counts) - np.arange(len(words))


def probes(table: pa.Table, block: int, n_buckets: int) -> pa.Table:
    """Packets of (31 bits of a run's hash and whether it is a block of the index, place), a run at every word of a document that can hold a window."""
    table = in_order(table)
    words = Words(single(table["_text"]))
    hashes = window_hashes(words.hashes(), block)
    first, left = numbered(words)
    places = np.flatnonzero((left >= block) & (np.repeat(words.counts(), words.counts()) >= 2 * block))
    h = hashes[places]
    key = (h & np.uint64(0x7FFFFFFF)).astype(np.uint32) | (((places - first[places]) % block == 0).astype(np.uint32) << np.uint32(31))
    bucket = ((h >> np.uint64(31)) % np.uint64(n_buckets)).astype(np.int32)
    out = []
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    key, places = key[order], places[order]
    for b in np.flatnonzero(np.diff(bounds)):
        part = slice(bounds[b], bounds[b + 1])
        out.append((int(b), np.int64(part.stop - part.start).tobytes() + key[part].tobytes() + steps(places[part]).tobytes()))
    chunk = table["_chunk"][0].as_py()
    return table_of(PACKET, [b for b, _ in out], [chunk] * len(out), [p for _, p in out])


def hits(table: pa.Table) -> pa.Table:
    """Of one bucket: the places, by chunk, of runs that are in the index and occur elsewhere too."""
    keys, places, rows = [], [], []
    for i, payload in enumerate(table["payload"].to_pylist()):
        n = int(np.frombuffer(payload, np.int64, 1)[0])
        keys.append(np.frombuffer(payload, np.uint32, n, 8))
        d = np.frombuffer(payload, np.uint16 if len(payload) == 8 + 6 * n else np.uint32, n, 8 + 4 * n)
        places.append(np.cumsum(d, dtype=np.int64).astype(np.uint32))
        rows.append(np.full(n, i, np.int32))
    key, place, row = np.concatenate(keys), np.concatenate(places), np.concatenate(rows)
    h, indexed = key & np.uint32(0x7FFFFFFF), key >> np.uint32(31)
    order = np.argsort(h, kind="stable")
    starts = np.flatnonzero(np.diff(h[order], prepend=np.uint32(0xFFFFFFFF)))
    sizes = np.diff(np.append(starts, len(h)))
    good = (sizes > 1) & (np.maximum.reduceat(indexed[order], starts) > 0)
    found = order[np.repeat(good, sizes)]
    chunks = table["chunk"].to_numpy()
    out = list(packed(row[found], len(chunks), place[found]))
    return table_of("chunk long, payload binary", [int(chunks[i]) for i, _ in out], [p for _, p in out])


def marked(spans: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in one of the ranges."""
    edge = np.bincount(spans, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def extended(docs: pa.Table, found: pa.Table, block: int, n_buckets: int) -> pa.Table:
    """Packets of (two hashes, document, place) of the windows that contain a hit, the first of each in the chunk; and, as ``known``, packets of the places of all others."""
    if not docs.num_rows or not found.num_rows:
        return table_of(WINDOWS, [], [], [], [])
    docs = in_order(docs)
    words = Words(single(docs["_text"]))
    at = np.concatenate([unpacked(p, np.uint32)[0] for p in found["payload"].to_pylist()]).astype(np.int64)
    first, left = numbered(words)
    near = marked(np.maximum(at - block, first[at]), at + 1, len(words))
    places = np.flatnonzero(near & (left >= 2 * block))
    h, other = (window_hashes(words.hashes(seed), 2 * block)[places] if len(places) else np.zeros(0, np.uint64) for seed in (0, 1))
    order = np.lexsort((places, other, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (other[order[1:]] != other[order[:-1]])
    is_first = np.zeros(len(order), bool)
    is_first[order] = new
    chunk = docs["_chunk"][0].as_py()
    later = places[~is_first].astype(np.uint32)
    known = [(chunk % n_buckets, np.int64(len(later)).tobytes() + planes(later))] if len(later) else []
    h, other, places = h[is_first], other[is_first], places[is_first]
    ids = docs["_id"].fill_null(np.iinfo(np.int64).max).to_numpy().astype(np.int64)
    bucket = (mix(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(n_buckets)).astype(np.int32)
    out = list(packed(bucket, n_buckets, h, other, ids[words.text_of()[places]], places.astype(np.uint32)))
    return table_of(WINDOWS, [b for b, _ in out + known], [chunk] * (len(out) + len(known)), [False] * len(out) + [True] * len(known), [p for _, p in out + known])


def repeats(table: pa.Table) -> pa.Table:
    """Of one bucket: the places, by chunk, of windows that an earlier window equals."""
    sent, known = table["payload"].to_pylist(), table["known"].to_pylist()
    chunks = table["chunk"].to_pylist()
    done = [(c, p) for c, p, k in zip(chunks, sent, known, strict=True) if k]
    chunks = [c for c, k in zip(chunks, known, strict=True) if not k]
    parts = [unpacked(p, np.uint64, np.uint64, np.int64, np.uint32) for p, k in zip(sent, known, strict=True) if not k]
    if parts:
        h, other, doc, place = (np.concatenate([p[i] for p in parts]) for i in range(4))
        row = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.lexsort((place, doc, other, h))
        later = np.zeros(len(h), bool)
        later[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (other[order[1:]] == other[order[:-1]])
        done += [(chunks[i], p) for i, p in packed(row[later], len(chunks), place[later])]
    return table_of("chunk long, payload binary", [c for c, _ in done], [p for _, p in done])


def removed(docs: pa.Table, found: pa.Table, window: int) -> list[pa.Array]:
    """Of one chunk, in the order of its rows: kept text, numbers of words and of removed ones, removed spans."""
    words = Words(single(docs["_text"]))
    gone = np.zeros(len(words), bool)
    if found.num_rows:
        at = np.concatenate([unpacked(p, np.uint32)[0] for p in found["payload"].to_pylist()]).astype(np.int64)
        gone = marked(at, at + window, len(words))
    total = np.concatenate([[0], np.cumsum(gone)])[words.offsets]
    lost = np.diff(total)
    kept, spans = [], []
    for i, text in enumerate(docs["_text"].to_pylist()):
        mine = (text or "").encode().split()
        if lost[i]:
            g = gone[words.offsets[i] : words.offsets[i + 1]]
            edge = np.diff(np.concatenate([[0], g.view(np.int8), [0]]))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
            mine = compress(mine, ~g)
        else:
            spans.append([])
        kept.append(b" ".join(mine))
    return [
        pa.array(kept, pa.binary()).cast(pa.string()), pa.array(words.counts(), pa.int64()), pa.array(lost, pa.int64()),
        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]


def without_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept words in text_col (joined by one blank), n_words, n_removed and removed_spans (word numbers, end exclusive).

    These replace columns of the same names in whatever case; all other columns come along. ``window`` is even.
    """
    if window % 2 or window < 2:
        raise ValueError("window must be even")
    whole_numbers(docs, id_col)
    parts = shuffle_partitions(docs.sparkSession)
    block, n_buckets, n_chunks = window // 2, group_count(docs, parts, BUCKET), group_count(docs, 4 * parts, CHUNK)
    rest_of = others(docs, id_col, text_col, "n_words", "n_removed", "removed_spans")
    id_type = docs.schema[id_col].dataType.simpleString()
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest_of)]) if rest_of else F.lit(None).cast("int")
    source = docs.select(
        F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(n_chunks)).alias("_chunk"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"), rest.alias(REST)
    )
    chunks = source.groupBy("_chunk")
    hit = chunks.applyInArrow(lambda t: probes(t, block, n_buckets), PACKET).groupBy("bucket").applyInArrow(hits, "chunk long, payload binary")
    windows = chunks.cogroup(hit.groupBy("chunk")).applyInArrow(lambda d, f: extended(d, f, block, n_buckets), WINDOWS)
    repeat = windows.groupBy("bucket").applyInArrow(repeats, "chunk long, payload binary")
    rest_type = source.schema[REST].dataType.simpleString()
    schema = f"_id long, _text string, n_words long, n_removed long, removed_spans array<struct<start:bigint,end:bigint>>, {REST} {rest_type}"

    def final(d: pa.Table, f: pa.Table) -> pa.Table:
        d = in_order(d)
        text, n, lost, spans = removed(d, f, window)
        return pa.table({"_id": d["_id"], "_text": text, "n_words": n, "n_removed": lost, "removed_spans": spans, REST: d[REST]})

    out = chunks.cogroup(repeat.groupBy("chunk")).applyInArrow(final, schema)
    named = {id_col: F.col("_id").cast(id_type), text_col: F.col("_text"), **{c: F.col(REST)[f"c{i}"] for i, c in enumerate(rest_of)}}
    kept = [c for c in docs.columns if c in named]
    return out.select(*[named[c].alias(c) for c in kept], "n_words", "n_removed", "removed_spans")

"""Byte-level BPE with Spark's higher-order functions.

A text is cut into words by the vocabulary's pattern. Each distinct word of a document becomes an array of its bytes, held as a
string of a mark and one code point for each part (``FIRST`` plus its id), because slices of strings are cheap; a fold merges the
adjacent pair of lowest rank, leftmost first, until no pair has a rank. Ranks come from a constant map of pairs that is cut
into shards by hash, so that a look-up reads one short shard. Decoding concatenates the binary pieces of the ids.

Nothing is shuffled and nothing is written: every stage is a narrow map over the documents. The ``hot`` most frequent words of
a bounded sample are encoded first and go out as a broadcast of bounded size; it is a cache and decides nothing. All other
words are folded in their document, each distinct one once. A word of more than ``FOLDED`` bytes, for which a fold would
take time in the square of its length, is merged by a heap instead, with the same ranks and the same result.

Null text counts as empty; an empty text has no ids. Equal rows are encoded alike and each stays a row; columns of the input
other than the id do not matter. Null ids stay. An empty table gives an empty result. A very long text is held whole by one
task, with its words and ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from emberline.llm.common import lean, opened, others, shared, shuffle_partitions
from emberline.llm.quality import let

#: Sizes of the cache of frequent words: words, bytes of a word, documents of the sample (about); shards of the constant map.
HOT, LONGEST, SAMPLE, SHARDS = 500_000, 40, 40_000, 1 << 15
#: Words or ids that Python handles at a time (a longer single document is taken whole).
SLICE = 1 << 18
#: Words of more bytes than this are merged by a heap.
FOLDED = 128
#: The code point of the part with id 0 (from here on none is a surrogate), what stands before each part (no byte), and what is over all parts.
FIRST, MARK, NONE = 0xE000, "\u0100", "\U0010ffff"


def constant(spark: SparkSession, value: list[str]) -> Column:
    """Strings as a scalar subquery over one local row; the vocabulary bounds its size. No job runs for it.

    A literal would be spelled out in all descriptions of all plans that hold it, which the driver keeps.
    """
    return spark.createDataFrame(pa.table({"value": pa.array([value], pa.list_(pa.string()))})).scalar()


def pairs_of(ranks: dict[bytes, int]) -> dict[str, int]:
    """Each pair of parts, as marked code points, whose concatenation has a rank."""
    return {MARK + chr(FIRST + ranks[k[:i]]) + MARK + chr(FIRST + ranks[k[i:]]): v for k, v in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks}


def sharded(spark: SparkSession, pairs: dict[str, int]) -> tuple[Column, int]:
    """A constant array of strings of entries (pair, merged part); a pair stands in the string that its hash names."""
    n = 1 << max(4, min(SHARDS.bit_length() - 1, len(pairs).bit_length()))
    shards = [MARK + NONE] * n  # what is not found is read as the first two
    for k, v in pairs.items():  # Spark's xxhash64 has the seed 42 and is signed, which a power of two does not mind
        shards[xxhash.xxh64_intdigest(k.encode(), 42) % n] += k + MARK + chr(FIRST + v)
    return constant(spark, shards), n


class Ranks:
    """The vocabulary: a constant of pairs of parts and their merged part, and the table of pieces for whole words and decoding."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a rank: {missing}")
        self.spark, self.table, self.pattern = spark, ranks, "(?U)" + pattern
        self.map, self.n = sharded(spark, pairs_of(ranks))
        self.bytes = "".join(map(chr, range(256))), "".join(chr(FIRST + ranks[bytes([b])]) for b in range(256))
        #: Pieces that merging would not give: a word that is one of them has its id all the same.
        self.odd = {k: v for k, v in ranks.items() if merged_ids(k, ranks) != [v]}

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def ids(self, words: Column, known: str) -> Column:
        """For each of an array of words, of ``FOLDED`` bytes at most, its ids; ``known`` names the column of ``beside``."""
        return let(F.col(known), lambda known: F.transform(words, lambda w: self._ids(w, known)))

    def beside(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` and the map of pairs. If a single expression takes it in the next select, the optimiser puts it there and no row holds it."""
        return df.select("*", self.map.alias(name))

    def _ids(self, word: Column, known: Column) -> Column:
        """The ids of one word: a fold of merges over its bytes."""

        def merged(pair: Column) -> Column:
            shard = F.get(known, F.pmod(F.xxhash64(pair), F.lit(self.n)).cast("int"))
            return F.substr(F.call_function("substring_index", shard, pair, F.lit(-1)), F.lit(1), F.lit(2))

        def after(parts: Column, found: Column, least: Column) -> Column:
            """The state when the pair at the first place of ``least`` has been merged; only its neighbours' pairs are looked up."""

            def at(p: Column) -> Column:
                def whole(new: Column) -> Column:
                    left = F.when(p > 1, F.concat(F.substr(found, F.lit(1), p - 3), merged(F.substr(new, p - 2, F.lit(4))))).otherwise("")
                    right = F.when(F.length(new) > p + 1, merged(F.substr(new, p, F.lit(4)))).otherwise("")
                    return F.struct(new.alias("parts"), F.concat(left, right, F.substr(found, p + 4)).alias("found"))

                return let(F.concat(F.substr(parts, F.lit(1), p - 1), F.lit(MARK), least, F.substr(parts, p + 4)), whole)

            return let(F.instr(found, F.concat(F.lit(MARK), least)), at)

        def merge(state: Column, _: Column) -> Column:
            parts, found = state["parts"], state["found"]
            least = F.array_min(F.split(F.substr(found, F.lit(2)), MARK))
            done = F.struct(parts.alias("parts"), F.lit("").alias("found"))
            return F.when(F.length(found) < 2, state).otherwise(let(least, lambda x: F.when(x == NONE, done).otherwise(after(parts, found, x))))

        def fold(parts: Column) -> Column:
            pairs = F.transform(F.sequence(F.lit(1), F.length(parts) - 3, F.lit(2)), lambda i: merged(F.substr(parts, i, F.lit(4))))
            found = F.when(F.length(parts) > 2, F.array_join(pairs, "")).otherwise("")
            steps = F.sequence(F.lit(1), F.greatest(F.octet_length(word) - 1, F.lit(1)))
            return F.aggregate(steps, F.struct(parts.alias("parts"), found.alias("found")), merge, lambda s: s["parts"])

        start = F.translate(F.regexp_replace(F.decode(word.cast("binary"), "ISO-8859-1"), "(?s)(.)", MARK + "$1"), *self.bytes)
        each = let(let(start, fold), lambda parts: F.transform(F.sequence(F.lit(2), F.length(parts), F.lit(2)), lambda i: F.ascii(F.substr(parts, i, F.lit(1))) - FIRST))
        for k, v in self.odd.items():
            each = F.when(word.cast("binary") == F.lit(k), F.array(F.lit(v))).otherwise(each)
        return F.when(F.octet_length(word) == 0, F.array().cast("array<int>")).otherwise(each)

    def with_decoded(self, df: DataFrame, name: str = "decoded") -> DataFrame:
        """``df`` and the bytes of its ids: their binary pieces, concatenated. A narrow map; a column of that name is replaced."""
        kept = others(df, name)
        df = df.select(*[F.col(f"`{c}`") for c in kept])
        sent, at = shared(self.spark, pieces_of(self.table)), kept.index("ids")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = opened(sent)
            for batch in batches:
                for part in slices_of(batch, at):
                    ends, data = joined(part.column(at), pieces)
                    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, name])

        return df.mapInArrow(lean(run), StructType([*df.schema, StructField(name, BinaryType())]))


def pieces_of(ranks: dict[bytes, int]) -> pa.Array:
    """The pieces by id."""
    pieces = [b""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        pieces[v] = k
    return pa.array(pieces, pa.large_binary())


def numerals(n: int) -> pa.Array:
    """The decimal ids under n, a blank before each."""
    return pa.array([b" %d" % i for i in range(n)], pa.large_binary())


def joined(ids: pa.ListArray, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The parts that each row's ids name, one after another: the rows' offsets and all bytes.

    Arrow copies the parts whole; places of single bytes would take many times the bytes themselves.
    """
    at, numbers = flat(ids)
    _, ends, data = parts.take(numbers).buffers()
    return np.frombuffer(ends, np.int64, len(numbers) + 1)[at] if len(numbers) else np.zeros_like(at), np.frombuffer(data or b"", np.uint8)


def heap_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    return [ranks[word]] if word in ranks else merged_ids(word, ranks)


def merged_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: pairs wait in a heap by rank and place, so the time is n log n."""
    n = len(word)
    end, before, after, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    waiting: list[tuple[int, int, int, int]] = []

    def add(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            waiting.append((r, i, end[i], end[j])) if building else heapq.heappush(waiting, (r, i, end[i], end[j]))

    building = True
    for i in range(n):
        add(i)
    heapq.heapify(waiting)
    building = False
    while waiting:
        _, i, middle, last = heapq.heappop(waiting)
        if not alive[i] or end[i] != middle or after[i] >= n or end[after[i]] != last:
            continue  # a part of this pair has been merged since
        j = after[i]
        alive[j], end[i], after[i] = False, last, after[j]
        if after[i] < n:
            before[after[i]] = i
        add(i)
        if before[i] >= 0:
            add(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def frequent(docs: DataFrame, ranks: Ranks, hot: int) -> pa.Table:
    """(word, ids) of the words that most rows of a sample of about SAMPLE rows have."""
    total = docs.count()
    some = docs.filter(F.pmod(F.xxhash64("key", "digest"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, total)) * (1 << 30)))
    words = some.select(F.explode(F.array_distinct(ranks.words(F.col("text")))).alias("word")).groupBy("word").count().filter(F.octet_length("word") <= LONGEST)
    best = words.orderBy(F.desc("count"), "word").limit(hot).repartition(shuffle_partitions(docs.sparkSession))
    return ranks.beside(best, "pairs").select("word", F.get(ranks.ids(F.array("word"), "pairs"), F.lit(0)).alias("ids")).toArrow()


def ragged(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For these rows of a ragged array: places of all their values, one row after another, and the rows' lengths."""
    size = (offsets[1:] - offsets[:-1])[rows]
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[:-1][rows] - (ends - size), size), size


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0, and the values that they cut."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], lists.flatten()


def slices_of(batch: pa.RecordBatch, column: int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about ``limit`` values of a list column."""
    lists = batch.column(column)
    ends = lists.offsets.to_numpy()[1:].astype(np.int64) if batch.num_rows else ()
    at = 0
    while at < batch.num_rows:
        begin = ends[at - 1] if at else ends[0] - len(lists[0])
        to = max(at + 1, int(np.searchsorted(ends, begin + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def numbered(words: pa.Array, known: pa.Array) -> np.ndarray:
    """For each word its place in ``known``, whose words differ, or -1.

    The table of hashes is made of the distinct words here; one of all known words would be larger than everything else in a worker.
    """
    codes = words.dictionary_encode()
    found = pc.fill_null(pc.index_in(known, value_set=codes.dictionary), -1).to_numpy(zero_copy_only=False)
    there = np.flatnonzero(found >= 0)
    place = np.full(len(codes.dictionary), -1, np.int64)
    place[found[there]] = there
    return place[codes.indices.to_numpy(zero_copy_only=False)]


def cut(batch: pa.RecordBatch, known: pa.Array, offsets: np.ndarray, values: np.ndarray, long_ids) -> tuple[pa.Array, pa.Array]:
    """Of rows (key, words): segments (ids of known words, number of the other word that follows or null), and the other words, distinct by row.

    ``offsets`` and ``values`` hold the ids of the known words; ``long_ids`` gives those of a word that is too long for the fold.
    """
    at, words = flat(batch.column(1))
    number = numbered(words, known)
    unknown = np.flatnonzero(number < 0)
    missing = words.take(pa.array(unknown))
    long = np.flatnonzero(pc.binary_length(missing.cast(pa.binary())).to_numpy(zero_copy_only=False) > FOLDED)
    extra = [np.array(long_ids(missing[int(i)].as_py().encode()), np.int32) for i in long]
    number[unknown[long]] = len(offsets) - 1 + np.arange(len(long))
    all_offsets, all_values = np.concatenate([offsets, offsets[-1] + np.cumsum([len(x) for x in extra], dtype=np.int64)]), np.concatenate([values, *extra])
    # Ids of the known words, one after the other; ends[w] is how many there are up to and without word w.
    is_other = number < 0
    size = np.where(is_other, 0, np.diff(all_offsets)[np.where(is_other, 0, number)] if len(all_offsets) > 1 else 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    ids = all_values[ragged(all_offsets, number[~is_other])[0]]
    # A row's segments end at its other words and at its own end.
    unknown = np.flatnonzero(is_other)
    row_of = np.searchsorted(at, unknown, side="right") - 1
    n_others = np.bincount(row_of, minlength=batch.num_rows)
    stops = np.insert(unknown, np.cumsum(n_others), at[1:])
    closing = np.insert(np.zeros(len(unknown), bool), np.cumsum(n_others), True)
    # Other words of a row are numbered in the order of their first occurrence.
    codes = words.take(pa.array(unknown)).dictionary_encode()
    distinct = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64) + row_of * (len(codes.dictionary) + 1)
    unique, first, inverse = np.unique(distinct, return_index=True, return_inverse=True)
    own_counts = np.bincount(row_of[first], minlength=batch.num_rows)
    own_at = np.concatenate([[0], np.cumsum(own_counts)])
    follow = np.full(len(stops), -1, np.int64)
    follow[~closing] = inverse - own_at[row_of]
    before = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends[stops]]).astype(np.int32)), pa.array(ids.astype(np.int32)))
    segment = pa.StructArray.from_arrays([before, pa.array(follow.astype(np.int32), mask=closing)], ["before", "other"])
    segments = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_others + 1)]).astype(np.int32)), segment)
    own = codes.dictionary.take(pa.array(unique % (len(codes.dictionary) + 1)))
    return segments, pa.ListArray.from_arrays(pa.array(own_at.astype(np.int32)), own.cast(pa.string()))


def encoded(docs: DataFrame, ranks: Ranks, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id_col, ids) for every row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("key"), text.alias("text"), F.xxhash64(text, F.length(text)).alias("digest"))
    known = frequent(base, ranks, hot) if hot else pa.table({"word": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int32()))})
    offsets, values = flat(pa.concat_arrays(known["ids"].chunks)) if known.num_rows else (np.zeros(1, np.int64), pa.array([], pa.int32()))
    words = pa.concat_arrays(known["word"].chunks) if known.num_rows else pa.array([], pa.string())
    del known
    sent = spark.sparkContext.broadcast((words, offsets, values.to_numpy().astype(np.int32)))
    table = shared(spark, ranks.table)
    kind = docs.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, offsets, values = sent.value
        by_heap: list[dict] = []

        def long_ids(word: bytes) -> list[int]:
            if not by_heap:
                by_heap.append(opened(table))
            return heap_ids(word, by_heap[0])

        for batch in batches:
            for part in slices_of(batch, 1):
                segments, other = cut(part, words, offsets, values, long_ids)
                yield pa.RecordBatch.from_arrays([part.column(0), segments, other], ["key", "segments", "other"])

    rows = base.select("key", ranks.words(F.col("text")).alias("words")).mapInArrow(lean(split), f"key {kind}, segments array<struct<before:array<int>,other:int>>, other array<string>")
    whole = lambda own: F.flatten(F.transform("segments", lambda s: F.when(s["other"].isNull(), s["before"]).otherwise(F.concat(s["before"], F.get(own, s["other"])))))
    return ranks.beside(rows, "pairs").select(F.col("key").alias(id_col), let(ranks.ids(F.col("other"), "pairs"), whole).alias("ids"))

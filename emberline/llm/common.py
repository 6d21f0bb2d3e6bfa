"""What the training-data operators share: reading, checkpoints, and vectorised splitting and hashing of words."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

import emberline

# Functions reach the Python workers by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(emberline)

#: A word is a run of anything but ASCII white space, as ``bytes.split()`` sees it.
WORD = r"[^\x20\x09-\x0D]+"
#: Text of this many bytes is taken at a time by the vectorised code (a longer single text is taken whole).
SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
GOLDEN = 0x9E3779B97F4A7C15


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared(spark: SparkSession, value):
    """A broadcast of ``value``, which must be of bounded size; ``opened`` gives it back in a worker."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(broadcast):
    return cloudpickle.loads(broadcast.value)


def released() -> None:
    """Hand back to the system what Arrow and the C library hold free."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches; at its end the worker, which stays for later tasks and stages, gives back what it no longer uses."""

    def to_its_end(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            released()

    return to_its_end


def whole_numbers(docs: DataFrame, id_col: str) -> None:
    """Raise a TypeError unless the ids are whole numbers."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers, not {kind.simpleString()}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; one of our own only where that is unset and all runs on one machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        configured = context.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
        if not configured and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="emberline-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that what follows survives the loss of executors and has a short lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet, and read again; it is deleted when the driver ends."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.parquet(path)


def group_count(docs: DataFrame, least: int, size_each: int) -> int:
    """Groups to deal ``docs`` into, ``least`` or as many as have about ``size_each`` bytes of stored input; grows with the input."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, -(-size // size_each)) if size < 1 << 50 else least  # beyond that the size is not known


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN))
WORD_BASE = 0xC2B2AE3D27D4EB4F


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Words:
    """The words of a few texts: buf holds the UTF-8 bytes, word i is buf[starts[i]:ends[i]], text d has words offsets[d]:offsets[d+1]."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()) if texts.null_count == 0 else texts.fill_null("").cast(pa.large_binary())
        _, off, data = texts.buffers()
        off = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8) if off is not None and len(texts) else np.zeros(1, np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.buf = buf = whole[off[0] : off[-1]]
        self.bounds = bounds = off - off[0]
        inside = ~SPACE[buf]
        first = np.zeros(len(buf) + 1, bool)
        first[bounds] = True
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | first[1:-1]
        end[:-1] &= ~inside[1:] | first[1:-1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.offsets = np.searchsorted(self.starts, bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text_of(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word: eight bytes at a time are mixed with their place, and the sum with the length.

        Different seeds give independent hashes.
        """
        n = len(self.starts)
        size = self.ends - self.starts
        lanes = (size + 7) >> 3
        ends = np.cumsum(lanes)
        begin = ends - lanes
        padded = np.zeros((int(ends[-1]) if n else 0) * 8, np.uint8)
        inside = ~SPACE[self.buf]
        padded[np.arange(int(size.sum())) + np.repeat(begin * 8 - (np.cumsum(size) - size), size)] = self.buf[inside]
        key = mix(np.arange(1, (int(lanes.max()) if n else 0) + 1, dtype=np.uint64) * np.uint64(GOLDEN) + mix(np.array([seed + 1], np.uint64))[0])
        mixed = mix(padded.view("<u8") ^ key[np.arange(len(padded) >> 3) - np.repeat(begin, lanes)])
        return mix(np.add.reduceat(mixed, begin) + size.astype(np.uint64) * np.uint64(GOLDEN)) if n else np.zeros(0, np.uint64)

    def array(self) -> pa.Array:
        """All words as one binary array."""
        size = self.ends - self.starts
        off = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=off[1:])
        data = self.buf[~SPACE[self.buf]]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row (fewer than n words: none)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(WORD_BASE, len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(words) - n + 1])


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = SLICE_BYTES):
    """``batch`` in runs of rows whose texts come to about ``limit`` bytes."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def single(column) -> pa.Array:
    """A column as one array without chunks."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def others(df: DataFrame, *taken: str) -> list[str]:
    """The columns of ``df`` but for those of these names, which Spark does not tell apart by case."""
    low = {c.lower() for c in taken}
    return [c for c in df.columns if c.lower() not in low]


def with_columns(docs: DataFrame, added: dict) -> DataFrame:
    """``docs`` with the operator's columns; they replace columns of the same name in whatever case."""
    return docs.select(*[F.col(f"`{c}`") for c in others(docs, *added)], *[v.alias(k) for k, v in added.items()])


def free(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name

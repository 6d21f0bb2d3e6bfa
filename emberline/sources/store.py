"""Facts as DataFrames: one for each functor (name and arity), with columns cid, a0, a1, ..."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Functor = tuple[str, int]


def own_folder(master: str) -> str:
    """A temporary folder, where the driver is the only machine."""
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return tempfile.mkdtemp(prefix="emberline-facts-")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` in the shared folder of ``spark.checkpoint.dir`` (one of our own where that is unset and all runs on one machine)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", "") or own_folder(context.master))
    return df.checkpoint()


def stable(df: DataFrame) -> DataFrame:
    """``df`` with ids that are the same whenever it is read.

    Ids number the rows by partition, so a plan that deals rows anew (a shuffle, whose partitions may change from run to
    run) is written to the shared folder first; files, rows of the driver and what is written already are taken as they are.
    """
    plan = df._jdf.queryExecution().analyzed().toString()
    return checkpointed(df) if DEALT.search(plan) else df


#: Plans of which partitions or the order of rows may differ from run to run.
DEALT = re.compile(r"(Aggregate|Join|Sort|Repartition\w*|RepartitionByExpression|Distinct|Deduplicate\w*|Sample|Window|GlobalLimit|LocalLimit|MapIn\w+|FlatMap\w+|Intersect|Except|RebalancePartitions)\b")


def column_type(values: list) -> T.DataType:
    """One Spark type for the values of an argument; numbers are doubles."""
    kinds = {"number" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__ for v in values if v is not None}
    if len(kinds) > 1:
        raise TypeError(f"an argument holds {' and '.join(sorted(kinds))}; a column has one type")
    if kinds == {"list"}:
        return T.ArrayType(column_type([x for v in values if v for x in v]))
    return {"number": T.DoubleType(), "str": T.StringType(), "bool": T.BooleanType()}.get(next(iter(kinds), "str"), T.StringType())


def widened(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    raise TypeError(f"an argument is {a.simpleString()} and {b.simpleString()}; a column has one type")


def together(frames: list[DataFrame]) -> DataFrame:
    """The union of frames of one functor; numbers of different types become doubles."""
    out = frames[0]
    for df in frames[1:]:
        types = [widened(x.dataType, y.dataType) for x, y in zip(out.schema, df.schema, strict=True)]
        cast = lambda d: d.select(*[F.col(f.name).cast(t).alias(f.name) if f.dataType != t else F.col(f.name) for f, t in zip(d.schema, types, strict=True)])  # noqa: E731, B023
        out = cast(out).unionByName(cast(df))
    return out


#: Ids that a frame may take: rows are numbered within partitions of 2**33, so this leaves room for 2**17 partitions.
SPAN = 1 << 50


class FactStore:
    """The facts of an engine. Frames are replaced, never changed; ``on_add`` and ``on_remove`` hear of frames of (cid, a0, ...)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.frames, self.next_id, self.invalid = spark, {}, 1, False
        #: Facts that have not been through the rules, and the frames as the last fixpoint left them.
        self.fresh: dict[Functor, DataFrame] = {}
        self.settled: dict[Functor, DataFrame] = {}
        self.on_add: list[Callable[[Functor, DataFrame], None]] = []
        self.on_remove: list[Callable[[Functor, DataFrame], None]] = []

    def frame(self, functor: Functor) -> DataFrame | None:
        return self.frames.get(functor)

    def put(self, functor: Functor, df: DataFrame | None) -> None:
        if df is None:
            self.frames.pop(functor, None)
        else:
            self.frames[functor] = df

    def add_frame(self, name: str, df: DataFrame, key: str | None = None) -> Functor:
        """The columns of ``df`` become arguments. ``key`` names a column of unique whole numbers that orders the facts; without it they are numbered."""
        columns = [c for c in df.columns if c != key]
        df = df if key else stable(df)
        args = [F.col(f"`{c}`").alias(f"a{i}") for i, c in enumerate(columns)]
        if key:
            cid = F.col(f"`{key}`").cast("long") + F.lit(self.next_id)
            low, top = df.agg(F.min(f"`{key}`"), F.max(f"`{key}`")).first()
            if low is not None and low < 0:
                raise ValueError(f"{key} must not be negative")
            self.reserve((top or 0) + 1)
        else:
            cid = F.monotonically_increasing_id() + F.lit(self.reserve(SPAN))
        new = df.select(cid.alias("cid"), *args)
        functor = (name, len(columns))
        old = self.frames.get(functor)
        self.frames[functor] = new if old is None else together([old, new])
        self._note(functor, new)
        return functor

    def reserve(self, n: int) -> int:
        """The first of n ids that no fact has had."""
        first = self.next_id
        if first + n >= 1 << 63:
            raise OverflowError("no ids are left; write the facts and start a new store")
        self.next_id += n
        return first

    def taken(self, df: DataFrame) -> None:
        """Gives back the ids that the last frame to reserve a span did not need."""
        top = df.agg(F.max("cid").alias("m")).first()["m"]
        self.next_id = self.next_id - SPAN if top is None else top + 1

    def _note(self, functor: Functor, new: DataFrame) -> None:
        self.fresh[functor] = together([self.fresh[functor], new]) if functor in self.fresh else new
        for hook in self.on_add:
            hook(functor, new)

    def settle(self) -> None:
        self.fresh, self.settled = {}, dict(self.frames)

    def add_rows(self, name: str, rows: list[tuple]) -> Functor:
        n = len(rows[0]) if rows else 0
        types = [column_type([r[i] for r in rows]) for i in range(n)]
        schema = T.StructType([T.StructField("cid", T.LongType())] + [T.StructField(f"a{i}", t) for i, t in enumerate(types)])
        exact = lambda v, t: float(v) if isinstance(t, T.DoubleType) and v is not None else v
        first = self.reserve(len(rows))
        data = [(first + j, *[exact(v, t) for v, t in zip(r, types, strict=True)]) for j, r in enumerate(rows)]
        new = self.spark.createDataFrame(data, schema)
        old = self.frames.get((name, n))
        self.frames[name, n] = new if old is None else together([old, new])
        self._note((name, n), new)
        return name, n

    def lookup(self, name: str, arity: int) -> DataFrame:
        """All facts of a functor in the order of their ids."""
        df = self.frames.get((name, arity))
        if df is None:
            return self.spark.createDataFrame([], T.StructType([T.StructField("cid", T.LongType())] + [T.StructField(f"a{i}", T.StringType()) for i in range(arity)]))
        return df.orderBy("cid")

    def lookup_name(self, name: str) -> DataFrame:
        return self.snapshot().filter(F.col("name") == name)

    def lookup_by_arg(self, name: str, arity: int, i: int, value) -> DataFrame:
        return self.lookup(name, arity).filter(F.col(f"a{i}").eqNullSafe(F.lit(value)))

    def find(self, name: str, arity: int, condition: Column) -> DataFrame:
        return self.lookup(name, arity).filter(condition)

    def lookup_one(self, name: str, i: int):
        """The i-th argument of the first fact of that name, whatever its arity; an error if there is none."""
        rows = [r for (n, k), df in self.frames.items() if n == name and i < k for r in [df.agg(F.min("cid").alias("c"), F.min_by(f"a{i}", "cid").alias("v")).first()] if r["c"] is not None]
        if not rows:
            raise LookupError(f"no fact {name} with argument {i}")
        return min(rows, key=lambda r: r["c"])["v"]

    def get(self, cid: int):
        row = self.snapshot().filter(F.col("cid") == cid).first()
        return row

    def has(self, cid: int) -> bool:
        return self.get(cid) is not None

    def all_alive(self, ids: list[int]) -> bool:
        ids = sorted(set(ids))
        return not ids or self.snapshot().filter(F.col("cid").isin(ids)).count() == len(ids)

    def remove(self, cid: int) -> bool:
        for functor, df in self.frames.items():
            gone = df.filter(F.col("cid") == cid)
            if not gone.isEmpty():
                for hook in self.on_remove:
                    hook(functor, gone)
                self.frames[functor] = df.filter(F.col("cid") != cid)
                return True
        return False

    def snapshot(self) -> DataFrame:
        """(cid, name, arity, args): args as JSON strings, in the order of ids."""
        parts = [df.select("cid", F.lit(n).alias("name"), F.lit(k).alias("arity"), F.array(*[F.to_json(F.struct(F.col(f"a{i}").alias("v"))) for i in range(k)]).cast("array<string>").alias("args")) for (n, k), df in self.frames.items()]
        if not parts:
            return self.spark.createDataFrame([], "cid long, name string, arity int, args array<string>")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.orderBy("cid")

    def functors(self) -> DataFrame:
        """(name, arity, n) of functors that have facts."""
        return self.snapshot().groupBy("name", "arity").agg(F.count("*").alias("n"))

    def size(self) -> int:
        return sum(df.count() for df in self.frames.values())

    def to_json(self) -> list[str]:
        return [r for r in self.snapshot().toJSON().collect()]

    def write_parquet(self, path: str) -> None:
        for (n, k), df in self.frames.items():
            df.write.mode("overwrite").parquet(f"{path}/{n}__{k}")

    @classmethod
    def read_parquet(cls, spark: SparkSession, path: str, functors: list[Functor]) -> FactStore:
        out = cls(spark)
        for n, k in functors:
            out.frames[n, k] = spark.read.parquet(f"{path}/{n}__{k}")
        out.next_id = 1 + max([df.agg(F.max("cid").alias("m")).first()["m"] or 0 for df in out.frames.values()], default=0)
        return out

    def clear(self) -> None:
        self.frames, self.fresh, self.settled, self.next_id, self.invalid = {}, {}, {}, 1, False

    def invalidate(self) -> None:
        self.clear()
        self.invalid = True

    def __str__(self) -> str:
        return "\n".join(f"#{r['cid']} {r['name']}({', '.join(a[5:-1] if a != '{}' else 'null' for a in r['args'])})" for r in self.snapshot().collect())

"""Programs over streams: each micro-batch is asserted, and rules see all that came before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.engine import Engine
from emberline.plans import analyzer, ast
from emberline.plans.errors import ExecutionError


def asserted(engine: Engine, stream: DataFrame, name: str, checkpoint: str, sink: Callable[[Engine, int], None] | None = None, key: str | None = None, once: bool = True) -> StreamingQuery:
    """Asserts each micro-batch of ``stream`` as facts ``name`` and runs the rules; ``sink`` then sees the engine.

    once: take what is there and stop. Each batch's rows are written below ``checkpoint`` before they are asserted. After a restart,
    batches of earlier runs are asserted from there first, so that the engine knows all facts that the stream's checkpoint
    counts as done; ``sink`` does not see these again. A batch that is replayed (its number is known) is not asserted twice.
    """
    spark, seen = stream.sparkSession, set()
    facts = f"{checkpoint.rstrip('/')}/facts"

    def asserted_from(number: int) -> None:
        engine.assert_df(name, spark.read.parquet(f"{facts}/{number}"), key)
        seen.add(number)

    for number in written(spark, facts):
        asserted_from(number)

    def batch(df: DataFrame, number: int) -> None:
        if number in seen:
            return
        df.write.mode("overwrite").parquet(f"{facts}/{number}")
        asserted_from(number)
        if sink:
            sink(engine, number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def written(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the batches that were written to the end, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [f.getPath() for f in files.listStatus(path)]
    return sorted(int(p.getName()) for p in found if p.getName().isdigit() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def stateless(engine: Engine, stream: DataFrame, name: str) -> dict[tuple[str, int], DataFrame]:
    """The facts that propagations of one head derive from a stream, as streams: filters and projections only, so no state."""
    from emberline.functions.scalar import BUILTINS
    from emberline.plans.compiler import Matches, emitted, joined

    facts = stream.select(F.lit(0).cast("long").alias("cid"), *[F.col(c).alias(f"a{i}") for i, c in enumerate(stream.columns)])
    functions = {**BUILTINS, **{k: f.typed() for k, f in engine.functions.items()}}
    out: dict = {}
    for rule in analyzer.scheduled(engine.rules):
        if rule.kind != ast.PROPAGATION or len(rule.heads) != 1:
            raise ExecutionError(f"{rule.name} needs state; use asserted()", rule.span)
        if rule.heads[0].functor == (name, len(stream.columns)):
            m: Matches = joined(rule.heads, [facts], rule.guards, functions)
            for functor, df in emitted(rule, m, functions):
                out[functor] = out[functor].unionByName(df) if functor in out else df
    return out


def windowed_first(stream: DataFrame, time_col: str, keys: list[str], delay: str) -> DataFrame:
    """keep-first over a stream with state that a watermark bounds: the first row of each key within ``delay``."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)

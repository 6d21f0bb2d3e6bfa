"""Joins of intervals on a relation, by slices of time instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import intervals

#: Relations whose intervals share a point.
TOUCHING = {"m", "o", "fi", "di", "s", "is", "si", "d", "f", "oi", "mi"}
#: Rows of one interval that go together; what a task holds at once are the pairs of two such groups.
GROUP = 64
#: Parts of the rows of one interval, told by a hash of the other columns, so that a frequent interval is no single task. A multiple of GRID.
PARTS = 8
#: A slice is dealt to GRID x GRID tasks, and each group is copied to GRID of them.
GRID = 4


def interval_join(left: DataFrame, right: DataFrame, t: str, u: str, symbols: set[str], width: float, on: list[str] | None = None) -> DataFrame:
    """Rows of both sides whose intervals (struct columns ``t`` of left and ``u`` of right, numeric ends) are in one of the relations.

    Rows with equal intervals (and columns ``on``) form groups of bounded size. Groups that share a point share a slice of
    ``width``: both sides are dealt to their slices and meet there by equality; two groups count in the slice of the later
    start only. Rows are paired after their groups have been compared, so equal intervals cost no comparisons that fail.
    ``before`` and ``after`` relate almost all pairs; they need ``on`` and are joined by it alone. Choose a width of about
    the longest usual interval: a group is copied to each slice it touches.
    """
    on = on or []
    if not symbols <= TOUCHING:
        if not on:
            raise ValueError("before and after need columns to join on")
        condition = intervals.any_of(symbols, F.col(t), F.col(u))
        return left.join(right, on).filter(condition)
    slot = lambda c: F.floor(c.cast("double") / F.lit(float(width))).cast("long")
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    keys = [f"_on{i}" for i in range(len(on))]
    cell = [*keys, "_slice", "_row", "_column"]
    numbers = F.explode(F.array(*[F.lit(i).cast("long") for i in range(GRID)]))

    def carried(df: DataFrame, c: str) -> list[str]:
        return [x for x in df.columns if x not in (*on, c)]

    def dealt(df: DataFrame, c: str, name: str, own: str, other: str) -> DataFrame:
        """Groups (keys, ``name``: their interval, ``name``s: the other columns of their rows), once for each cell."""
        rest = carried(df, c)
        values = F.struct(*[F.col(f"`{x}`").alias(f"{name}{i}") for i, x in enumerate(rest)] or [F.lit(True).alias(f"{name}0")])
        sure = [F.col(f"`{x}`") for x in rest if "map<" not in (kind := df.schema[x].dataType.simpleString()) and "variant" not in kind]  # Spark has no hash of maps
        part = F.pmod(F.xxhash64(*sure), F.lit(PARTS)) if sure else F.lit(0)
        rows = df.filter(F.col(f"`{c}`").isNotNull()).select(*[F.col(f"`{x}`").alias(k) for x, k in zip(on, keys)], F.col(f"`{c}`").alias(name), values.alias("_values"), part.cast("long").alias("_part"))
        same = [*keys, name, "_part"]
        number = F.row_number().over(Window.partitionBy(*same).orderBy("_part")) - 1
        groups = rows.withColumn("_group", F.floor(number / GROUP)).groupBy(*same, "_group").agg(F.collect_list("_values").alias(f"{name}s"))
        start, end = F.col(name)["start"], F.col(name)["end"]
        # All groups of a part share their cells, so it does not matter which of its rows form a group.
        groups = groups.withColumn(own, F.pmod(F.pmod(F.xxhash64(start, end), F.lit(GRID)) + F.col("_part"), F.lit(GRID)))
        groups = groups.withColumn("_slice", F.explode(F.sequence(slot(start), slot(end)))).withColumn(other, numbers)
        return groups.select(*cell, name, f"{name}s").repartition(tasks, *cell)

    a, b = dealt(left, t, "_t", "_row", "_column"), dealt(right, u, "_u", "_column", "_row")
    first: Column = F.col("_slice") == slot(F.greatest(F.col("_t.start"), F.col("_u.start")))
    met = a.join(b, cell).filter(first & intervals.any_of(symbols, F.col("_t"), F.col("_u")))
    pairs = met.select(*keys, "_t", "_u", "_us", F.inline("_ts")).select("*", F.inline("_us"))

    def back(df: DataFrame, c: str, name: str) -> list[Column]:
        rest = carried(df, c)
        return [F.col(name if x == c else f"{name}{rest.index(x)}").alias(x) for x in df.columns if x not in on]

    return pairs.select(*[F.col(k).alias(x) for x, k in zip(on, keys)], *back(left, t, "_t"), *back(right, u, "_u"))

"""A training order that mixes sources to target weights, in DataFrame operations only.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, ... and share all words; a target stops at ``cap``
times its source's words and the excess goes to the others by weight. The level at which sources stop is found with
prefix sums over the sources in the order of words a weight, not by repeated passes.

Curriculum: a source's weight changes over training time t in [0, 1] as 1 + a (2t - 1). Its integral
D(t) = (1 - a) t + a t^2 is the share of the source's demand that is met by t. The passes over a source line its
documents up by cumulative words; the middle of a document in pass r lies at u = (r * source words + words before it +
half its own) / target. It is taken in that pass if u <= 1, and D(t) = u gives its training position, by which documents
are range-sorted.

The order of documents within a source is that of the MD5 of their id, so reruns agree. Sums run over 4,096 ranges of
that MD5 within each source before ranges are put together, so no task sees a whole source.

Null text has 0 words and is never taken; null sources form one source; null ids are ordered as the empty string.
Repeated rows are documents of their own; rows that tie in id and size go by a hash of their text. A very long text is a
document like others; with ``carry`` a column named position is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import WORD, checkpointed, others, shuffle_partitions

#: Slope of the weight schedule for weights 1, 2 and 3: the first fades, the last comes in.
SLOPES = (-0.5, 0.0, 0.5)


def targets(base: DataFrame, cap: int = 3, cycle: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, size). One row a source; sums are taken before the shuffle."""
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", (F.row_number().over(by_name) - 1) % cycle + 1).withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spread = ranked.select(
        "*", F.row_number().over(order).alias("place"),
        (F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("sharers"),
    ).withColumn("level", F.col("left") / F.col("sharers"))
    stops = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everything)
    return spread.select("source", "source_size", "weight", F.least(F.lit(float(cap)) * F.col("source_size"), stops["level"] * F.col("weight")).alias("target"))


def position(u: Column, slope: Column) -> Column:
    """The t at which (1 - a) t + a t^2 = u."""
    b = 1 - slope
    return F.when(slope == 0, u).otherwise((F.sqrt(b * b + 4 * slope * u) - b) / (2 * F.when(slope == 0, F.lit(1.0)).otherwise(slope)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = 3, slopes: tuple = SLOPES, carry: bool = False) -> DataFrame:
    """For each row of ``docs``: id_col, size, source_size, target, taken, and positions (an array, one for each pass that takes it).

    carry: return the rows of ``docs`` instead, each once for every pass that takes it, with its position.
    """
    size = F.regexp_count(F.coalesce(docs[text_col].cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    digest = [F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("digest")] if carry else []
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), size.alias("size"), *digest, *rest)
    key = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    small = checkpointed(rows.select("source", "size", key.alias("key"), "id"))
    goals = targets(small, cap)
    cut = F.substring("key", 1, 3)
    ranges = small.groupBy("source", cut.alias("range")).agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(F.col("source").alias("s"), "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    offsets = offsets.join(goals, offsets.s.eqNullSafe(goals.source)).drop("source")
    if carry:
        small = rows.withColumn("key", key)
    placed = small.withColumn("range_of", cut)
    placed = placed.join(offsets, placed.source.eqNullSafe(offsets.s) & (placed.range_of == offsets.range))
    inside = Window.partitionBy("source", "range_of").orderBy("key", "id", "size", *(["digest"] if carry else []))
    start = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("start", F.col("offset") + F.coalesce(start, F.lit(0)))
    slope = F.element_at(F.array(*[F.lit(float(a)) for a in slopes]), F.col("weight").cast("int"))
    middle = lambda r: r * F.col("source_size") + F.col("start") + F.col("size") / 2
    passes = F.filter(F.array(*[F.lit(r) for r in range(cap)]), lambda r: (F.col("size") > 0) & (middle(r) <= F.col("target")))
    placed = placed.withColumn("positions", F.transform(passes, lambda r: position(middle(r) / F.col("target"), slope)))
    n = shuffle_partitions(docs.sparkSession)
    if carry:
        copies = placed.select("row", F.posexplode("positions").alias("pass", "position"))
        return copies.repartitionByRange(n, "position").sortWithinPartitions("position", "pass").select(*[F.col(f"row.`{c}`") for c in others(docs, "position")], "position")
    out = placed.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.size("positions")).alias("taken"), "positions")
    first = F.get("positions", F.lit(0))
    return out.repartitionByRange(n, first.asc_nulls_last(), F.xxhash64(id_col)).sortWithinPartitions(first.asc_nulls_last(), id_col)

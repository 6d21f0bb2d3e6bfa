"""Removing rules, run to exhaustion, as aggregates and windows: the same survivors as firing by firing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.scalar import guard, strictly_equal
from emberline.plans import ast
from emberline.plans.compiler import Matches, joined, scan


def arguments(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "cid"]


def keep_first(df: DataFrame) -> DataFrame:
    """``e(X) \\ e(X) <=> true``: of equal facts the one of least id. One aggregate, partial before the shuffle. Facts with a NaN equal nothing and stay."""
    args = arguments(df)
    floats = [f.name for f in df.schema if f.name in args and f.dataType.typeName() in ("double", "float")]
    alone = [F.when(F.isnan(c), F.col("cid")).alias(f"_nan_{c}") for c in floats]
    return df.groupBy(*args, *alone).agg(F.min("cid").alias("cid")).select("cid", *args)


def extreme(df: DataFrame, least: bool) -> DataFrame:
    """``m(K, A) \\ m(K, B) <=> A <= B | true``: of each key the fact of the extreme value, of equal ones the first."""
    *keys, value = arguments(df)
    order = F.struct(F.col(value).alias("v"), F.col("cid").alias("c")) if least else F.struct(F.col(value).alias("v"), (-F.col("cid")).alias("c"))
    best = (F.min if least else F.max)(order).alias("m")
    out = df.groupBy(*keys).agg(best) if keys else df.groupBy().agg(best).filter("m is not null")
    return out.select((F.col("m.c") if least else -F.col("m.c")).alias("cid"), *keys, F.col("m.v").alias(value))


def fold(df: DataFrame, how: str) -> DataFrame:
    """``s(K, A), s(K, B) <=> s(K, A + B)``: one fact a key. A key's only fact keeps its id; others get that of the last fact folded."""
    *keys, value = arguments(df)
    total = {"sum": F.sum, "product": F.product, "min": F.min, "max": F.max}[how](F.col(value)).alias("v")
    out = df.groupBy(*keys).agg(total, F.max("cid").alias("cid"))
    return out.filter("cid is not null").select("cid", *keys, F.col("v").alias(value))


def ranked(m: Matches, i: int, keys: list[str]) -> DataFrame:
    """The matches of one head with n{i}, their place among those of equal keys by id.

    Places are counted within runs of ids first (a frame numbers its rows by partition), so that no task sorts all facts of
    a hot key, or all facts where there are no keys; the runs before a run add their sizes.
    """
    by = [m.names[k].column for k in keys]
    run = F.shiftrightunsigned(F.col(f"c{i}"), 33)
    named = [c.alias(f"_k{j}") for j, c in enumerate(by)]
    sizes = m.frame.groupBy(*named, run.alias("_run")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*[f"_k{j}" for j in range(len(by))]).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*[f"_k{j}" for j in range(len(by))], "_run", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = m.frame.withColumn("_r", run).withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_r").orderBy(f"c{i}")))
    condition = F.col("_r") == F.col("_run")
    for j, c in enumerate(by):
        condition = condition & c.eqNullSafe(F.col(f"_k{j}"))
    return placed.join(before, condition).select(*m.frame.columns, (F.col("_place") + F.col("_before")).alias(f"n{i}"))


def pair(rule: ast.Rule, a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, Matches]:
    """``a(K), b(K) <=> p(K)``: the n-th a of a key meets its n-th b. Returns what is left of a and b, and the pairs."""
    one, two = rule.heads
    left, right = scan(one, a, 0), scan(two, b, 1)
    keys = [n for n in left.names if n in right.names]
    x, y = ranked(left, 0, keys), ranked(right, 1, keys)
    condition = F.col("n0") == F.col("n1")
    for k in keys:
        condition = condition & left.names[k].column.eqNullSafe(right.names[k].column)
    met = x.join(y, condition)
    lone = lambda df, i: df.join(met.select(F.col(f"c{i}").alias("cid")), "cid", "left_anti")
    return lone(a, 0), lone(b, 1), Matches(met.drop("n0", "n1"), right.names | left.names)


def consume(rule: ast.Rule, kept: DataFrame, removed: DataFrame, functions: dict[str, Callable]) -> tuple[Matches, DataFrame]:
    """``k(X) \\ r(X) <=> body``: every r that a k matches goes, with the first such k. Returns the matches and what is left of r.

    Where no guard compares a variable of k alone with one of r alone, the first k of each key is all that can match, so
    k is reduced to it before the join, which then gives each r one row at most.
    """
    k, r = (scan(h, df, i) for i, (h, df) in enumerate(zip(rule.heads, (kept, removed), strict=True)))
    shared = [n for n in k.names if n in r.names]
    own = lambda g: set(ast.variables(g)) <= set(k.names)
    if all(own(g) or set(ast.variables(g)) <= set(r.names) for g in rule.guards):
        test = guard(tuple(g for g in rule.guards if own(g)), k.names, functions)
        able = k.frame if test is None else k.frame.filter(test)
        by, rest = [k.names[n].column for n in shared], [c for c in k.frame.columns if c != "c0"]
        first = F.min(F.struct("c0", *[F.struct(F.col(c).alias("v")).alias(c) for c in rest])).alias("m")
        least = able.groupBy(*[c.alias(f"_k{j}") for j, c in enumerate(by)]).agg(first).filter("m is not null").select(F.col("m.c0").alias("c0"), *[F.col(f"m.{c}.v").alias(c) for c in rest])
        condition = None
        for n in shared:
            same = strictly_equal(k.names[n], r.names[n])
            condition = same if condition is None else condition & same
        test = guard(tuple(g for g in rule.guards if not own(g)), r.names, functions)
        able = r.frame if test is None else r.frame.filter(test)
        found = able.crossJoin(F.broadcast(least)) if condition is None else able.join(least, condition)  # one row without a key
        return Matches(found, r.names | k.names), removed.join(found.select(F.col("c1").alias("cid")), "cid", "left_anti")
    m = joined(rule.heads, [kept, removed], rule.guards, functions)
    rest = [c for c in m.frame.columns if c not in ("c0", "c1")]
    first = F.min(F.struct("c0", *[F.struct(F.col(c).alias("v")).alias(c) for c in rest])).alias("m")
    frame = m.frame.groupBy("c1").agg(first).select(F.col("m.c0").alias("c0"), "c1", *[F.col(f"m.{c}.v").alias(c) for c in rest])
    return Matches(frame, m.names), removed.join(m.frame.select(F.col("c1").alias("cid")), "cid", "left_anti")


def update(df: DataFrame, old: dict[str, object], new: dict[str, object]) -> DataFrame:
    """All facts equal to ``old`` (argument to value) get the values of ``new`` (Columns over the arguments, or literals), in place."""
    condition = F.lit(True)
    for c, v in old.items():
        condition = condition & F.col(c).eqNullSafe(F.lit(v))
    return df.select(*[F.when(condition, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])

"""Rules as DataFrame plans: heads become scans and joins, guards a filter, bodies projections."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalar import Typed, compiled, guard, kind_of, literal, strictly_equal
from emberline.plans import ast
from emberline.plans.analyzer import ordered
from emberline.plans.errors import ExecutionError


@dataclass
class Matches:
    """The matches of some heads: columns c0, c1, ... hold the ids, ``names`` the Columns of the variables."""

    frame: DataFrame
    names: dict[str, Typed]

    @property
    def ids(self) -> list[str]:
        return [c for c in self.frame.columns if c[0] == "c" and c[1:].isdigit()]


def scan(head: ast.Atom, df: DataFrame, i: int) -> Matches:
    """Facts that fit one head: literals and repeated variables are filters, other columns are pruned."""
    condition, columns, names = None, {}, {}
    for k, arg in enumerate(head.args):
        cell = Typed(F.col(f"a{k}"), kind_of(df.schema[f"a{k}"].dataType))
        test = None
        if isinstance(arg, ast.Lit):
            test = strictly_equal(cell, literal(arg.value))
        elif arg.wild:
            continue
        elif arg.name in columns:
            test = strictly_equal(columns[arg.name], cell)
        else:
            columns[arg.name] = cell
        if test is not None:
            condition = test if condition is None else condition & test
    if condition is not None:
        df = df.filter(condition)
    frame = df.select(F.col("cid").alias(f"c{i}"), *[v.column.alias(f"h{i}_{n}") for n, v in columns.items()])
    for n, v in columns.items():
        names[n] = Typed(F.col(f"h{i}_{n}"), v.kind)
    return Matches(frame, names)


def joined(heads: tuple[ast.Atom, ...], frames: list[DataFrame], guards: tuple = (), functions: dict[str, Callable] | None = None, ascending: bool = False) -> Matches:
    """All matches of the heads over these frames that pass the guards; ``ascending``: only those whose ids ascend.

    Shared variables are null-safe equi-keys; a fact fills one head of a match. Guards go on top, from where the optimizer
    moves them into scans and joins; ``B === A + 1`` so becomes an equi-key.
    """
    out = scan(heads[0], frames[0], 0)
    for i in range(1, len(heads)):
        right = scan(heads[i], frames[i], i)
        condition = None
        for n in right.names.keys() & out.names.keys():
            test = strictly_equal(out.names[n], right.names[n])
            condition = test if condition is None else condition & test
        for j in range(i):
            if heads[j].functor == heads[i].functor:
                test = F.col(f"c{j}") < F.col(f"c{i}") if ascending else F.col(f"c{j}") != F.col(f"c{i}")
                condition = test if condition is None else condition & test
        frame = out.frame.crossJoin(right.frame) if condition is None else out.frame.join(right.frame, condition)
        out = Matches(frame, right.names | out.names)
    test = guard(guards, out.names, functions or {})
    return Matches(out.frame if test is None else out.frame.filter(test), out.names)


def renamed(x, names: dict[str, str]):
    """An expression with other names of variables, the sides of symmetric operators in a fixed order."""
    if isinstance(x, ast.Var):
        return ast.Var(names.get(x.name, x.name))
    if isinstance(x, ast.Call):
        return ast.Call(x.name, tuple(renamed(a, names) for a in x.args))
    if isinstance(x, ast.Array):
        return ast.Array(tuple(renamed(a, names) for a in x.items))
    if isinstance(x, ast.Unary):
        return ast.Unary(x.op, renamed(x.arg, names))
    if isinstance(x, ast.Binary):
        left, right = renamed(x.left, names), renamed(x.right, names)
        if x.op in ("===", "!==", "&&", "||", "+", "*") and repr(right) < repr(left):
            left, right = right, left
        return ast.Binary(x.op, left, right)
    return x


def one_way(rule: ast.Rule) -> bool:
    """Whether two heads over one functor can change places: then every set of facts matches both ways, and the ascending one is the first."""
    if len(rule.heads) != 2 or rule.heads[0].functor != rule.heads[1].functor or len({bool(rule.kept), bool(rule.removed)}) == 1:
        return False
    one, two = (h.args for h in rule.heads)
    swap: dict[str, str] = {}
    for x, y in zip(one, two, strict=True):
        if isinstance(x, ast.Lit) or isinstance(y, ast.Lit):
            if x != y:
                return False
        elif x.wild or y.wild:
            if x.wild != y.wild:
                return False
        elif swap.setdefault(x.name, y.name) != y.name or swap.setdefault(y.name, x.name) != x.name:
            return False
    plain = sorted(repr(renamed(g, {})) for g in rule.guards)
    return plain == sorted(repr(renamed(g, swap)) for g in rule.guards)


def once_per_set(rule: ast.Rule, m: Matches, rounds: bool = False) -> Matches:
    """Of the matches of one set of facts the least, if heads share a functor; one aggregate on the sorted ids.

    No aggregate is needed where at most one order of a set matches, or where ``joined`` was asked for ascending ids
    (not in ``rounds``, which join what is new at each head in turn).
    """
    heads = rule.heads
    functors = [h.functor for h in heads]
    if len(set(functors)) == len(functors) or ordered(rule) or (one_way(rule) and not rounds):
        return m
    ids, rest = m.ids, [c for c in m.frame.columns if c not in m.ids]
    first = F.min(F.struct(*ids, *[F.struct(F.col(c).alias("v")).alias(c) for c in rest])).alias("m")
    frame = m.frame.groupBy(F.array_sort(F.array(*ids)).alias("ids")).agg(first)
    return Matches(frame.select(*[F.col(f"m.{c}").alias(c) for c in ids], *[F.col(f"m.{c}.v").alias(c) for c in rest]), m.names)


def bound(rule: ast.Rule, names: dict[str, Typed], functions: dict[str, Callable]) -> dict[str, Typed]:
    """The variables a body sees: those of the heads, and those of its ``let`` items."""
    names = dict(names)
    for item in rule.body:
        if isinstance(item, ast.Let):
            names[item.name] = compiled(item.value, names, functions)
    return names


def facts(atom: ast.Atom, m: DataFrame, names: dict[str, Typed], functions: dict[str, Callable]) -> DataFrame:
    """The arguments that a body item emits for each match, as a0, a1, ..."""
    columns: list[Column] = []
    for i, a in enumerate(atom.args):
        value = compiled(a, names, functions)
        columns.append((value.column.cast("string") if value.kind == "null" else value.column).alias(f"a{i}"))
    return m.select(*columns) if columns else m.select(F.lit(0).alias("_")).drop("_")


def emitted(rule: ast.Rule, m: Matches, functions: dict[str, Callable]) -> list[tuple[tuple[str, int], DataFrame]]:
    names = bound(rule, m.names, functions)
    return [(x.functor, facts(x, m.frame, names, functions)) for x in rule.body if isinstance(x, ast.Atom)]


def effects(rule: ast.Rule, m: Matches, functions: dict[str, Callable]) -> list[DataFrame]:
    """The actions of a rule as a log (action, args as JSON)."""
    names = bound(rule, m.names, functions)
    out = []
    for x in rule.body:
        if isinstance(x, ast.Action):
            args = [F.to_json(F.struct(compiled(a, names, functions).column.alias("v"))) for a in x.args]
            out.append(m.frame.select(F.lit(x.name).alias("action"), F.array(*args).cast("array<string>").alias("args")))
        elif isinstance(x, ast.Update):
            raise ExecutionError("updates are evaluated one firing at a time", rule.span)
    return out

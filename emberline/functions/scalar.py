"""Expressions as Columns, with the rule language's typing: strict equality, numbers as IEEE doubles, truthiness.

``Typed`` pairs a Column with its kind (number, string, boolean, null, array), which is known when a rule is compiled.
A guard is total: what would raise in a called function makes it false. A kind that does not fit an infix operator is an
error of the program and is raised at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.plans import ast
from emberline.plans.errors import ExecutionError


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str

    def number(self) -> Column:
        return self.column.cast("double")


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    return {T.StringType: "string", T.BooleanType: "boolean", T.NullType: "null", T.ArrayType: "array"}.get(type(t), "other")


def literal(value) -> Typed:
    kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "array" if isinstance(value, (list, tuple)) else "string"
    return Typed(F.array(*[literal(v).column for v in value]) if kind == "array" else F.lit(float(value) if kind == "number" else value), kind)


def truthy(x: Typed) -> Column:
    """0, NaN, null, false and the empty string are false."""
    c = x.column
    out = {"number": lambda: (c != 0) & ~F.isnan(c.cast("double")), "string": lambda: F.length(c) > 0, "boolean": lambda: c, "null": lambda: F.lit(False)}.get(x.kind, c.isNotNull)()
    return F.coalesce(out, F.lit(False))


def strictly_equal(a: Typed, b: Typed) -> Column:
    """No coercion; null equals null, NaN equals nothing."""
    if "null" in (a.kind, b.kind):
        return (a.column if b.kind == "null" else b.column).isNull() if a.kind != b.kind else F.lit(True)
    if a.kind != b.kind:
        return a.column.isNull() & b.column.isNull()
    same = a.column.eqNullSafe(b.column)
    return same & ~F.coalesce(F.isnan(a.number()), F.lit(False)) if a.kind == "number" else same


def js_string(x: Typed) -> Column:
    if x.kind == "number":
        c = x.number()
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        special = F.when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity")
        return F.coalesce(special, F.when(whole, F.format_string("%.0f", c)).otherwise(c.cast("string")), F.lit("null"))
    if x.kind == "null":
        return F.lit("null")
    return F.coalesce(x.column.cast("string"), F.lit("null"))


def divide(a: Column, b: Column) -> Column:
    """IEEE division: by zero gives an infinity or NaN."""
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def contains(x: Typed, items: Typed) -> Column:
    """Membership by value; NaN is found, null too."""
    found = F.coalesce(F.array_contains(items.column, x.column), F.lit(False)) if x.kind != "null" else F.lit(False)
    has_null = F.exists(items.column, lambda v: v.isNull())
    return F.coalesce(F.when(x.column.isNull(), has_null).otherwise(found), F.lit(False))


def unicode_length(c: Column) -> Column:
    """UTF-16 units: characters outside the basic plane count twice."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def _numeric(f: Callable, kind: str = "number") -> Callable:
    def build(*args: Typed) -> Typed | None:
        if any(a.kind not in ("number",) for a in args):
            return None
        return Typed(f(*[a.number() for a in args]), kind)

    return build


def _is(kind: str) -> Callable:
    return lambda x: Typed(x.column.isNotNull() if x.kind == kind else F.lit(False), "boolean")


def _all_different(*args: Typed) -> Typed:
    items = args[0].column if len(args) == 1 and args[0].kind == "array" else F.array(*[a.column for a in args])
    if len(args) > 1 and len({a.kind for a in args}) > 1:
        items = F.array(*[F.struct(F.lit(a.kind).alias("k"), js_string(a).alias("v")) for a in args])
    return Typed(F.size(F.array_distinct(items)) == F.size(items), "boolean")


#: Functions by name: Typed arguments to Typed, or None where the kinds make the function raise.
BUILTINS: dict[str, Callable] = {
    "eq": lambda a, b: Typed(strictly_equal(a, b), "boolean"),
    "neq": lambda a, b: Typed(~strictly_equal(a, b), "boolean"),
    "lt": _numeric(lambda a, b: (a < b) & ~F.isnan(b), "boolean"),
    "lte": _numeric(lambda a, b: (a <= b) & ~F.isnan(b), "boolean"),
    "gt": _numeric(lambda a, b: (a > b) & ~F.isnan(a), "boolean"),
    "gte": _numeric(lambda a, b: (a >= b) & ~F.isnan(a), "boolean"),
    "add": _numeric(lambda a, b: a + b),
    "sub": _numeric(lambda a, b: a - b),
    "mul": _numeric(lambda a, b: a * b),
    "div": _numeric(lambda a, b: F.try_divide(a, b)),
    "mod": _numeric(lambda a, b: F.try_mod(a, b)),
    "min": _numeric(lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))),
    "max": _numeric(lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))),
    "abs": _numeric(lambda a: F.abs(a)),
    "not": lambda a: Typed(~truthy(a), "boolean"),
    "isNumber": _is("number"),
    "isString": _is("string"),
    "isBoolean": _is("boolean"),
    "isNull": lambda a: Typed(F.lit(True) if a.kind == "null" else a.column.isNull(), "boolean"),
    "stringLength": lambda a: Typed(unicode_length(a.column), "number") if a.kind == "string" else None,
    "stringConcat": lambda a, b: Typed(F.concat(js_string(a), js_string(b)), "string"),
    "allDifferent": _all_different,
    "in": lambda a, b: Typed(contains(a, b), "boolean") if b.kind == "array" else None,
}
ARITY = {**{n: 2 for n in ("eq", "neq", "lt", "lte", "gt", "gte", "add", "sub", "mul", "div", "mod", "min", "max", "stringConcat", "in", "lookupOne")}, **{n: 1 for n in ("abs", "not", "isNumber", "isString", "isBoolean", "isNull", "stringLength", "lookup")}}

def _ieee(f: Callable) -> Callable:
    """Spark puts NaN above all numbers; a comparison with NaN is false here."""
    return lambda a, b: f(a, b) & ~F.isnan(a) & ~F.isnan(b)


COMPARE = {"<": _ieee(lambda a, b: a < b), "<=": _ieee(lambda a, b: a <= b), ">": _ieee(lambda a, b: a > b), ">=": _ieee(lambda a, b: a >= b)}
ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide}


class Raises(Exception):
    """A called function raises for every row."""


def compiled(x, names: dict[str, Typed], functions: dict[str, Callable]) -> Typed:
    """An expression over the Columns of its variables. Raises ``Raises`` where a call cannot succeed."""
    if isinstance(x, ast.Lit):
        return literal(x.value)
    if isinstance(x, ast.Var):
        if x.name not in names:
            raise ExecutionError(f"Unbound variable {x.name}")
        return names[x.name]
    if isinstance(x, ast.Array):
        items = [compiled(i, names, functions) for i in x.items]
        return Typed(F.array(*[i.column for i in items]), "array")
    if isinstance(x, ast.Call):
        if x.name not in functions:
            raise ExecutionError(f"Unknown function {x.name}")
        if x.name == "lookupOne" and all(isinstance(a, ast.Lit) for a in x.args):
            out = functions[x.name](*[a.value for a in x.args])  # a value of the store as it is
        else:
            out = functions[x.name](*[compiled(a, names, functions) for a in x.args])
        if out is None:
            raise Raises(x.name)
        return out if isinstance(out, Typed) else Typed(out, "number")
    if isinstance(x, ast.Unary):
        a = compiled(x.arg, names, functions)
        return Typed(~truthy(a), "boolean") if x.op == "!" else Typed(-a.number(), "number")
    a, b = compiled(x.left, names, functions), compiled(x.right, names, functions)
    if x.op in ("&&", "||"):
        return Typed(truthy(a) & truthy(b) if x.op == "&&" else truthy(a) | truthy(b), "boolean")
    if x.op in ("===", "!=="):
        same = strictly_equal(a, b)
        return Typed(same if x.op == "===" else ~same, "boolean")
    if x.op == "in":
        if b.kind != "array":
            raise ExecutionError("The right side of 'in' must be an array")
        return Typed(contains(a, b), "boolean")
    if a.kind != "number" or b.kind != "number":
        raise ExecutionError(f"Operator {x.op} needs numbers, not {a.kind} and {b.kind}")
    if x.op in COMPARE:
        return Typed(COMPARE[x.op](a.number(), b.number()), "boolean")
    return Typed(ARITHMETIC[x.op](a.number(), b.number()), "number")


def guard(guards: tuple, names: dict[str, Typed], functions: dict[str, Callable]) -> Column | None:
    """All guards as one total condition, or None if there are none. A comparison with NaN is false, as in IEEE."""
    out = None
    for g in guards:
        try:
            c = truthy(compiled(g, names, functions))
        except Raises:
            c = F.lit(False)
        out = c if out is None else out & c
    return out

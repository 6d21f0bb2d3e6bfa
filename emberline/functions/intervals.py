"""Allen's interval algebra on Columns.

An interval is a struct (start, end) with start < end, of any orderable type; null stands for no interval. Every function
is a plain expression and stays inside generated code. With t = [b, e] and u = [b2, e2], thirteen relations are possible,
of which exactly one holds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The relations in the order in which they are looked for, and the named sets.
ORDER = ("<", "m", "o", "fi", "di", "s", "is", "si", "d", "f", "oi", "mi", ">")
RELATION_SETS = {"dur": {"s", "d", "f"}, "con": {"fi", "di", "si"}, "concur": {"o", "fi", "di", "s", "is", "si", "d", "f", "oi"}, "full": set(ORDER)}
INVERSE = {"<": ">", "m": "mi", "o": "oi", "fi": "f", "di": "d", "s": "si", "is": "is", "si": "s", "d": "di", "f": "fi", "oi": "o", "mi": "m", ">": "<"}


def create(start: Column, end: Column) -> Column:
    return F.when(start < end, F.struct(start.alias("start"), end.alias("end")))


def start(t: Column) -> Column:
    return t["start"]


def end(t: Column) -> Column:
    return t["end"]


def to_string(t: Column) -> Column:
    return F.concat(F.lit("["), t["start"].cast("string"), F.lit(", "), t["end"].cast("string"), F.lit("]"))


def _ends(t: Column, u: Column):
    return t["start"], t["end"], u["start"], u["end"]


#: Symbol to predicate over the four ends.
TESTS: dict[str, Callable] = {
    "<": lambda b, e, c, f: e < c,
    "m": lambda b, e, c, f: e == c,
    "o": lambda b, e, c, f: (b < c) & (e > c) & (e < f),
    "fi": lambda b, e, c, f: (b < c) & (e == f),
    "di": lambda b, e, c, f: (b < c) & (e > f),
    "s": lambda b, e, c, f: (b == c) & (e < f),
    "is": lambda b, e, c, f: (b == c) & (e == f),
    "si": lambda b, e, c, f: (b == c) & (e > f),
    "d": lambda b, e, c, f: (b > c) & (e < f),
    "f": lambda b, e, c, f: (b > c) & (e == f),
    "oi": lambda b, e, c, f: (b > c) & (b < f) & (e > f),
    "mi": lambda b, e, c, f: b == f,
    ">": lambda b, e, c, f: b > f,
}
NAMES = {
    "before": "<", "precedes": "<", "after": ">", "preceded_by": ">", "meets": "m", "met_by": "mi", "overlaps": "o", "overlapped_by": "oi", "starts": "s", "started_by": "si",
    "during": "d", "contains": "di", "finishes": "f", "ends": "f", "finished_by": "fi", "ended_by": "fi", "equals": "is",
}
GROUPS = {"abuts": ("m", "mi"), "encloses": ("di", "is", "si", "fi"), "enclosed_by": ("d", "is", "s", "f")}


def relates(symbol: str, t: Column, u: Column) -> Column:
    return TESTS[symbol](*_ends(t, u))


def any_of(symbols, t: Column, u: Column) -> Column:
    out = F.lit(False)
    for s in symbols:
        out = out | relates(s, t, u)
    return out


def predicate(name: str, t: Column, u: Column) -> Column:
    """A relation or group of relations by its long name."""
    return any_of(GROUPS.get(name) or (NAMES[name],), t, u)


def find_relation(t: Column, u: Column) -> Column:
    out = F
    for s in ORDER:
        out = out.when(relates(s, t, u), F.lit(s))
    return out.otherwise(F.lit(None))


def gap(t: Column, u: Column) -> Column:
    b, e, c, f = _ends(t, u)
    return F.when((e < c) | (b > f), F.struct(F.least(e, f).alias("start"), F.greatest(b, c).alias("end")))


def intersection(t: Column, u: Column) -> Column:
    b, e, c, f = _ends(t, u)
    return F.when((e > c) & (b < f), F.struct(F.greatest(b, c).alias("start"), F.least(e, f).alias("end")))


def span(t: Column, u: Column) -> Column:
    b, e, c, f = _ends(t, u)
    return F.when(t.isNotNull() & u.isNotNull(), F.struct(F.least(b, c).alias("start"), F.greatest(e, f).alias("end")))


def union(t: Column, u: Column) -> Column:
    b, e, c, f = _ends(t, u)
    return F.when((e >= c) & (b <= f), span(t, u))


def minus(t: Column, u: Column) -> Column:
    """The pieces of t outside u: none, one or two."""
    b, e, c, f = _ends(t, u)
    left = create(b, F.least(e, c))
    right = create(F.greatest(b, f), e)
    apart = (e <= c) | (b >= f)
    return F.when(t.isNotNull() & u.isNotNull(), F.when(apart, F.array(t)).otherwise(F.filter(F.array(left, right), lambda x: x.isNotNull())))


def after_point(t: Column, p: Column) -> Column:
    return t["start"] > p


def before_point(t: Column, p: Column) -> Column:
    return t["end"] < p


def contains_point(t: Column, p: Column) -> Column:
    return (t["start"] <= p) & (p <= t["end"])


def starts_at(t: Column, p: Column) -> Column:
    return t["start"] == p


def ends_at(t: Column, p: Column) -> Column:
    return t["end"] == p


def chop(t: Column, p: Column) -> Column:
    """Two intervals that meet at p, if p lies inside."""
    return F.when((t["start"] < p) & (p < t["end"]), F.array(create(t["start"], p), create(p, t["end"])))


def with_start(t: Column, p: Column) -> Column:
    return create(p, t["end"])


def with_end(t: Column, p: Column) -> Column:
    return create(t["start"], p)


def clamp(t: Column, p: Column) -> Column:
    return F.greatest(t["start"], F.least(t["end"], p))


@lru_cache
def transitivity() -> dict[tuple[str, str], frozenset[str]]:
    """(r1, r2) to the relations that t and v can be in when t r1 u and u r2 v, by looking at all triples of intervals over six points."""
    points = list(combinations(range(6), 2))
    of = lambda t, u: next(s for s in ORDER if TESTS[s](*t, *u))
    table: dict[tuple[str, str], set[str]] = {}
    known = {(t, u): of(t, u) for t in points for u in points}
    for t in points:
        for u in points:
            for v in points:
                table.setdefault((known[t, u], known[u, v]), set()).add(known[t, v])
    return {k: frozenset(v) for k, v in table.items()}


def compose(first, second) -> set[str]:
    """The union of the compositions of two sets of relations."""
    return set().union(*[transitivity()[a, b] for a in first for b in second]) if first and second else set()


def composed(first: Column, second: Column) -> Column:
    """``compose`` on arrays of symbols, sorted; the table is a literal of 169 entries."""
    table = F.create_map(*[x for (a, b), r in sorted(transitivity().items()) for x in (F.lit(f"{a}|{b}"), F.array(*[F.lit(s) for s in sorted(r)]))])
    every = F.flatten(F.transform(first, lambda a: F.flatten(F.transform(second, lambda b: F.element_at(table, F.concat(a, F.lit("|"), b))))))
    return F.array_sort(F.array_distinct(every))

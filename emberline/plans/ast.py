"""Programs as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field, replace  # noqa: F401
from typing import Any

from emberline.plans.errors import Span


@dataclass(frozen=True)
class Lit:
    value: Any  # float, str, bool or None


@dataclass(frozen=True)
class Var:
    name: str

    @property
    def wild(self) -> bool:
        return self.name == "_"


@dataclass(frozen=True)
class Array:
    items: tuple


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Unary:
    op: str
    arg: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Atom:
    """A pattern in a head, or a fact to emit in a body."""

    name: str
    args: tuple
    span: Span | None = field(default=None, compare=False)

    @property
    def functor(self) -> tuple[str, int]:
        return self.name, len(self.args)


@dataclass(frozen=True)
class Let:
    name: str
    value: Any


@dataclass(frozen=True)
class Action:
    name: str
    args: tuple


@dataclass(frozen=True)
class Update:
    old: Atom
    new: Atom


PROPAGATION, SIMPLIFICATION, SIMPAGATION = "propagation", "simplification", "simpagation"


@dataclass(frozen=True)
class Rule:
    kind: str
    kept: tuple[Atom, ...]
    removed: tuple[Atom, ...]
    guards: tuple = ()
    body: tuple = ()
    name: str | None = None
    priority: float = 0
    unify: bool = False
    span: Span | None = field(default=None, compare=False)

    @property
    def heads(self) -> tuple[Atom, ...]:
        return self.kept + self.removed

    @property
    def emits(self) -> set[tuple[str, int]]:
        return {x.functor for x in self.body if isinstance(x, Atom)} | {x.new.functor for x in self.body if isinstance(x, Update)}


@dataclass(frozen=True)
class Program:
    rules: tuple[Rule, ...] = ()
    constraints: tuple[tuple[str, int], ...] = ()
    functions: tuple[tuple[str, int], ...] = ()
    actions: tuple[tuple[str, int], ...] = ()
    imports: tuple[str, ...] = ()


def variables(x) -> list[str]:
    """Names of the variables in an expression, pattern or body item, in order; without ``_``."""
    if isinstance(x, Var):
        return [] if x.wild else [x.name]
    if isinstance(x, (Atom, Call, Action)):
        return [v for a in x.args for v in variables(a)]
    if isinstance(x, Array):
        return [v for a in x.items for v in variables(a)]
    if isinstance(x, Unary):
        return variables(x.arg)
    if isinstance(x, Binary):
        return variables(x.left) + variables(x.right)
    if isinstance(x, Update):
        return variables(x.old) + variables(x.new)
    if isinstance(x, Let):
        return variables(x.value)
    return []


def calls(x) -> list[Call]:
    """Function calls anywhere in an expression or body item."""
    if isinstance(x, Call):
        return [x, *(c for a in x.args for c in calls(a))]
    if isinstance(x, (Atom, Action)):
        return [c for a in x.args for c in calls(a)]
    if isinstance(x, Array):
        return [c for a in x.items for c in calls(a)]
    if isinstance(x, Unary):
        return calls(x.arg)
    if isinstance(x, Binary):
        return calls(x.left) + calls(x.right)
    if isinstance(x, Update):
        return calls(x.old) + calls(x.new)
    if isinstance(x, Let):
        return calls(x.value)
    return []

"""What host functions and actions get and give: a context, values that may have to be awaited, and a timeout for these."""

from __future__ import annotations

import asyncio
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from emberline.plans import ast
from emberline.plans.errors import ExecutionError


@dataclass(frozen=True)
class HostContext:
    """Where a host function or action is called from. ``matched`` lists (id, name, arguments) of the facts of the match."""

    engine: Any
    rule: ast.Rule | None = None
    matched: tuple = ()
    bindings: dict = field(default_factory=dict)

    @property
    def store(self):
        return self.engine.store

    @property
    def history(self):
        return self.engine.history_snapshot()


def settled(value: Any, name: str, timeout: float | None) -> Any:
    """``value``, or what it comes to if it is awaitable. The timeout, in seconds, is for awaitable values only."""
    if not inspect.isawaitable(value):
        return value

    async def waited():
        return await asyncio.wait_for(value, timeout)

    try:
        return asyncio.run(waited())
    except TimeoutError as e:
        raise TimeoutError(f"host function {name} took more than {timeout} s") from e


def numeric(value: Any) -> float:
    """``value`` if it is a number; else an error."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ExecutionError(f"a number is needed, not {value!r}")
    return value


def compare(left: Any, right: Any, test: Callable[[float, float], bool]) -> bool:
    return test(numeric(left), numeric(right))


def evaluate_binary(operator: str, left: Any, right: Any) -> Any:
    """An infix operator of the rule language on two values."""
    from emberline.plans.sequential import Machine

    if operator not in ("||", "&&", "===", "!==", "<", "<=", ">", ">=", "+", "-", "*", "/", "in"):
        raise ExecutionError(f"Unknown operator {operator}")
    return Machine([]).value(ast.Binary(operator, ast.Var("left"), ast.Var("right")), {"left": left, "right": right})


def create_functor(name: str, arity: int) -> str:
    return f"{name}/{arity}"


def create_constraint(cid: int, name: str, args: list | tuple) -> tuple[int, str, tuple]:
    """A fact as the store's readers show it: (id, name, arguments)."""
    return cid, name, tuple(args)

"""Errors with a place in the source."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    line: int
    column: int

    def __str__(self) -> str:
        return f"{self.line}:{self.column}"


class RuleError(Exception):
    """Anything that is wrong with a program; ``span`` says where, ``cause`` why."""

    def __init__(self, message: str, span: Span | None = None, source: str | None = None, cause: BaseException | None = None):
        super().__init__(f"{message} (at {span})" if span else message)
        self.message, self.span, self.source, self.cause = message, span, source, cause

    def pretty(self) -> str:
        """The message, the line and a caret under the place."""
        if not self.span or self.source is None:
            return str(self)
        lines = self.source.split("\n")
        line = lines[self.span.line - 1] if self.span.line <= len(lines) else ""
        width = max(1, min(self.span.end - self.span.start, len(line) - self.span.column + 1))
        return f"{self}\n{line}\n{' ' * (self.span.column - 1)}{'^' * width}"


class ParseError(RuleError):
    pass


class ExecutionError(RuleError):
    pass


class GuardError(ExecutionError):
    pass

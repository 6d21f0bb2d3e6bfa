"""The engine: rules and facts in, fixpoint, facts out."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.host import HostContext, settled
from emberline.functions.scalar import ARITY, BUILTINS, Typed
from emberline.operators.fixpoint import Evaluation
from emberline.plans import analyzer, ast, sequential
from emberline.plans.errors import ExecutionError, RuleError
from emberline.plans.history import History
from emberline.plans.parser import parse_program
from emberline.sources.store import FactStore


@dataclass(frozen=True)
class HostModule:
    """Functions and actions that a program imports by the module's name."""

    name: str
    functions: dict[str, HostFunction]
    actions: dict[str, Callable]


@dataclass(frozen=True)
class HostFunction:
    """A function of rules. ``column`` builds a Column from Columns; ``python`` works on values, one firing at a time or, where there is no ``column``, in an Arrow-batched UDF that returns ``returns`` (null where it raises).

    ``context``: ``python`` gets a ``HostContext`` before the values; it then needs the engine, so it works one firing at a time. What it
    returns may be awaitable, for which the engine's ``host_timeout`` holds.
    """

    column: Callable | None = None
    python: Callable | None = None
    returns: str = "double"
    arity: int | None = None
    context: bool = False

    def typed(self, timeout: float | None = None) -> Callable:
        kind = {"double": "number", "int": "number", "bigint": "number", "string": "string", "boolean": "boolean"}.get(self.returns, "other")
        if self.column:
            return lambda *args: Typed(self.column(*[a.column for a in args]), kind)
        if self.context:
            raise ExecutionError("a host function with a context is called one firing at a time only")
        function, returns = self.python, self.returns

        def safe(*values):
            try:
                return settled(function(*values), "", timeout)
            except Exception:
                return None

        batched = F.udf(safe, returns, useArrow=True)
        return lambda *args: Typed(batched(*[a.column for a in args]), kind)


@dataclass(frozen=True)
class Fired:
    """One firing, or with ``count`` the firings of a rule in one set-at-a-time step."""

    rule: str | None
    kind: str
    priority: float
    ids: tuple[int, ...] = ()
    bindings: dict | None = None
    count: int = 1
    at: float = 0.0


class Expectation:
    def __init__(self, engine: Engine, name: str, args: tuple | None):
        self.engine, self.name, self.args = engine, name, args

    def frame(self) -> DataFrame:
        store = self.engine.store
        if self.args is None:
            return store.lookup_name(self.name)
        df = store.lookup(self.name, len(self.args))
        for i, v in enumerate(self.args):
            df = df.filter(F.col(f"a{i}").eqNullSafe(F.lit(float(v) if isinstance(v, int) and not isinstance(v, bool) else v)))
        return df

    def exists(self) -> bool:
        return not self.frame().isEmpty()

    def missing(self) -> bool:
        return not self.exists()

    def count(self, n: int | None = None):
        found = self.frame().count()
        return found if n is None else found == n


class TypedEngine:
    """Asserts facts whose names and argument types were given; all else is the engine's."""

    def __init__(self, engine: Engine, types: dict[str, tuple]):
        self.engine, self.types = engine, types

    def __getattr__(self, name: str):
        return getattr(self.engine, name)

    def _check(self, name: str, args: tuple) -> None:
        types = self.types.get(name)
        if types is None:
            raise ExecutionError(analyzer.unknown("constraint", name, self.types))
        fits = len(types) == len(args) and all(v is None or isinstance(v, (int, float) if t is float else t) and (t is bool or not isinstance(v, bool)) for v, t in zip(args, types, strict=True))
        if not fits:
            raise ExecutionError(f"{name} takes ({', '.join(t.__name__ for t in types)}), not {tuple(args)!r}")

    def assert_fact(self, name: str, args: list | tuple = ()) -> None:
        self._check(name, tuple(args))
        self.engine.assert_fact(name, args)

    def assert_many(self, facts: list[tuple[str, tuple]]) -> int:
        for name, args in facts:
            self._check(name, tuple(args))
        return self.engine.assert_many(facts)


class Engine:
    """A program and its store.

    max_rule_firings: firings in one fixpoint before it counts as endless; None for none, which also keeps non-recursive
    programs lazy. distinct: facts as a set instead of a multiset, so recursion over cycles ends. sequential_limit: facts
    that a program whose result depends on the order of single firings may have; more are refused. host_timeout: seconds that an
    awaitable value of a host function may take; in a guard the call then fails, in a body the run.
    """

    def __init__(self, spark: SparkSession, max_rule_firings: int | None = 10_000, strict: bool = False, distinct: bool = False, sequential_limit: int = 100_000, trace: bool = False, builtins: dict[str, HostFunction] | None = None, host_timeout: float | None = None):
        self.spark, self.limit, self.strict, self.distinct, self.sequential_limit, self.trace_firings = spark, max_rule_firings, strict, distinct, sequential_limit, trace
        self.host_timeout = host_timeout
        self.store = FactStore(spark)
        self.rules: list[ast.Rule] = []
        self.known = analyzer.Declarations()
        self.functions: dict[str, HostFunction] = dict(builtins or {})
        self.actions: dict[str, tuple[Callable, int | None]] = {}
        self.table_actions: dict[str, Callable[[DataFrame], None]] = {}
        self._machine: sequential.Machine | None = None
        self.modules: dict[str, HostModule] = {}
        self.warnings: list[str] = []
        self.state = "empty"
        self.trace: list[Fired] = []
        self.listeners: list[Callable[[Fired], None]] = []
        self.history: DataFrame | None = None
        self.effects: list[DataFrame] = []
        self._machine_history = History()
        self._fed: dict = {}

    # rules

    def add_rules(self, source: str) -> None:
        try:
            self.add_program(parse_program(source))
        except RuleError as e:
            e.source = e.source or source
            raise

    def load(self, path: str) -> None:
        """Rules from a file that Spark can read."""
        self.add_rules("\n".join(r["value"] for r in self.spark.read.text(path, wholetext=True).collect()))

    def add_program(self, program: ast.Program) -> None:
        self._loadable()
        for what in ("constraints", "functions", "actions"):
            for name, arity in getattr(program, what):
                self.known.declare(what, name, arity)
        for name in program.imports:
            if name not in self.modules:
                raise ExecutionError(analyzer.unknown("host module", name, self.modules))
            self.functions |= self.modules[name].functions
            self.actions |= {k: (f, None) for k, f in self.modules[name].actions.items()}
        for rule in program.rules:
            self.add_rule(rule)
        self.warnings += analyzer.unused(program)
        self.state = "ready" if self.rules or self.state != "empty" else "empty"

    def add_rule(self, rule: ast.Rule) -> None:
        self._loadable()
        rule = rule if rule.name else replace(rule, name=f"rule_{len(self.rules) + 1}")
        self.warnings += analyzer.check_rule(rule, self.known, self._arities(), {k: a for k, (_, a) in self.actions.items()}, self.strict)
        self.rules.append(rule)
        self.warnings += [w for w in analyzer.shadowed(analyzer.scheduled(self.rules)) if w not in self.warnings]
        self.state = "ready"

    def validate(self, source: str) -> list[str]:
        """Problems of a program, without loading it."""
        probe = Engine(self.spark, strict=self.strict, builtins=dict(self.functions))
        probe.modules, probe.actions = dict(self.modules), dict(self.actions)
        for what in ("constraints", "functions", "actions"):
            getattr(probe.known, what).update(getattr(self.known, what))
        try:
            probe.add_rules(source)
        except RuleError as e:
            return [e.pretty()]
        return []

    def _loadable(self) -> None:
        if self.state == "running":
            raise ExecutionError("rules cannot be added while rules run")

    def _arities(self) -> dict:
        return {**{k: ARITY.get(k) for k in BUILTINS}, "lookup": 1, "lookupOne": 2, **{k: f.arity for k, f in self.functions.items()}}

    def get_rules(self) -> list[ast.Rule]:
        return analyzer.scheduled(self.rules)

    def get_rules_by_head(self, name: str, arity: int | None = None) -> list[ast.Rule]:
        return [r for r in self.get_rules() if any(h.name == name and arity in (None, len(h.args)) for h in r.heads)]

    def ensure_rules_loaded(self) -> None:
        if not self.rules:
            raise ExecutionError("no rules are loaded")

    def explain(self) -> str:
        """The strata in which the rules are evaluated, and their class."""
        return "\n".join(f"{i}. {s.kind}{f' ({s.idiom})' if s.idiom else ''}: {', '.join(r.name for r in s.rules)}{f' -- {s.why}' if s.why else ''}" for i, s in enumerate(analyzer.strata(self.rules), 1))

    # host

    def register_function(self, name: str, column: Callable | None = None, python: Callable | None = None, returns: str = "double", arity: int | None = None, context: bool = False) -> None:
        if arity is not None and self.known.functions.get(name, arity) != arity:
            raise ExecutionError(f"{name} is declared with arity {self.known.functions[name]}")
        self.functions[name] = HostFunction(column, python, returns, arity, context)

    def register_action(self, name: str, handler: Callable, arity: int | None = None, context: bool = False) -> None:
        """``context``: the handler gets a ``HostContext`` before the arguments (of a set-at-a-time stratum it knows the engine only)."""
        self.actions[name] = ((lambda *args: handler(self._context(), *args)) if context else handler, arity)

    def register_table_action(self, name: str, handler: Callable[[DataFrame], None]) -> None:
        """An action of set-at-a-time strata that gets all of a run's calls as one frame (args: array of JSON strings), where the rows are."""
        self.table_actions[name] = handler
        self.actions.setdefault(name, (lambda *args: None, None))

    def _context(self) -> HostContext:
        machine = self._machine
        return HostContext(self, machine.at[0], getattr(machine, "matched", ()), dict(machine.at[2])) if machine else HostContext(self)

    def with_constraints(self, **types: tuple) -> TypedEngine:
        """A view of the engine that takes facts of these names and types only, such as edge=(int, str)."""
        return TypedEngine(self, types)

    def register_host_module(self, module: HostModule) -> None:
        if module.name in self.modules:
            raise ExecutionError(f"host module {module.name} is registered already")
        self.modules[module.name] = module

    # facts

    def assert_fact(self, name: str, args: list | tuple = ()) -> None:
        self.assert_many([(name, tuple(args))])

    def assert_many(self, facts: list[tuple[str, tuple]]) -> int:
        """Adds all facts, then runs to the fixpoint once."""
        by_functor: dict = {}
        self._ready()
        for name, args in facts:
            self.known.check_fact(name, len(args))
            by_functor.setdefault((name, len(args)), []).append(tuple(args))
        for (name, _), rows in by_functor.items():
            self.store.add_rows(name, rows)
        self.run()
        return len(facts)

    def assert_df(self, name: str, df: DataFrame, key: str | None = None, run: bool = True) -> None:
        """All rows of ``df`` as facts; ``key`` is a column of unique whole numbers that orders them and is no argument."""
        self._ready()
        self.known.check_fact(name, len(df.columns) - bool(key))
        self.store.add_frame(name, df, key)
        if run:
            self.run()

    def _ready(self) -> None:
        if self.state == "error":
            raise ExecutionError("the engine is in the state error; clear it first")
        missing = [f for f in self.known.functions if f not in self.functions and f not in BUILTINS and f not in ("lookup", "lookupOne")] + [a for a in self.known.actions if a not in self.actions]
        if missing:
            raise ExecutionError(f"declared and not registered: {', '.join(missing)}")

    def run(self) -> None:
        """To the fixpoint. Frames that have been through the rules count as old in the next run."""
        if not self.rules:
            return
        self.state = "running"
        try:
            strata = analyzer.strata(self.rules)
            called = {c.name for r in self.rules for x in (*r.guards, *r.body) for c in ast.calls(x)}
            if any(s.kind == "D" for s in strata) or any(f.context and n in called for n, f in self.functions.items()):
                self._sequential()
            elif self._fed and len(strata) > 1:
                self._remembered()
                self._sequential()
            else:
                self._sets(strata, dict(self.store.fresh) if self._fed else None)
            self.store.settle()
            self._fed = {f: True for f in self.store.frames}
            self.state = "ready"
        except Exception:
            self.state = "error"
            raise

    def _remembered(self) -> None:
        """The history of earlier set-at-a-time runs, for the machine; it is kept with ``trace`` only."""
        if not self.trace_firings:
            raise ExecutionError(f"Facts are added to a store that has been through several strata; create the engine with trace=True, so that its history is known:\n{self.explain()}")
        for r in self.history_snapshot().collect():
            self._machine_history.add(r["rule"], r["ids"])

    def _sets(self, strata: list[analyzer.Stratum], fresh: dict | None = None) -> None:
        functions = {**BUILTINS, **{k: f.typed(self.host_timeout) for k, f in self.functions.items() if not f.context}}
        run = Evaluation(self.store, functions, self.limit, self.distinct, self.trace_firings)
        for s in strata:
            if fresh is None or s.kind in "CU":
                run.run(s)
            elif s.kind == "A":
                run.semi_naive(list(s.rules), fresh)
            else:
                run.fresh_pipeline(s, fresh)
        for name, kind, priority, n in run.counts:
            self._heard(Fired(name, kind, priority, count=n, at=time.time()))
        self.effects += run.effects
        for h in run.history:
            self.history = h if self.history is None else self.history.unionByName(h)
        for log in run.effects:
            self._act(log)

    def _act(self, log: DataFrame) -> None:
        """Actions that the set-at-a-time strata asked for: table actions get them as a frame, other handlers hear of each in the driver."""
        import json

        names = {r["action"] for r in log.select("action").distinct().collect()}
        for name in sorted(names & set(self.actions)):
            if name in self.table_actions:
                self.table_actions[name](log.filter(F.col("action") == name).select("args"))
                continue
            handler, _ = self.actions[name]
            for row in log.filter(F.col("action") == name).toLocalIterator():
                handler(*[json.loads(a).get("v") for a in row["args"]])

    def _heard(self, fired: Fired) -> None:
        self.trace.append(fired)
        for listener in self.listeners:
            try:
                listener(fired)
            except Exception:  # a listener's error is its own
                continue

    def _sequential(self) -> None:
        frames = {}
        for functor, df in self.store.frames.items():
            rows = df.orderBy("cid").limit(self.sequential_limit + 1).collect()
            frames[functor] = rows
            if sum(map(len, frames.values())) > self.sequential_limit:
                raise ExecutionError(f"This program depends on the order of single firings, which is evaluated for at most {self.sequential_limit} facts:\n{self.explain()}")
        called = lambda f: (lambda *args: f.python(self._context(), *args)) if f.context else f.python
        python = {k: called(f) for k, f in self.functions.items() if f.python}
        machine = sequential.Machine(analyzer.scheduled(self.rules), python, {k: f for k, (f, _) in self.actions.items()}, self.limit, lambda r, ids, env: self._heard(Fired(r.name, r.kind, r.priority, ids, env, at=time.time())), self.host_timeout)
        machine.history = self._machine_history
        self._machine = machine
        for (name, _), rows in frames.items():
            for r in rows:
                machine.add(name, tuple(r)[1:], r["cid"])
        machine.next_id = max([self.store.next_id, *(c + 1 for c in machine.facts)])
        error = None
        try:
            machine.run()
        except RuleError as e:
            error = e
        self._machine = None
        old, self._machine_history = self.store.frames, machine.history
        self.store.frames = {}
        for functor, facts in machine.by_functor.items():
            if facts:
                self._replace(functor, facts, old.get(functor))
        self.store.next_id = machine.next_id
        self.history = self.spark.createDataFrame(machine.history.rows(), "rule string, ids array<long>")
        if error:
            raise error

    def _replace(self, functor, facts: dict[int, tuple], old: DataFrame | None) -> None:
        from pyspark.sql import types as T

        from emberline.sources.store import column_type

        n = functor[1]
        types = [column_type([a[i] for a in facts.values()]) if facts else T.StringType() for i in range(n)]
        schema = T.StructType([T.StructField("cid", T.LongType())] + [T.StructField(f"a{i}", t) for i, t in enumerate(types)])
        exact = lambda v, t: float(v) if isinstance(t, T.DoubleType) and v is not None else v
        self.store.frames[functor] = self.spark.createDataFrame([(c, *[exact(v, t) for v, t in zip(a, types, strict=True)]) for c, a in sorted(facts.items())], schema)

    # results

    def facts(self, name: str, arity: int) -> DataFrame:
        """The facts of a functor: cid, a0, a1, ... (not sorted)."""
        df = self.store.frame((name, arity))
        return self.store.lookup(name, arity) if df is None else df

    def expect(self, name: str, args: tuple | None = None) -> Expectation:
        return Expectation(self, name, None if args is None else tuple(args))

    def snapshot(self) -> dict[str, Any]:
        return {"rules": [r.name for r in self.get_rules()], "constraints": self.store.snapshot(), "history": self.history}

    def history_snapshot(self) -> DataFrame:
        return self.history if self.history is not None else self.spark.createDataFrame([], "rule string, ids array<long>")

    def get_warnings(self) -> list[str]:
        return list(self.warnings)

    def get_state(self) -> str:
        return self.state

    def add_rule_fired_listener(self, listener: Callable[[Fired], None]) -> Callable[[], None]:
        self.listeners.append(listener)
        return lambda: self.listeners.remove(listener)

    def print_store(self) -> None:
        print(self.store)

    def print_rules(self) -> None:
        for r in self.get_rules():
            print(f"@{r.priority:g}@ {r.name}: {r.kind}")

    def print_history(self) -> None:
        for r in self.history_snapshot().orderBy("rule", "ids").collect():
            print(r["rule"], r["ids"])

    def clear(self) -> None:
        """Forgets facts, history, trace and warnings; the rules stay and the engine is ready again."""
        self.store.clear()
        self.history, self.trace, self.effects, self.warnings = None, [], [], []
        self._machine_history, self._fed = History(), {}
        self.state = "ready" if self.rules else "empty"


def create_engine(spark: SparkSession, source: str = "", modules: tuple[HostModule, ...] = (), **options) -> Engine:
    engine = Engine(spark, **options)
    for m in modules:
        engine.register_host_module(m)
    if source:
        engine.add_rules(source)
    return engine


def define_host_module(name: str, functions: dict[str, HostFunction] | None = None, actions: dict[str, Callable] | None = None) -> HostModule:
    return HostModule(name, functions or {}, actions or {})

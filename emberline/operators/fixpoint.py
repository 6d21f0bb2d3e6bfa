"""Strata of rules, evaluated over whole frames.

A: propagations; semi-naive rounds if they are recursive, else one lazy pass in the order of dependence.
B: rules of one head; each fact meets the rules once, in the order of the schedule.
C: removing rules that amount to an aggregate (see ``idioms``).
U: a rule that replaces each fact of its head by another.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalar import Raises, guard, literal
from emberline.operators import idioms
from emberline.plans import ast
from emberline.plans.analyzer import Stratum
from emberline.plans.compiler import Matches, effects, emitted, facts, joined, once_per_set, one_way, scan
from emberline.plans.errors import ExecutionError
from emberline.plans.sequential import LIMIT
from emberline.sources.store import SPAN, FactStore, checkpointed, together


class Evaluation:
    """One run over a store. ``limit`` bounds firings (None: unbounded, and non-recursive strata stay lazy)."""

    def __init__(self, store: FactStore, functions: dict[str, Callable], limit: int | None = None, distinct: bool = False, trace: bool = False):
        self.store, self.limit, self.distinct, self.trace = store, limit, distinct, trace
        self.functions = {"lookupOne": self.first_value} | functions
        self.firings, self.effects, self.history, self.counts = 0, [], [], []
        self.lazy: set = set()

    def first_value(self, name: str, i: float):
        """One argument of the first fact of a name: one aggregate, whose one value becomes a literal."""
        try:
            return literal(self.store.lookup_one(name, int(i)))
        except LookupError as e:
            raise Raises(str(e)) from e

    def count(self, rule: ast.Rule, matches: DataFrame) -> DataFrame:
        """Counts the firings where a limit or a trace asks for it."""
        if self.limit is None and not self.trace:
            return matches
        matches = checkpointed(matches)
        n = matches.count()
        self.firings += n
        self.counts.append((rule.name, rule.kind, rule.priority, n))
        if self.limit is not None and self.firings > self.limit:
            raise ExecutionError(LIMIT, rule.span)
        return matches

    def numbered(self, df: DataFrame) -> DataFrame:
        """New facts get ids above all that exist. Where ids are compared, the facts are written first (see ``compared``)."""
        base = self.store.reserve(SPAN)
        return df.select((F.monotonically_increasing_id() + F.lit(base)).alias("cid"), *df.columns)

    def compared(self, rule: ast.Rule) -> None:
        """Before the ids of a rule's heads are compared, facts that were derived lazily are written, so that their ids stay."""
        functors = [h.functor for h in rule.heads]
        for f in set(functors):
            if self.store.frame(f) is not None and f in self.lazy and (len(set(functors)) < len(functors) or rule.removed):
                self.store.put(f, checkpointed(self.store.frame(f)))
                self.lazy.discard(f)

    def matched(self, rule: ast.Rule) -> Matches:
        self.compared(rule)
        frames = [self.store.frame(h.functor) for h in rule.heads]
        m = once_per_set(rule, joined(rule.heads, frames, rule.guards, self.functions, one_way(rule)))
        m = Matches(self.count(rule, m.frame), m.names)
        self.effects += effects(rule, m, self.functions)
        if self.trace:
            self.history.append(m.frame.select(F.lit(rule.name).alias("rule"), F.array_sort(F.array(*m.ids)).alias("ids")))
        return m

    def run(self, stratum: Stratum) -> None:
        {"A": self.propagate, "B": self.pipeline, "C": self.aggregate, "U": self.replace}[stratum.kind](stratum)

    # A

    def propagate(self, stratum: Stratum) -> None:
        rules = [r for r in stratum.rules]
        if self.distinct or not self.in_order(rules):
            return self.semi_naive(rules)
        for rule in self.in_order(rules):
            if any(self.store.frame(h.functor) is None for h in rule.heads):
                continue
            for functor, new in emitted(rule, self.matched(rule), self.functions):
                self.append(functor, self.numbered(new))

    @staticmethod
    def in_order(rules: list[ast.Rule]) -> list[ast.Rule]:
        """Rules after all that emit what they read; empty if they are recursive."""
        out, left = [], list(rules)
        while left:
            ready = [r for r in left if not any(h.functor in o.emits for h in r.heads for o in left)]
            if not ready:
                return []
            out += ready
            left = [r for r in left if r not in ready]
        return out

    def append(self, functor, new: DataFrame) -> None:
        derived_twice = self.store.frame(functor)
        self.store.put(functor, new if derived_twice is None else together([derived_twice, new]))
        self.lazy.add(functor)
        for hook in self.store.on_add:
            hook(functor, new)

    def semi_naive(self, rules: list[ast.Rule], fresh: dict | None = None) -> None:
        """Rounds over what is new (``fresh`` where the rest of the store has been through the rules): a match is found in
        the round of its last fact, at the first head that holds a new one.

        With ``distinct`` a fact that exists already is not added again, so cyclic data come to an end.
        """
        everything, new = dict(self.store.frames), dict(self.store.frames)
        before: dict = {}
        if fresh is not None:
            before, new = dict(self.store.settled), dict(fresh)
        if self.distinct:
            for f in {x for r in rules for x in r.emits} & set(new):
                if f not in before:
                    everything[f] = new[f] = checkpointed(idioms.keep_first(everything[f]))
        while new:
            found = defaultdict(list)
            for rule in rules:
                for i, head in enumerate(rule.heads):
                    frames = [before.get(h.functor) if j < i else new.get(h.functor) if j == i else everything.get(h.functor) for j, h in enumerate(rule.heads)]
                    if any(f is None for f in frames):
                        continue
                    m = joined(rule.heads, frames, rule.guards, self.functions)
                    found[rule].append(m)
            emitted_now = defaultdict(list)
            for rule, ms in found.items():
                frame = ms[0].frame
                for m in ms[1:]:
                    frame = frame.unionByName(m.frame)
                m = once_per_set(rule, Matches(frame, ms[0].names), rounds=True)
                m = Matches(self.count(rule, m.frame), m.names)
                self.effects += effects(rule, m, self.functions)
                if self.trace:
                    self.history.append(m.frame.select(F.lit(rule.name).alias("rule"), F.array_sort(F.array(*m.ids)).alias("ids")))
                for functor, facts in emitted(rule, m, self.functions):
                    emitted_now[functor].append(facts)
            before, new = dict(everything), {}
            for functor, parts in emitted_now.items():
                facts = together(parts)
                if self.distinct:
                    facts = facts.distinct()
                    if functor in everything:
                        known = everything[functor].drop("cid").withColumnsRenamed({c: f"k_{c}" for c in facts.columns})
                        condition = None
                        for c in facts.columns:
                            test = F.col(c).eqNullSafe(F.col(f"k_{c}"))
                            condition = test if condition is None else condition & test
                        facts = facts.join(known, condition if condition is not None else F.lit(True), "left_anti")
                facts = checkpointed(self.numbered(facts))
                self.store.taken(facts)
                if not facts.isEmpty():
                    new[functor] = facts
                    everything[functor] = together([everything[functor], facts]) if functor in everything else facts
                    for hook in self.store.on_add:
                        hook(functor, facts)
        self.store.frames = everything

    # B

    def fresh_pipeline(self, stratum: Stratum, fresh: dict) -> None:
        """Fresh facts only meet the rules; what stayed before stays."""
        heads = {r.heads[0].functor for r in stratum.rules}
        stayed = {f: df for f, df in self.store.settled.items() if f in heads}
        for f in heads:
            self.store.put(f, fresh.get(f))
        self.pipeline(stratum)
        for f, df in stayed.items():
            now = self.store.frame(f)
            self.store.put(f, df if now is None else together([df, now]))

    def pipeline(self, stratum: Stratum) -> None:
        by_functor = defaultdict(list)
        for r in stratum.rules:
            by_functor[r.heads[0].functor].append(r)
        todo = {f: df for f, df in self.store.frames.items() if f in by_functor}
        cyclic = not self.in_order([r for r in stratum.rules])
        order = [f for f in self.functor_order(stratum.rules)] if not cyclic else list(by_functor)
        while todo:
            coming = defaultdict(list)
            done = {} if cyclic else None
            for functor in order:
                fresh = todo.pop(functor, None) if cyclic else self.store.frame(functor)
                if fresh is None or functor not in by_functor:
                    continue
                left, out = self.passed(by_functor[functor], fresh)
                if cyclic:
                    done[functor] = left
                else:
                    self.store.put(functor, left)
                for f, df in out:
                    if cyclic:
                        coming[f].append(df)
                    else:
                        self.append(f, self.numbered(df))
            if not cyclic:
                return
            self.settle(done, coming, by_functor, todo)

    def settle(self, done: dict, coming: dict, by_functor: dict, todo: dict) -> None:
        """After a round of a cyclic pipeline: facts that stayed are final; emitted ones meet the rules in the next."""
        self._stayed = getattr(self, "_stayed", {})
        for f, df in done.items():
            df = checkpointed(df)
            self._stayed[f] = together([self._stayed[f], df]) if f in self._stayed else df
        todo.clear()
        for f, parts in coming.items():
            new = checkpointed(self.numbered(together(parts)))
            self.store.taken(new)
            if new.isEmpty():
                continue
            if f in by_functor:
                todo[f] = new
            else:
                self.append(f, new)
        if not todo:
            for f in by_functor:
                if f in self._stayed:
                    self.store.put(f, self._stayed[f])
            self._stayed = {}

    @staticmethod
    def functor_order(rules) -> list:
        out: list = []
        for r in Evaluation.in_order(list(rules)):
            if r.heads[0].functor not in out:
                out.append(r.heads[0].functor)
        return out

    def passed(self, rules: list[ast.Rule], df: DataFrame) -> tuple[DataFrame, list]:
        """(facts that no rule removes, emitted facts by rule). Each fact's match with each rule is one boolean; the first removing rule that matches ends the list."""
        flags, names_of, previous, marked = [], [], F.lit(True), df
        fired_names: dict = {}
        for i, rule in enumerate(rules):
            head = rule.heads[0]
            condition = self.fits(head, rule, df)
            alone = previous & condition
            if rule.kind == ast.PROPAGATION and rule.name:
                for j in fired_names.get(rule.name, []):
                    alone = alone & ~F.col(f"_m{j}")
                fired_names.setdefault(rule.name, []).append(i)
            marked = marked.withColumn(f"_m{i}", alone)
            flags.append(f"_m{i}")
            names_of.append(rule)
            if rule.kind != ast.PROPAGATION:
                previous = previous & ~F.col(f"_m{i}")
        removing = [f for f, r in zip(flags, names_of, strict=True) if r.kind != ast.PROPAGATION and r.removed]
        gone = F.lit(False)
        for f in removing:
            gone = gone | F.col(f)
        left = marked.filter(~gone).select(*df.columns)
        if removing:
            self.went(rules[0].heads[0].functor, lambda: marked.filter(gone).select(*df.columns))
        out = []
        for f, rule in zip(flags, names_of, strict=True):
            m = scan(rule.heads[0], marked.filter(F.col(f)).select(*df.columns), 0)
            m = Matches(self.count(rule, m.frame), m.names)
            self.effects += effects(rule, m, self.functions)
            out += emitted(rule, m, self.functions)
        return left, out

    def fits(self, head: ast.Atom, rule: ast.Rule, df: DataFrame):
        """Whether a fact matches a head and passes the guards, as a Column over the fact."""
        from emberline.functions.scalar import Typed, kind_of, literal, strictly_equal

        names, out = {}, F.lit(True)
        for k, arg in enumerate(head.args):
            cell = Typed(F.col(f"a{k}"), kind_of(df.schema[f"a{k}"].dataType))
            if isinstance(arg, ast.Lit):
                out = out & F.coalesce(strictly_equal(cell, literal(arg.value)), F.lit(False))
            elif not arg.wild:
                if arg.name in names:
                    out = out & F.coalesce(strictly_equal(names[arg.name], cell), F.lit(False))
                else:
                    names[arg.name] = cell
        test = guard(rule.guards, names, self.functions)
        return out if test is None else out & test

    def went(self, functor, removed: Callable[[], DataFrame]) -> None:
        """Tells the hooks of facts that rules removed."""
        for hook in self.store.on_remove:
            hook(functor, removed())

    # U

    def replace(self, stratum: Stratum) -> None:
        """All facts that match go; for each different one of them (equal facts are replaced together) a new one comes. A fact with a NaN equals none, itself included, and stays beside its new one."""
        rule = stratum.rules[0]
        head, new = rule.heads[0], rule.body[0].new
        df = self.store.frame(head.functor)
        if df is None:
            return
        if head.functor in self.lazy:
            df = checkpointed(df)
            self.lazy.discard(head.functor)
        args = [c for c in df.columns if c != "cid"]
        match = self.fits(head, rule, df)
        nan = F.lit(False)
        for f in df.schema:
            if f.name in args and f.dataType.typeName() in ("double", "float"):
                nan = nan | F.coalesce(F.isnan(f.name), F.lit(False))
        once = df.filter(match).groupBy(*args, F.when(nan, F.col("cid")).alias("_nan")).agg(F.min("cid").alias("cid")).select("cid", *args)
        m = scan(head, once, 0)
        m = Matches(self.count(rule, m.frame), m.names)
        if self.trace:
            self.history.append(m.frame.select(F.lit(rule.name).alias("rule"), F.array("c0").alias("ids")))
        came = self.numbered(facts(new, m.frame, m.names, self.functions))
        self.went(head.functor, lambda: df.filter(match & ~nan))
        self.store.put(head.functor, df.filter(~match | nan))
        self.append(new.functor, came)

    # C

    def aggregate(self, stratum: Stratum) -> None:
        rule = stratum.rules[0]
        a, b = rule.heads
        self.compared(rule)
        if self.store.frame(a.functor) is None or self.store.frame(b.functor) is None:
            return
        df = self.store.frame(a.functor)
        before = {f: self.store.frame(f) for f in (a.functor, b.functor)}
        self.aggregated(stratum, rule, df)
        for f, was in before.items() if self.store.on_remove else ():
            now = self.store.frame(f)
            self.went(f, lambda was=was, now=now: was.join(now.select("cid"), "cid", "left_anti"))

    def aggregated(self, stratum: Stratum, rule: ast.Rule, df: DataFrame) -> None:
        a, b = rule.heads
        if stratum.idiom == "keep_first":
            self.store.put(a.functor, idioms.keep_first(df))
        elif stratum.idiom in ("least", "greatest"):
            self.store.put(a.functor, idioms.extreme(df, stratum.idiom == "least"))
        elif stratum.idiom in ("sum", "product", "min", "max"):
            self.store.put(a.functor, idioms.fold(df, stratum.idiom))
        elif stratum.idiom == "pair":
            left, right, pairs = idioms.pair(rule, df, self.store.frame(b.functor))
            self.finish(rule, pairs, {a.functor: left, b.functor: right})
        else:
            kept, removed = rule.kept[0], rule.removed[0]
            m, left = idioms.consume(rule, self.store.frame(kept.functor), self.store.frame(removed.functor), self.functions)
            self.finish(rule, m, {removed.functor: left})

    def finish(self, rule: ast.Rule, m: Matches, left: dict) -> None:
        m = Matches(self.count(rule, m.frame), m.names)
        self.effects += effects(rule, m, self.functions)
        out = emitted(rule, m, self.functions)
        for f, df in left.items():
            self.store.put(f, df)
        for f, df in out:
            self.append(f, self.numbered(df))

"""Programs end to end, and set-at-a-time strata against the one-firing-at-a-time machine."""

import random

import pytest

from emberline.engine import HostFunction, create_engine
from emberline.plans import analyzer
from emberline.plans.errors import ExecutionError
from emberline.plans.parser import parse_program
from emberline.plans.sequential import Machine


def rows(engine, name, arity):
    return sorted((tuple(r)[1:] for r in engine.facts(name, arity).collect()), key=repr)


def machine(source, facts):
    m = Machine(analyzer.scheduled([r if r.name else __import__("dataclasses").replace(r, name=f"r{i}") for i, r in enumerate(parse_program(source).rules)]), limit=None)
    for name, args in facts:
        m.add(name, args)
    m.run()
    return {f: list(v.values()) for f, v in m.by_functor.items()}


def check(spark, source, facts, kinds=None, **options):
    engine = create_engine(spark, source, max_rule_firings=None, **options)
    assert kinds is None or "".join(s.kind for s in analyzer.strata(engine.rules)) == kinds
    engine.assert_many(facts)
    expected = machine(source, facts)
    for f, want in expected.items():
        assert rows(engine, *f) == sorted((tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in want), key=repr), f
    return engine


def test_fibonacci(spark):
    source = "fib @ upto(M), fib(A, X), fib(B, Y) ==> B === A + 1, B < M | fib(B + 1, X + Y);"
    e = check(spark, source, [("upto", (5,)), ("fib", (1, 1)), ("fib", (2, 1))], "A")
    assert rows(e, "fib", 2) == [(1, 1), (2, 1), (3, 2), (4, 3), (5, 5)]


@pytest.mark.parametrize("source, kinds", [
    ("a(X), b(X) ==> c(X); c(X), a(_) ==> d(X);", "A"), ("a(X), a(Y) ==> s(X, Y);", "A"), ("a(X), b(Y) ==> X < Y, Y > 2 | c(X, Y);", "A"),
    ("a(X) \\ a(X) <=> true;", "C"), ("e(K, A) \\ e(K, B) <=> A <= B | true;", "C"), ("e(K, A) \\ e(K, B) <=> A >= B | true;", "C"), ("e(K, A), e(K, B) <=> e(K, A + B);", "C"), ("a(X), b(X) <=> p(X);", "C"), ("a(X) \\ b(X) <=> c(X);", "C"),
    ("a(1) <=> z(); a(X) <=> X > 2, gt(X, 3) | b(X); a(X) ==> seen(X); b(X) <=> X > 4 | c(X * 2);", "B"),
    ("@5@ k @ a(X) \\ a(X) <=> true; r @ a(X), b(X) ==> c(X);", "CA"), ("a(X), b(X) ==> c(X, 'q', true); c(X, 'q', _) ==> d([X, 1]);", "A"), ("a(X) <=> X > 0 | a(X - 1);", "B"), ("a(X), a(Y) <=> X < Y | b(X, Y);", "D"),
])
def test_strata_as_machine(spark, source, kinds):
    rng = random.Random(len(source))
    facts = [(n, (rng.randrange(5),)) for n in rng.choices("ab", k=14)] + [("e", (rng.randrange(3), rng.randrange(6))) for _ in range(12)]
    if "d([" in source:
        engine = create_engine(spark, source, max_rule_firings=None)
        engine.assert_many(facts)
        assert engine.facts("d", 1).count() == len(machine(source, facts).get(("d", 1), []))
        return
    check(spark, source, facts, kinds)


def test_closure(spark):
    edges = [("edge", p) for p in [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5)]]
    source = "edge(X, Y) ==> path(X, Y); path(X, Y), edge(Y, Z) ==> path(X, Z);"
    check(spark, source, edges, "A")
    ring = create_engine(spark, source, distinct=True)
    ring.assert_many([("edge", (1, 2)), ("edge", (2, 3)), ("edge", (3, 1))])
    assert len(rows(ring, "path", 2)) == 9
    endless = create_engine(spark, source, max_rule_firings=50)
    with pytest.raises(ExecutionError, match="Maximum rule firings"):
        endless.assert_many([("edge", (1, 2)), ("edge", (2, 1))])
    assert endless.get_state() == "error"


def test_incremental_and_trace(spark):
    e = create_engine(spark, "j @ a(X), b(Y) ==> c(X, Y);", trace=True)
    e.assert_fact("a", [1])
    e.assert_fact("b", [2])
    assert e.expect("c", (1, 2)).count(1)
    e.assert_fact("a", [1])
    assert e.expect("c", (1, 2)).count(2) and e.expect("d").missing()
    assert {f.rule for f in e.trace} == {"j"} and e.history_snapshot().count() >= 1


def test_builtins_as_machine(spark):
    tests = ["gt(X, 2)", "X === 2", "X !== 2", "in(X, [1, 2])", "X in [3]", "isNumber(X)", "isString(S)", "stringLength(S) === 2", "stringConcat(S, X) === 'ab2'", "allDifferent(X, 2)", "not(X)", "div(X, 0)", "mod(X, 2) === 1", "X / 0 > 5", "abs(X - 4) <= 1", "min(X, 2) === X", "!X || S === 'c'", "lt(S, 2)", "-X < 0 && true", "isNull(S)", "eq(S, 'c')", "max(X, 1) * 2 === 4"]
    source = "".join(f"t{i} @ v(X, S) ==> {t} | ok({i}, X);" for i, t in enumerate(tests))
    facts = [("v", (x, s)) for x in (0, 1, 2, 3) for s in ("ab", "c", "", None)]
    check(spark, source, facts, "A")


def test_errors(spark):
    e = create_engine(spark, "constraint a/1; functions f/1;")
    for bad in ("a(X, Y) ==> b(X);", "a(X) ==> b(Y);", "a(X) ==> ff(X) | b(X);", "a(X) => b;", "a(f(X)) ==> b(X);"):
        assert e.validate(bad), bad
    e2 = create_engine(spark, "a(X) ==> X > 5 | b(X);")
    with pytest.raises(ExecutionError):
        e2.assert_fact("a", ["text"])
    assert e2.get_state() == "error"
    e2.clear()
    assert e2.get_state() == "ready"
    e2.assert_fact("a", [6])
    assert e2.expect("b", (6,)).exists()


def test_update_priority_actions(spark):
    heard = []
    e2 = create_engine(spark, "one @ a(X) ==> a(X) <= c(X + 1);")
    e2.assert_many([("a", (1,)), ("a", (1,)), ("a", (2,))])
    assert rows(e2, "c", 1) == [(2,), (3,)] and e2.expect("a").missing()
    e3 = create_engine(spark, "low @ a(X) <=> p('low'); @3@ high @ a(X) <=> p('high'), !log(X);")
    e3.register_action("log", lambda *a: heard.append(a))
    e3.assert_fact("a", [1])
    assert rows(e3, "p", 1) == [("high",)] and heard == [(1.0,)]


@pytest.mark.parametrize("source", ["a(X), b(X) ==> c(X); c(X), a(_) ==> d(X);", "a(X) <=> X > 2 | b(X); a(X) ==> seen(X);", "a(X) \\ a(X) <=> true;", "@5@ k @ a(X) \\ a(X) <=> true; r @ a(X), b(X) ==> c(X);"])
def test_batches(spark, source):
    rng = random.Random(9)
    facts = [(n, (rng.randrange(5),)) for n in rng.choices("ab", k=12)]
    engine = create_engine(spark, source, max_rule_firings=None, trace=True)
    m = Machine(analyzer.scheduled(engine.rules), limit=None)
    for part in (facts[:5], facts[5:9], facts[9:]):
        engine.assert_many(part)
        for f in part:
            m.add(*f)
        m.run()
    for f, want in m.by_functor.items():
        assert rows(engine, *f) == sorted((tuple(map(float, r)) for r in want.values()), key=repr), f


def test_ids_of_300_partitions(spark):
    """Ids of frames of many partitions never meet, so self-joins, pairs, consuming and keep-first lose and remove nothing else."""
    numbers = lambda a, b: spark.range(a, b).selectExpr("double(id) AS x").repartition(300)
    e = create_engine(spark, "a(X), a(Y) ==> X < Y | s(X, Y);", max_rule_firings=None)
    e.assert_df("a", numbers(0, 60), run=False)
    e.assert_df("a", numbers(60, 120), run=False)
    e.run()
    assert e.facts("a", 1).agg({"cid": "count"}).first()[0] == e.facts("a", 1).select("cid").distinct().count() == 120
    assert e.facts("s", 2).count() == e.facts("s", 2).distinct().count() == 120 * 119 // 2
    e = create_engine(spark, "a(X), b(X) <=> c(X);", max_rule_firings=None)
    e.assert_df("a", numbers(0, 600), run=False)
    e.assert_df("b", numbers(599, 1200), run=False)
    e.run()
    assert [e.facts(*f).count() for f in (("a", 1), ("b", 1), ("c", 1))] == [599, 600, 1]
    e = create_engine(spark, "k(X) \\ r(X) <=> gone(X); gone(X) \\ gone(X) <=> true;", max_rule_firings=None)
    e.assert_df("k", numbers(0, 50), run=False)
    e.assert_df("r", numbers(25, 75), run=False)
    e.assert_df("r", numbers(25, 30), run=False)
    e.run()
    assert [e.facts(*f).count() for f in (("k", 1), ("r", 1), ("gone", 1))] == [50, 25, 25]


@pytest.mark.parametrize("rule", ["a(X), a(Y) ==> s(X, Y)", "a(X), a(Y) ==> X === Y | s(X, Y)", "a(X), a(Y) ==> X !== Y | s(X, Y)", "a(X), a(Y) ==> X + Y > 7 | s(X, Y)", "a(X), a(Y) ==> X * 2 > Y | s(X, Y)", "a(X), a(3) ==> s(X, 3)", "a(X), a(X) ==> s(X, X)"])
def test_symmetric_heads_as_the_machine(spark, rule):
    facts = [("a", (float(x),)) for x in (5, 1, 3, 3, 8, 2)]
    e = create_engine(spark, rule + ";", max_rule_firings=None)
    e.store.add_rows("a", [a for _, a in facts])
    e.run()
    assert sorted(tuple(r)[1:] for r in e.facts("s", 2).collect()) == sorted(machine(rule + ";", facts).get(("s", 2), []))


@pytest.mark.parametrize("source", ["a(X), b(Y) <=> p(X, Y);", "a(X), b(X) <=> p(X, X);", "a(X) \\ b(Y) <=> p(X, Y);", "a(X) \\ b(X) <=> p(X, X);", "a(X) \\ b(Y) <=> X > 2 | p(X, Y);", "a(X) \\ b(Y) <=> X > 2, Y < 4 | p(X, Y);", "a(X) \\ b(Y) <=> X > Y | p(X, Y);"])
def test_removing_pairs_as_the_machine(spark, source):
    facts = [("a", (float(x),)) for x in (1, 3, 3, 8)] + [("b", (float(x),)) for x in (3, 4, 3, 3, 1)]
    e = create_engine(spark, source, max_rule_firings=None)
    for name in "ab":
        e.assert_df(name, spark.createDataFrame([a for n, a in facts if n == name], "x double").coalesce(1), run=False)
    e.run()
    assert {s.kind for s in analyzer.strata(e.rules)} == {"C"}
    assert sorted((n, *tuple(r)[1:]) for n, k in (("a", 1), ("b", 1), ("p", 2)) for r in e.facts(n, k).collect()) == sorted((n, *args) for (n, _), found in machine(source, facts).items() for args in found)


def test_replacing_rule_as_the_machine(spark):
    facts = [("o", (1.0, "a")), ("o", (2.0, "a")), ("o", (1.0, "a")), ("o", (3.0, "b")), ("o", (9.0, "a"))]
    source = "r @ o(K, 'a') ==> K < 5 | o(K, 'a') <= o(K + 1, 'b');"
    e = create_engine(spark, source)
    assert analyzer.strata(e.rules)[0].kind == "U"
    e.store.add_rows("o", [a for _, a in facts])
    e.run()
    assert sorted(tuple(r)[1:] for r in e.facts("o", 2).collect()) == sorted(machine(source, facts)["o", 2])
    assert analyzer.strata(create_engine(spark, "o(K, S) ==> o(K, S) <= o(K, 'b');").rules)[0].kind == "D"


def test_lookup_one_over_frames(spark):
    source = "part(K) ==> K > lookupOne('low', 0) | out(K, lookupOne('low', 1)); part(K) ==> lookupOne('none', 0) | never(K);"
    e = create_engine(spark, source, max_rule_firings=None)
    assert {s.kind for s in analyzer.strata(e.rules)} == {"A"}
    e.assert_df("low", spark.createDataFrame([(2.0, "x"), (9.0, "y")], "a double, b string").coalesce(1), run=False)
    e.assert_df("part", spark.createDataFrame([(float(i),) for i in range(5)], "k double"), run=False)
    e.run()
    assert sorted(tuple(r)[1:] for r in e.facts("out", 2).collect()) == [(3.0, "x"), (4.0, "x")] and e.facts("never", 1).count() == 0
    changing = create_engine(spark, "part(K) ==> out(lookupOne('out', 0));")
    assert analyzer.strata(changing.rules)[0].kind == "D"


def test_awaitable_values_and_timeout(spark):
    import asyncio

    async def slow(x):
        await asyncio.sleep(5 if x > 1 else 0)
        return True

    e = create_engine(spark, "a(X) ==> slow(X) | b(X);", host_timeout=0.2, max_rule_firings=100)
    e.register_function("slow", python=slow, returns="boolean")
    e.assert_many([("a", (1,)), ("a", (2,))])
    assert rows(e, "b", 1) == [(1.0,)]
    e = create_engine(spark, "a(X) <=> b(slow(X)); b(X), c(X) ==> d(lookup('b'));", host_timeout=0.2)
    e.register_function("slow", python=slow, returns="boolean")
    with pytest.raises(ExecutionError, match="took more than"):
        e.assert_fact("a", [2])
    assert e.get_state() == "error"


def test_context_of_functions_and_actions(spark):
    heard = []
    e = create_engine(spark, "r @ a(X) ==> known(X) > 0 | b(X), !tell(X);")
    e.register_function("known", python=lambda c, x: len(c.rule.heads) + c.bindings["X"], context=True)
    e.register_action("tell", lambda c, x: heard.append((c.engine is e, c.rule.name, c.bindings, [m[1] for m in c.matched], x)), context=True)
    e.assert_fact("a", [1])
    assert heard == [(True, "r", {"X": 1.0}, ["a"], 1.0)] and rows(e, "b", 1) == [(1.0,)]
    frames = []
    e = create_engine(spark, "a(X) ==> !log(X);", max_rule_firings=None)
    e.register_table_action("log", lambda df: frames.append(sorted(r.args for r in df.collect())))
    e.assert_many([("a", (1,)), ("a", (2,))])
    assert frames == [[['{"v":1.0}'], ['{"v":2.0}']]]


def test_typed_view_warnings_and_helpers(spark, tmp_path):
    from emberline.functions import host

    e = create_engine(spark, "functions f/1, g/1; actions h/0; a(X), b(X) ==> f(X) > 1 | c(1);", builtins={"f": HostFunction(column=lambda x: x), "g": HostFunction(column=lambda x: x)})
    assert any("g is declared and never used" in w for w in e.get_warnings()) and any("h is declared" in w for w in e.get_warnings()) and not any(" f is" in w for w in e.get_warnings())
    assert any("X stands in more than one place" in w for w in e.get_warnings())
    typed = create_engine(spark, "edge(X, Y) ==> path(X, Y);").with_constraints(edge=(int, str))
    typed.assert_many([("edge", (1, "a"))])
    assert typed.expect("path", (1, "a")).exists()
    for bad in (("edge", (1, 2)), ("edge", (1,)), ("edges", (1, "a")), ("edge", (True, "a"))):
        with pytest.raises(ExecutionError):
            typed.assert_fact(*bad)
    assert host.numeric(2) == 2 and host.compare(1, 2, lambda a, b: a < b) and host.evaluate_binary("/", 1, 0) == float("inf") and host.evaluate_binary("in", 1, [1.0]) and not host.evaluate_binary("&&", "", 1)
    for wrong in (lambda: host.numeric("1"), lambda: host.evaluate_binary("<", "a", 1), lambda: host.evaluate_binary("%", 1, 1)):
        with pytest.raises(ExecutionError):
            wrong()
    assert host.create_functor("a", 2) == "a/2" and host.create_constraint(3, "a", [1]) == (3, "a", (1,))
    (tmp_path / "rules").write_text("a(X) ==> b(X);")
    loaded = create_engine(spark)
    loaded.load(str(tmp_path / "rules"))
    loaded.assert_fact("a", ["x"])
    assert loaded.facts("b", 1).count() == 1
    loaded.store.write_parquet(str(tmp_path / "store"))
    again = type(loaded.store).read_parquet(spark, str(tmp_path / "store"), [("a", 1), ("b", 1)])
    assert again.size() == 2 and again.next_id > max(r.cid for r in again.snapshot().collect()) and len(again.to_json()) == 2

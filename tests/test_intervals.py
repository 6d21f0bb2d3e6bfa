"""Interval operators against integer enumeration."""

from itertools import combinations

from pyspark.sql import functions as F

from emberline.functions import intervals as iv
from emberline.operators.interval_join import interval_join


def test_relations_and_operations(spark):
    pairs = [(a, b, c, d) for a, b in combinations(range(6), 2) for c, d in combinations(range(6), 2)]
    df = spark.createDataFrame(pairs, "b int, e int, c int, f int").select("*", iv.create(F.col("b"), F.col("e")).alias("t"), iv.create(F.col("c"), F.col("f")).alias("u"))
    t, u = F.col("t"), F.col("u")
    tests = [iv.relates(s, t, u).cast("int") for s in iv.ORDER]
    rows = df.select("*", sum(tests[1:], tests[0]).alias("n"), iv.find_relation(t, u).alias("r"), iv.find_relation(u, t).alias("i"), iv.gap(t, u).alias("gap"), iv.intersection(t, u).alias("both"), iv.union(t, u).alias("one"), iv.minus(t, u).alias("rest"), iv.span(t, u).alias("span")).collect()
    for r in rows:
        assert r.n == 1 and iv.INVERSE[r.r] == r.i
        x, y = set(range(r.b, r.e)), set(range(r.c, r.f))
        cells = lambda i: set(range(*i)) if i else set()
        assert cells(r.both) == x & y
        assert set().union(*[cells(p) for p in r.rest]) == x - y
        assert (r.one is None) == (r.e < r.c or r.b > r.f) and (r.one is None or cells(r.one) == x | y)
        assert (r.gap is None) == (not (r.e < r.c or r.b > r.f))
        assert tuple(r.span) == (min(r.b, r.c), max(r.e, r.f))
    assert len(iv.transitivity()) == 169 and iv.compose({"<"}, {"m"}) == {"<"} and iv.compose({"<"}, {">"}) == set(iv.ORDER)
    assert df.select(iv.composed(F.array(F.lit("<")), F.array(F.lit("m"))).alias("x")).first().x == ["<"]


def test_points(spark):
    t = iv.create(F.lit(1), F.lit(5))
    row = spark.range(1).select(iv.chop(t, F.lit(3)).alias("c"), iv.chop(t, F.lit(5)).alias("n"), *[iv.clamp(t, F.lit(x)).alias(f"k{x}") for x in (0, 3, 6)], iv.contains_point(t, F.lit(5)).alias("p"), iv.with_start(t, F.lit(9)).alias("w"), iv.to_string(t).alias("s"), iv.with_end(t, F.lit(2)).alias("e")).first()
    assert [tuple(x) for x in row.c] == [(1, 3), (3, 5)] and row.n is None and (row.k0, row.k3, row.k6) == (1, 3, 5) and row.p and row.w is None and row.s == "[1, 5]" and tuple(row.e) == (1, 2)


def test_interval_join(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(combinations(range(0, 40, 3), 2))]
    df = spark.createDataFrame(rows, "id int, a int, b int").select("id", iv.create(F.col("a"), F.col("b")).alias("t"))
    other = df.select(F.col("id").alias("id2"), F.col("t").alias("u"))
    for symbols in ({"o", "m"}, {"d"}, set(iv.RELATION_SETS["concur"])):
        found = sorted((r.id, r.id2) for r in interval_join(df, other, "t", "u", symbols, 7).select("id", "id2").collect())
        expected = sorted((r.id, r.id2) for r in df.crossJoin(other).filter(iv.any_of(symbols, F.col("t"), F.col("u"))).select("id", "id2").collect())
        assert found == expected


def test_interval_join_equal_intervals(spark):
    """Rows of frequent intervals are paired after their groups have met, by several tasks, whole and once."""
    t, u = iv.create(F.lit(0), F.lit(5)), iv.create(F.lit(3), F.lit(8))
    a, b = spark.range(300).select("id", t.alias("t")), spark.range(400).select(F.col("id").alias("id2"), u.alias("u"))
    joined = interval_join(a, b, "t", "u", {"o"}, 10).select("id", "id2", F.spark_partition_id().alias("task"))
    rows = joined.collect()
    assert len(rows) == 120_000 and len({(r.id, r.id2) for r in rows}) == 120_000
    assert len({r.task for r in rows}) >= 4
    plan, made = [joined._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        inner = node.children() if node.nodeName() != "AdaptiveSparkPlan" else None
        if "QueryStage" in node.nodeName() or inner is None:
            plan.append(node.plan() if inner is not None else node.executedPlan())
            continue
        if "Join" in node.nodeName():
            made.append(node.metrics().apply("numOutputRows").value())
        plan += [inner.apply(i) for i in range(inner.size())]
    assert made and sum(made) < 1000


def test_interval_join_columns(spark):
    """Columns ``on``, further ones (nulls, a map, copies of rows) and none; nulls of intervals and keys pair with nothing."""
    a = spark.sql("select k, t, m, x from values (1, named_struct('start', 1.5D, 'end', 12D), map('a', 1), null), (1, named_struct('start', 1.5D, 'end', 12D), map('a', 1), null), (2, named_struct('start', -7D, 'end', -3D), null, 'y'), (null, named_struct('start', 1D, 'end', 2D), null, 'z'), (1, null, null, 'n') as v(k, t, m, x)")
    b = spark.sql("select y, u, k from values ('p', named_struct('start', 11D, 'end', 40D), 1), ('q', named_struct('start', -5D, 'end', 9D), 2), ('r', named_struct('start', 11D, 'end', 40D), 2), ('s', named_struct('start', 1.5D, 'end', 3D), null), (null, named_struct('start', 5D, 'end', 13D), 1) as v(y, u, k)")
    found = interval_join(a, b, "t", "u", {"o"}, 4, ["k"])
    assert found.columns == ["k", "t", "m", "x", "y", "u"]
    plain = a.join(b, "k").filter(iv.any_of({"o"}, F.col("t"), F.col("u"))).select(found.columns)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect())) and found.count() == 5
    assert interval_join(a.select("t"), b.select("u"), "t", "u", {"o"}, 4).count() == a.crossJoin(b).filter(iv.any_of({"o"}, F.col("t"), F.col("u"))).count()

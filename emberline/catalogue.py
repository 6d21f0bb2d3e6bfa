"""Rule programs and interval queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.engine import Engine, HostFunction, create_engine, define_host_module
from emberline.functions import intervals as iv
from emberline.operators import idioms
from emberline.operators.interval_join import interval_join

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


def solved(spark: SparkSession, rules: str, facts: dict[str, DataFrame], key: str | None = None, **options) -> Engine:
    """An engine at its fixpoint. ``key`` orders the facts of frames that have such a column."""
    engine = create_engine(spark, rules, max_rule_firings=None, **options)
    for name, df in facts.items():
        engine.assert_df(name, df, key if key in df.columns else None, run=False)
    engine.run()
    return engine


def named(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(f"a{i}").alias(n) for i, n in enumerate(names)])


# scans, filters, joins


@query("SELECT l_orderkey AS o, CAST(l_linenumber AS DOUBLE) AS l, l_extendedprice * 2 AS p FROM lineitem WHERE l_quantity > 45 AND l_extendedprice > 1000")
def prop_filter(spark, sf):
    e = solved(spark, "big @ item(O, L, Q, P) ==> Q > 45, P > 1000 | big_item(O, L * 1, P * 2);", {"item": table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")})
    return named(e.facts("big_item", 3), "o", "l", "p")


def flagship(spark, sf):
    return prop_filter(spark, sf)


ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_orderstatus = 'F'")
def prop_literal_head(spark, sf):
    return named(solved(spark, "done @ ord(K, C, 'F', _) ==> done(K, C);", {"ord": table(spark, sf, "orders", *ORDERS)}).facts("done", 2), "k", "c")


@query("SELECT o_orderkey AS k FROM orders")
def prop_wildcard(spark, sf):
    return named(solved(spark, "seen @ ord(K, _, _, _) ==> seen(K);", {"ord": table(spark, sf, "orders", *ORDERS)}).facts("seen", 1), "k")


@query("SELECT n_nationkey AS x FROM nation WHERE n_nationkey = n_regionkey")
def prop_repeat_var(spark, sf):
    return named(solved(spark, "n(X, X) ==> same(X);", {"n": table(spark, sf, "nation", "n_nationkey", "n_regionkey")}).facts("same", 1), "x")


@query("SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def join2(spark, sf):
    return named(solved(spark, "nation(N, R), region(R, S) ==> lies(N, S);", {"nation": table(spark, sf, "nation", "n_name", "n_regionkey"), "region": table(spark, sf, "region", "r_regionkey", "r_name")}).facts("lies", 2), "n", "r")


@query("SELECT c_custkey AS c, n_name AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0")
def join3(spark, sf):
    facts = {"customer": table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal"), "nation": table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey"), "region": table(spark, sf, "region", "r_regionkey", "r_name")}
    return named(solved(spark, "customer(C, N, B), nation(N, M, R), region(R, S) ==> B > 0 | lives(C, M, S);", facts).facts("lives", 3), "c", "n", "r")


@query("SELECT n_nationkey AS n, r_regionkey AS r FROM nation, region WHERE n_nationkey < r_regionkey")
def cross_guard(spark, sf):
    return named(solved(spark, "n(X), r(Y) ==> X < Y | less(X, Y);", {"n": table(spark, sf, "nation", "n_nationkey"), "r": table(spark, sf, "region", "r_regionkey")}).facts("less", 2), "n", "r")


@query("SELECT a.conv_id AS c, a.turn AS a, b.turn AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def succ_join(spark, sf):
    return named(solved(spark, "t(C, A), t(C, B) ==> B === A + 1 | next(C, A, B);", {"t": table(spark, sf, "conversations", "conv_id", "turn")}).facts("next", 3), "c", "a", "b")


@query("SELECT a.s_suppkey AS s, b.s_suppkey AS t FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def self_join_sethist(spark, sf):
    df = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"), "s_suppkey", "s_nationkey")
    return named(solved(spark, "sup(S, N), sup(T, N) ==> mate(S, T);", {"sup": df}, key="id").facts("mate", 2), "s", "t")


@query("SELECT n_nationkey AS x FROM nation WHERE n_nationkey IN (SELECT r_regionkey FROM region)")
def set_intersect(spark, sf):
    return named(solved(spark, "a(X), b(X) ==> c(X);", {"a": table(spark, sf, "nation", "n_nationkey"), "b": table(spark, sf, "region", "r_regionkey")}).facts("c", 1), "x")


@query("SELECT n_nationkey AS x FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)")
def set_except(spark, sf):
    return named(solved(spark, "b(X) \\ a(X) <=> true;", {"a": table(spark, sf, "nation", "n_nationkey"), "b": table(spark, sf, "region", "r_regionkey")}).facts("a", 1), "x")


# recursion

EDGES_SQL = "e AS (SELECT a.conv_id AS c, a.turn AS x, b.turn AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


@query(f"WITH RECURSIVE {EDGES_SQL}, p AS (SELECT c, x, y FROM e UNION ALL SELECT p.c, p.x, e.y FROM p JOIN e ON p.c = e.c AND p.y = e.x) SELECT c, x, y FROM p")
def closure_multiset(spark, sf):
    """Turns of a conversation that come after one another, at any distance."""
    rules = "turn(C, X), turn(C, Y) ==> Y === X + 1 | next(C, X, Y); next(C, X, Y) ==> path(C, X, Y); path(C, X, Y), next(C, Y, Z) ==> path(C, X, Z);"
    e = solved(spark, rules, {"turn": table(spark, sf, "conversations", "conv_id", "turn")})
    return named(e.facts("path", 3), "c", "x", "y")


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS x, (n_nationkey * 7 + 3) % 25 AS y FROM nation), p AS (SELECT x, y FROM e UNION SELECT p.x, e.y FROM p JOIN e ON p.y = e.x) SELECT x, y FROM p")
def closure_set(spark, sf):
    df = table(spark, sf, "nation", "n_nationkey").select(F.col("n_nationkey").alias("x"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("y"))
    return named(solved(spark, "edge(X, Y) ==> path(X, Y); path(X, Y), edge(Y, Z) ==> path(X, Z);", {"edge": df}, distinct=True).facts("path", 2), "x", "y")


@query("SELECT * FROM (VALUES (1.0::DOUBLE, 1.0::DOUBLE), (2, 1), (3, 2), (4, 3), (5, 5), (6, 8), (7, 13)) t(n, v)")
def fib(spark, sf):
    e = create_engine(spark, "upto(M), fib(A, X), fib(B, Y) ==> B === A + 1, B < M | fib(B + 1, X + Y);")
    e.assert_many([("upto", (7,)), ("fib", (1, 1)), ("fib", (2, 1))])
    return named(e.facts("fib", 2), "n", "v")


# removing rules


@query("""SELECT o_orderkey AS k, o_totalprice * 1.01 + 1 AS p, CASE WHEN o_totalprice * 1.01 > 200000 THEN 'large' ELSE 'small' END AS s FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'P'""")
def simp_pipeline(spark, sf):
    rules = """
    drop @ ord(_, _, 'P', _) <=> rejected();        check @ ord(K, _, _, P) <=> P > 1000 | checked(K, P);
    price @ checked(K, P) <=> priced(K, P * 1.01);  large @ priced(K, P) <=> P > 200000 | sized(K, P, 'large');
    small @ priced(K, P) <=> sized(K, P, 'small');  book @ sized(K, P, S) <=> booked(K, P + 1, S);
    """
    return named(solved(spark, rules, {"ord": table(spark, sf, "orders", *ORDERS)}).facts("booked", 3), "k", "p", "s")


@query("SELECT user_id AS u, event_type AS t, min(event_id) AS first_id FROM events GROUP BY 1, 2")
def simpag_keep_first(spark, sf):
    e = solved(spark, "ev(U, T) \\ ev(U, T) <=> true;", {"ev": table(spark, sf, "events", "event_id", "user_id", "event_type")}, key="event_id")
    return e.facts("ev", 2).select(F.col("a0").alias("u"), F.col("a1").alias("t"), (F.col("cid") - 1).alias("first_id"))


@query("SELECT l_suppkey AS k, min(l_extendedprice) AS v FROM lineitem GROUP BY 1")
def simpag_min(spark, sf):
    return named(solved(spark, "m(K, A) \\ m(K, B) <=> A <= B | true;", {"m": table(spark, sf, "lineitem", "l_suppkey", "l_extendedprice")}).facts("m", 2), "k", "v")


@query("SELECT l_suppkey AS k, max(l_extendedprice) AS v FROM lineitem GROUP BY 1")
def simpag_max(spark, sf):
    return named(solved(spark, "m(K, A) \\ m(K, B) <=> A >= B | true;", {"m": table(spark, sf, "lineitem", "l_suppkey", "l_extendedprice")}).facts("m", 2), "k", "v")


@query("SELECT l_returnflag AS k, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY 1")
def simp_sum(spark, sf):
    e = solved(spark, "s(K, A), s(K, B) <=> s(K, A + B);", {"s": table(spark, sf, "lineitem", "l_returnflag", "l_quantity")})
    return named(e.facts("s", 2), "k", "v").withColumn("v", F.round("v", 2))


@query("SELECT event_type AS k, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1")
def simp_count(spark, sf):
    df = table(spark, sf, "events", "event_type").withColumn("one", F.lit(1.0))
    return named(solved(spark, "c(K, A), c(K, B) <=> c(K, A + B);", {"c": df}).facts("c", 2), "k", "n")


@query("""WITH a AS (SELECT user_id AS u, event_id AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'view'),
b AS (SELECT user_id AS u, event_id AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'purchase') SELECT a.u, v, p FROM a JOIN b ON a.u = b.u AND a.n = b.n""")
def simp_pair(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("id"), "user_id", "event_id", "event_type")
    of = lambda kind: ev.filter(F.col("event_type") == kind).drop("event_type")
    return named(solved(spark, "view(U, V), buy(U, P) <=> pair(U, V, P);", {"view": of("view"), "buy": of("purchase")}, key="id").facts("pair", 3), "u", "v", "p")


@query("SELECT c_custkey AS c, s AS s FROM customer JOIN (SELECT s_nationkey AS n, min(s_suppkey) AS s FROM supplier GROUP BY 1) ON c_nationkey = n")
def simpag_consume(spark, sf):
    sup = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"), "s_suppkey", "s_nationkey")
    return named(solved(spark, "sup(S, N) \\ cust(C, N) <=> served(C, S);", {"sup": sup, "cust": table(spark, sf, "customer", "c_custkey", "c_nationkey")}, key="id").facts("served", 2), "c", "s")


@query("SELECT c_custkey AS c FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def simpag_left_over(spark, sf):
    facts = {"sup": table(spark, sf, "supplier", "s_nationkey", "s_acctbal"), "cust": table(spark, sf, "customer", "c_custkey", "c_nationkey")}
    return named(solved(spark, "sup(N, B) \\ cust(C, N) <=> B > 5000 | true;", facts).facts("cust", 2).drop("a1"), "c")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS s FROM orders")
def update_inplace(spark, sf):
    e = solved(spark, "open @ ord(K, 'O') ==> ord(K, 'O') <= ord(K, 'open');", {"ord": table(spark, sf, "orders", "o_orderkey", "o_orderstatus")})
    return named(e.facts("ord", 2), "k", "s")


@query("SELECT s, n FROM (SELECT DISTINCT 'fulfilled' AS s, o_custkey::DOUBLE * 2 AS n FROM orders WHERE o_orderstatus = 'F' AND o_custkey > 20 UNION ALL SELECT o_orderstatus, o_custkey::DOUBLE FROM orders WHERE o_orderstatus <> 'F' OR o_custkey <= 20)")
def update_equal_facts(spark, sf):
    """Facts that are equal are replaced together, by one."""
    df = table(spark, sf, "orders", "o_orderstatus", "o_custkey").withColumn("o_custkey", F.col("o_custkey").cast("double"))
    return named(solved(spark, "ful @ of('F', C) <=> C > 20 | of('F', C) <= of('fulfilled', C * 2);", {"of": df}).facts("of", 2), "s", "n")


@query("SELECT * FROM (VALUES (1.0::DOUBLE, 15.0::DOUBLE), (2, 27)) t(k, v)")
def update_program(spark, sf):
    e = create_engine(spark, "up @ add(K, N), acc(K, V) <=> acc(K, V + N);")
    e.assert_many([("acc", (1, 10)), ("acc", (2, 20)), ("add", (1, 5)), ("add", (2, 7))])
    return named(e.facts("acc", 2), "k", "v")


@query("SELECT o_orderkey AS k, CASE WHEN o_totalprice > 150000 THEN 'vip' WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'rest' END AS c FROM orders")
def priority_order(spark, sf):
    rules = "rest @ ord(K, _, _, _) <=> class(K, 'rest'); @5@ closed @ ord(K, _, 'F', _) <=> class(K, 'closed'); @9@ vip @ ord(K, _, _, P) <=> P > 150000 | class(K, 'vip');"
    return named(solved(spark, rules, {"ord": table(spark, sf, "orders", *ORDERS)}).facts("class", 2), "k", "c")


# built-in functions

PARTS = ("p_partkey", "p_name", "p_size", "p_retailprice")


def parts(spark, sf, rules: str, name: str, *names: str) -> DataFrame:
    return named(solved(spark, rules, {"part": table(spark, sf, "part", *PARTS)}).facts(name, len(names)), *names)


@query("SELECT p_partkey AS k, CAST(p_size AS DOUBLE) + 1 AS a, p_retailprice - 1 AS s, CAST(p_size AS DOUBLE) * 2 AS m, p_retailprice / 4 AS d, CAST(p_size AS DOUBLE) % 7 AS r, least(CAST(p_size AS DOUBLE), 10) AS lo, greatest(CAST(p_size AS DOUBLE), 10) AS hi, abs(CAST(p_size AS DOUBLE) - 25) AS b, -CAST(p_size AS DOUBLE) AS n FROM part")
def bi_arith(spark, sf):
    return parts(spark, sf, "part(K, _, S, P) ==> out(K, add(S, 1), sub(P, 1), mul(S, 2), div(P, 4), mod(S, 7), min(S, 10), max(S, 10), abs(S - 25), -S);", "out", "k", "a", "s", "m", "d", "r", "lo", "hi", "b", "n")


@query("SELECT p_partkey AS k, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge, p_size = 10 AS eq, p_size <> 10 AS ne, NOT (p_size > 10) AS nt, p_size > 10 AND p_size < 20 AS bt FROM part")
def bi_compare(spark, sf):
    return parts(spark, sf, "part(K, _, S, _) ==> out(K, lt(S, 10), lte(S, 10), gt(S, 10), gte(S, 10), eq(S, 10), neq(S, 10), not(S > 10), S > 10 && S < 20);", "out", "k", "lt", "le", "gt", "ge", "eq", "ne", "nt", "bt")


@query("SELECT p_partkey AS k, true AS n, true AS s, false AS b, p_name IS NULL AS z, false AS x, false AS y FROM part")
def bi_types(spark, sf):
    return parts(spark, sf, "part(K, N, S, _) ==> out(K, isNumber(S), isString(N), isBoolean(N), isNull(N), N === 1, eq(S, 'x'));", "out", "k", "n", "s", "b", "z", "x", "y")


@query("SELECT p_partkey AS k, CAST(length(p_name) AS DOUBLE) AS n, p_name || '#' || p_partkey AS c FROM part")
def bi_string(spark, sf):
    return parts(spark, sf, "part(K, N, _, _) ==> out(K, stringLength(N), stringConcat(stringConcat(N, '#'), K));", "out", "k", "n", "c").withColumn("n", F.col("n").cast("double"))


@query("SELECT p_partkey AS k FROM part WHERE p_size <> p_partkey % 50 AND p_size <> 7 AND p_partkey % 50 <> 7")
def bi_alldiff(spark, sf):
    return parts(spark, sf, "part(K, _, S, _) ==> allDifferent(S, mod(K, 50), 7) | out(K);", "out", "k")


@query("SELECT p_partkey AS k FROM part WHERE p_size IN (1, 5, 9, 44) OR p_name IN ('x', 'y')")
def bi_in(spark, sf):
    return parts(spark, sf, "part(K, N, S, _) ==> (S in [1, 5, 9] || in(S, [44]) || N in ['x', 'y']) | out(K);", "out", "k")


@query("SELECT p_partkey AS k, CASE WHEN p_size % 10 = 0 THEN 'infinity' ELSE 'finite' END AS c FROM part")
def bi_guard_errors(spark, sf):
    rules = "part(K, _, S, _) ==> 1 / mod(S, 10) > 5 | out(K, 'infinity'); part(K, _, S, _) ==> div(1, mod(S, 10)) > 0 | out(K, 'finite');"
    return parts(spark, sf, rules, "out", "k", "c")


@query("SELECT p_partkey AS k, (SELECT r_name FROM region ORDER BY r_regionkey LIMIT 1) AS v FROM part WHERE p_size > (SELECT r_regionkey FROM region ORDER BY r_regionkey LIMIT 1)")
def bi_lookup_one(spark, sf):
    regions = table(spark, sf, "region", "r_regionkey", "r_name").withColumn("id", F.col("r_regionkey").cast("long"))
    e = solved(spark, "part(K, S) ==> S > lookupOne('region', 0) | out(K, lookupOne('region', 1));", {"region": regions, "part": table(spark, sf, "part", "p_partkey", "p_size")}, key="id")
    return named(e.facts("out", 2), "k", "v")


@query("SELECT count(*)::DOUBLE AS n FROM region HAVING count(*) > 0")
def bi_lookup(spark, sf):
    e = create_engine(spark, "go(X) ==> lookup('region') | out(X);")
    rows = [tuple(r) for r in table(spark, sf, "region", "r_regionkey", "r_name").collect()]
    e.register_function("size", python=len)
    e.add_rules("go(X) ==> count(size(lookup('region')));")
    e.assert_many([("region", r) for r in rows] + [("go", (1,))])
    return named(e.facts("count", 1), "n")


@query("SELECT p_partkey AS k, p_retailprice * 1.2 AS v FROM part WHERE p_size % 2 = 0")
def host_function(spark, sf):
    e = create_engine(spark, "part(K, _, S, P) ==> even(S) | out(K, taxed(P));", max_rule_firings=None)
    e.register_function("even", column=lambda x: x % 2 == 0, returns="boolean")
    e.register_function("taxed", column=lambda x: x * 1.2)
    e.assert_df("part", table(spark, sf, "part", *PARTS))
    return named(e.facts("out", 2), "k", "v")


# intervals


def order_intervals(spark, sf) -> DataFrame:
    o, c = table(spark, sf, "orders", "o_orderkey", "o_custkey"), table(spark, sf, "customer", "c_custkey", "c_nationkey")
    t = iv.create(F.col("o_orderkey") % 50, F.col("o_orderkey") % 50 + 1 + F.col("o_custkey") % 20)
    u = iv.create(F.col("c_custkey") % 40, F.col("c_custkey") % 40 + 1 + F.col("c_nationkey"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("k"), t.alias("t"), u.alias("u"))


INTERVALS_SQL = "i AS (SELECT o_orderkey AS k, o_orderkey % 50 AS b, o_orderkey % 50 + 1 + o_custkey % 20 AS e, c_custkey % 40 AS c, c_custkey % 40 + 1 + c_nationkey AS f FROM orders JOIN customer ON o_custkey = c_custkey)"
RELATION_SQL = "CASE WHEN e < c THEN '<' WHEN e = c THEN 'm' WHEN b < c AND e > c AND e < f THEN 'o' WHEN b < c AND e = f THEN 'fi' WHEN b < c AND e > f THEN 'di' WHEN b = c AND e < f THEN 's' WHEN b = c AND e = f THEN 'is' WHEN b = c AND e > f THEN 'si' WHEN b > c AND e < f THEN 'd' WHEN b > c AND e = f THEN 'f' WHEN b > f THEN '>' WHEN b = f THEN 'mi' ELSE 'oi' END"


@query(f"WITH {INTERVALS_SQL} SELECT k, {RELATION_SQL} AS r FROM i")
def allen_relation(spark, sf):
    return order_intervals(spark, sf).select("k", iv.find_relation(F.col("t"), F.col("u")).alias("r"))


ALLEN_SQL = {
    "before": "e < c", "after": "b > f", "meets": "e = c", "met_by": "b = f", "overlaps": "b < c AND e > c AND e < f", "overlapped_by": "b > c AND b < f AND e > f", "starts": "b = c AND e < f", "started_by": "b = c AND e > f",
    "during": "b > c AND e < f", "contains": "b < c AND e > f", "finishes": "b > c AND e = f", "finished_by": "b < c AND e = f", "equals": "b = c AND e = f",
    "abuts": "e = c OR b = f", "encloses": "b <= c AND e >= f", "enclosed_by": "b >= c AND e <= f",
}
for _name, _sql in ALLEN_SQL.items():

    def _allen(spark, sf, name=_name):
        return order_intervals(spark, sf).filter(iv.predicate(name, F.col("t"), F.col("u"))).select("k")

    QUERIES[f"allen_{_name}"], ORACLES[f"allen_{_name}"] = _allen, f"WITH {INTERVALS_SQL} SELECT k FROM i WHERE {_sql}"


def _ends(c, prefix: str) -> list:
    return [c["start"].alias(f"{prefix}b"), c["end"].alias(f"{prefix}e")]


@query(f"""WITH {INTERVALS_SQL} SELECT k, CASE WHEN e < c OR b > f THEN least(e, f) END AS gb, CASE WHEN e < c OR b > f THEN greatest(b, c) END AS ge, CASE WHEN e > c AND b < f THEN greatest(b, c) END AS ib, CASE WHEN e > c AND b < f THEN least(e, f) END AS ie,
least(b, c) AS sb, greatest(e, f) AS se, CASE WHEN e >= c AND b <= f THEN least(b, c) END AS ub, CASE WHEN e >= c AND b <= f THEN greatest(e, f) END AS ue FROM i""")
def interval_operations(spark, sf):
    df, t, u = order_intervals(spark, sf), F.col("t"), F.col("u")
    return df.select("k", *_ends(iv.gap(t, u), "g"), *_ends(iv.intersection(t, u), "i"), *_ends(iv.span(t, u), "s"), *_ends(iv.union(t, u), "u"))


@query(f"""WITH {INTERVALS_SQL} SELECT k, b AS pb, CASE WHEN e <= c OR b >= f THEN e ELSE least(e, c) END AS pe FROM i WHERE e <= c OR b >= f OR b < c UNION ALL SELECT k, greatest(b, f), e FROM i WHERE NOT (e <= c OR b >= f) AND e > f""")
def interval_minus(spark, sf):
    p = order_intervals(spark, sf).select("k", F.explode(iv.minus(F.col("t"), F.col("u"))).alias("p"))
    return p.select("k", *_ends(F.col("p"), "p"))


@query(f"""WITH {INTERVALS_SQL} SELECT k, b < c AND c < e AS chopped, CASE WHEN b < c AND c < e THEN c END AS at, greatest(b, least(e, c)) AS clamped, b <= c AND c <= e AS holds, b > c AS later, e < c AS earlier, b = c AS starts_at, e = c AS ends_at, CASE WHEN c < e THEN c END AS ws, CASE WHEN b < c THEN c END AS we, '[' || b || ', ' || e || ']' AS s FROM i""")
def interval_points(spark, sf):
    df = order_intervals(spark, sf)
    t, p = F.col("t"), F.col("u.start")
    cut = iv.chop(t, p)
    return df.select(
        "k", cut.isNotNull().alias("chopped"), F.get(cut, F.lit(1))["start"].alias("at"), iv.clamp(t, p).alias("clamped"), iv.contains_point(t, p).alias("holds"), iv.after_point(t, p).alias("later"), iv.before_point(t, p).alias("earlier"),
        iv.starts_at(t, p).alias("starts_at"), iv.ends_at(t, p).alias("ends_at"), iv.with_start(t, p)["start"].alias("ws"), iv.with_end(t, p)["end"].alias("we"), iv.to_string(t).alias("s"),
    )


_PAIR_SQL = "CASE WHEN {0}.e < {1}.b THEN '<' WHEN {0}.e = {1}.b THEN 'm' WHEN {0}.b < {1}.b AND {0}.e < {1}.e THEN 'o' WHEN {0}.b < {1}.b AND {0}.e = {1}.e THEN 'fi' WHEN {0}.b < {1}.b THEN 'di' WHEN {0}.b = {1}.b AND {0}.e < {1}.e THEN 's' WHEN {0}.b = {1}.b AND {0}.e = {1}.e THEN 'is' WHEN {0}.b = {1}.b THEN 'si' WHEN {0}.b > {1}.e THEN '>' WHEN {0}.b = {1}.e THEN 'mi' WHEN {0}.e < {1}.e THEN 'd' WHEN {0}.e = {1}.e THEN 'f' ELSE 'oi' END"


@query(f"""WITH p AS (SELECT a.range AS b, z.range AS e FROM range(6) a, range(6) z WHERE a.range < z.range), x AS (SELECT DISTINCT {_PAIR_SQL.format('t', 'u')} AS r1, {_PAIR_SQL.format('u', 'v')} AS r2, {_PAIR_SQL.format('t', 'v')} AS r FROM p t, p u, p v)
SELECT r1, r2, string_agg(r, ' ' ORDER BY r) AS c FROM x GROUP BY 1, 2""")
def allen_compose(spark, sf):
    pairs = spark.createDataFrame([(a, b) for a in iv.ORDER for b in iv.ORDER], "r1 string, r2 string")
    return pairs.select("r1", "r2", F.array_join(iv.composed(F.array("r1"), F.array("r2")), " ").alias("c"))


SPANS_SQL = "a AS (SELECT event_id AS i, user_id AS u, event_id % 1000 AS b, event_id % 1000 + 1 + user_id % 9 AS e FROM events WHERE event_type = 'view'), z AS (SELECT event_id AS j, user_id AS u, event_id % 1000 AS c, event_id % 1000 + 1 + user_id % 5 AS f FROM events WHERE event_type = 'purchase')"


@query(f"WITH {SPANS_SQL} SELECT i, j FROM a JOIN z ON b < c AND e > c AND e < f")
def interval_overlap_join(spark, sf):
    ev = table(spark, sf, "events", "event_id", "user_id", "event_type")
    b = F.col("event_id") % 1000
    a = ev.filter("event_type = 'view'").select(F.col("event_id").alias("i"), iv.create(b, b + 1 + F.col("user_id") % 9).alias("t"))
    z = ev.filter("event_type = 'purchase'").select(F.col("event_id").alias("j"), iv.create(b, b + 1 + F.col("user_id") % 5).alias("u"))
    return interval_join(a, z, "t", "u", {"o"}, 10).select("i", "j")


# store, history, trace


@query("SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n")
def store_size(spark, sf):
    e = solved(spark, "", {"nation": table(spark, sf, "nation", "n_nationkey", "n_name"), "region": table(spark, sf, "region", "r_regionkey")})
    return e.store.functors().agg(F.sum("n").alias("n"))


@query("SELECT 'nation' AS name, 2 AS arity, count(*) AS n FROM nation UNION ALL SELECT 'region', 1, count(*) FROM region")
def store_functors(spark, sf):
    return solved(spark, "", {"nation": table(spark, sf, "nation", "n_nationkey", "n_name"), "region": table(spark, sf, "region", "r_regionkey")}).store.functors()


@query("SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2")
def store_lookup_by_arg(spark, sf):
    return named(solved(spark, "", {"nation": table(spark, sf, "nation", "n_nationkey", "n_regionkey")}).store.lookup_by_arg("nation", 2, 1, 2), "k")


@query("SELECT 'lies' AS rule, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey")
def history_snapshot(spark, sf):
    e = solved(spark, "lies @ nation(N, R), region(R) ==> lies(N, R);", {"nation": table(spark, sf, "nation", "n_nationkey", "n_regionkey"), "region": table(spark, sf, "region", "r_regionkey")}, trace=True)
    return e.history_snapshot().groupBy("rule").agg(F.count_distinct("ids").alias("n"))


@query("SELECT 'even' AS rule, count(*) AS n FROM nation WHERE n_nationkey % 2 = 0")
def trace_counts(spark, sf):
    e = solved(spark, "even @ nation(N) ==> mod(N, 2) === 0 | even(N);", {"nation": table(spark, sf, "nation", "n_nationkey")}, trace=True)
    return spark.createDataFrame([(f.rule, f.count) for f in e.trace], "rule string, n long")


@query("SELECT n_nationkey::DOUBLE AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def incremental_assert(spark, sf):
    e = create_engine(spark, "lies @ nation(N, R), region(R, S) ==> lies(N, S);")
    rows = [tuple(r) for r in table(spark, sf, "nation", "n_nationkey", "n_regionkey").collect()]
    e.assert_many([("nation", r) for r in rows[:10]] + [("region", tuple(r)) for r in table(spark, sf, "region", "r_regionkey", "r_name").collect()])
    e.assert_many([("nation", r) for r in rows[10:]])
    return named(e.facts("lies", 2), "n", "r")


@query("SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE a.s_nationkey < 6")
def ids_of_many_partitions(spark, sf):
    """A symmetric self-join of facts from two batches of more partitions than a small range of ids could hold."""
    sup = table(spark, sf, "supplier", "s_suppkey", "s_nationkey").filter("s_nationkey < 6")
    e = create_engine(spark, "sup(S, N), sup(T, N) ==> pair(min(S, T), max(S, T));", max_rule_firings=None)
    for odd in (0, 1):
        e.assert_df("sup", sup.filter(F.col("s_suppkey") % 2 == odd).repartition(150, "s_suppkey"), run=False)
    e.run()
    return e.facts("pair", 2).select(F.col("a0").cast("long").alias("x"), F.col("a1").cast("long").alias("y"))


@query("SELECT 1 AS arity, count(*) AS n FROM region UNION ALL SELECT 2, count(*) FROM nation")
def store_lookup_name(spark, sf):
    e = create_engine(spark, max_rule_firings=None)
    e.assert_df("place", table(spark, sf, "region", "r_regionkey"))
    e.assert_df("place", table(spark, sf, "nation", "n_nationkey", "n_name"))
    e.assert_df("other", table(spark, sf, "region", "r_name"))
    return e.store.lookup_name("place").groupBy("arity").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS k, l_quantity AS q FROM lineitem WHERE l_quantity > 48 AND l_orderkey % 2 = 0")
def store_find(spark, sf):
    e = solved(spark, "", {"item": table(spark, sf, "lineitem", "l_orderkey", "l_quantity")})
    return named(e.store.find("item", 2, (F.col("a1") > 48) & (F.col("a0") % 2 == 0)), "k", "q")


@query("SELECT true AS has, false AS other, true AS all_alive, false AS beyond, n_name AS name FROM nation ORDER BY n_nationkey LIMIT 1")
def store_points(spark, sf):
    """get, has and all_alive by id."""
    store = solved(spark, "", {"nation": table(spark, sf, "nation", "n_nationkey", "n_name")}).store
    first = store.lookup("nation", 2).first()
    name = __import__("json").loads(store.get(first["cid"])["args"][1])["v"]
    row = (store.has(first["cid"]), store.has(store.next_id), store.all_alive([first["cid"], first["cid"] + 1]), store.all_alive([first["cid"], store.next_id]), name)
    return spark.createDataFrame([row], "has boolean, other boolean, all_alive boolean, beyond boolean, name string")


@query("SELECT n_nationkey AS k FROM nation WHERE n_nationkey <> (SELECT min(n_nationkey) FROM nation)")
def store_remove(spark, sf):
    store = solved(spark, "", {"nation": table(spark, sf, "nation", "n_nationkey").withColumn("id", F.col("n_nationkey").cast("long"))}, key="id").store
    store.remove(store.lookup("nation", 1).first()["cid"])
    return named(store.frame(("nation", 1)), "k")


@query("SELECT p_partkey AS k, p_size::DOUBLE * 2 + 1 AS v FROM part WHERE NOT p_size > 10")
def let_and_not(spark, sf):
    rules = "part(K, S) ==> !(S > 10) | let T = S * 2, out(K, T + 1);"
    return named(solved(spark, rules, {"part": table(spark, sf, "part", "p_partkey", "p_size")}).facts("out", 2), "k", "v")


@query("SELECT p_partkey AS k, p_retailprice * 1.2 AS v FROM part WHERE p_size % 2 = 0")
def host_module(spark, sf):
    """A module's functions, imported by name, and declarations that are checked."""
    functions = {"even": HostFunction(column=lambda x: x % 2 == 0, returns="boolean", arity=1), "taxed": HostFunction(column=lambda x: x * 1.2, arity=1)}
    source = "import host shop; function even/1; constraint part/3; part(K, S, P) ==> even(S) | out(K, taxed(P));"
    e = create_engine(spark, source, modules=(define_host_module("shop", functions),), max_rule_firings=None, strict=True)
    e.assert_df("part", table(spark, sf, "part", "p_partkey", "p_size", "p_retailprice"))
    return named(e.facts("out", 2), "k", "v")


@query("SELECT 'seen' AS action, n_nationkey AS k FROM nation WHERE n_regionkey = 1")
def action_log(spark, sf):
    """What rules ask the host to do, as a frame; a registered handler hears of each."""
    heard: list = []
    e = create_engine(spark, "nation(N, 1) ==> !seen(N);", max_rule_firings=None)
    e.register_action("seen", heard.append)
    e.assert_df("nation", table(spark, sf, "nation", "n_nationkey", "n_regionkey"))
    return spark.createDataFrame([("seen", int(k)) for k in heard], "action string, k int")


@query("SELECT 'added' AS what, 'lies' AS name, count(*) AS n FROM nation UNION ALL SELECT 'added', 'nation', count(*) FROM nation UNION ALL SELECT 'removed', 'nation', count(*) FROM nation")
def store_hooks(spark, sf):
    """Hooks hear of facts that are asserted, derived and removed by rules."""
    heard: list = []
    e = create_engine(spark, "nation(N) <=> lies(N);", max_rule_firings=None)
    e.store.on_add.append(lambda f, df: heard.append(("added", f[0], df.count())))
    e.store.on_remove.append(lambda f, df: heard.append(("removed", f[0], df.count())))
    e.assert_df("nation", table(spark, sf, "nation", "n_nationkey"))
    return spark.createDataFrame(heard, "what string, name string, n long")

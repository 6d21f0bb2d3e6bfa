"""Order MinHash classes against all pairs, and the alignment against the plain recurrence."""

import itertools
import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.llm import neardup
from emberline.llm.common import Words, released


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 9))
def test_alignment(a, b, most):
    d = distance(a, b)
    expected = d if d <= most else None
    assert neardup.banded_distance(a, b, most) == neardup.by_diagonals(a, b, most) == neardup.by_bits(a, b, most) == expected if abs(len(a) - len(b)) <= most else expected is None


@pytest.mark.parametrize("most", [3, 20, 70, 200])
def test_alignment_of_long_texts(most):
    rng = random.Random(most)
    for n in (1, 63, 64, 65, 130, 400):
        a = rng.choices(range(30), k=n)
        for edits in (0, most // 2, most, most + 5, 3 * most):
            b = [int(x[1:]) + 100 if isinstance(x, str) else x for x in edited(rng, a, min(edits, n - 1))]
            d = distance(a, b)
            assert neardup.by_bits(a, b, most) == neardup.by_bits(b, a, most) == (d if d <= most else None)
            assert neardup.banded_distance(a, b, most) == (d if d <= most else None)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k, i = rng.random(), rng.randrange(len(words))
        if k < 0.4:
            words[i] = f"e{rng.randrange(10**6)}"
        elif k < 0.7:
            words.insert(i, f"i{rng.randrange(10**6)}")
        else:
            del words[i]
    return words


def plain(rows):
    ids = sorted({i for i, t in rows if t is not None})
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    rows = [(i, t, t.split()) for i, t in rows if t is not None]
    for x, (i, s, a) in enumerate(rows):
        for j, t, b in rows[:x]:
            if s == t or (a and b and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and distance(a, b) <= neardup.allowed(len(a), len(b), 0.8)):
                u, v = root(i), root(j)
                parent[max(u, v)] = min(u, v)
    return {i: root(i) for i in ids}


def test_classes(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    rows, line = [], "the same passage opens many of these texts and is quite common".split()
    for _ in range(12):
        seed = rng.choices(vocab, k=rng.randint(40, 120))
        for _ in range(rng.randint(1, 7)):
            rows.append(" ".join(edited(rng, seed, rng.randint(0, max(1, len(seed) // 25)))))
    rows += [" ".join(line + rng.choices(vocab, k=30)) for _ in range(25)]
    chain = rng.choices(vocab, k=100)
    for _ in range(6):  # neighbours are alike, the ends are not
        rows.append(" ".join(chain))
        chain = edited(rng, chain, 7)
    rows += ["", "", "  ", "two words", "two words", "two  words", rows[0], rows[0], None, None]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    expected = plain(rows)
    assert {i: c for i, c in found.items() if rows[i][1] is not None} == expected
    assert all(found[i] == i for i, t in rows if t is None)
    kept = [r.doc_id for r in neardup.one_of_each(df).collect()]
    assert sorted(kept) == sorted({*expected.values(), *(i for i, t in rows if t is None)})
    assert neardup.classes(df.limit(0)).count() == 0


def test_shared_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(5, a), (5, b), (2, a), (1, b), (9, "c"), (None, a)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in neardup.classes(df).collect()) == [(0, 0), (1, 1), (2, 1), (5, 1), (5, 1), (9, 9)]


def test_rows_of_distinct_ids_stay_where_they_are(spark):
    """The first of each class is found by ids alone: no row is shuffled or sorted with its text, unless another one has its id."""
    rows = [(i, " ".join(f"{'c' if i % 5 == 0 else i}x{j}" for j in range(30)), i) for i in range(40)]
    df = spark.createDataFrame([*rows, (None, "no id", 99)], "doc_id long, text string, n int")
    one = neardup.one_of_each(df)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan
    firsts = [r for r in rows if r[0] % 5 or not r[0]]
    assert sorted((tuple(r) for r in one.collect()), key=lambda r: r[2]) == [*firsts, (None, "no id", 99)]
    several = neardup.one_of_each(df.unionByName(spark.createDataFrame([rows[1], (2, "of its own", 41), rows[5]], df.schema)))
    assert sorted((tuple(r) for r in several.collect()), key=lambda r: r[2]) == [*firsts, (2, "of its own", 41), (None, "no id", 99)]


def pairs_at(rng, n, share, spread, count=40):
    """Texts of n words and versions with ``share`` of the words changed, all at the same distance or at random places, some by insertion and deletion."""
    e = int(share * n + 1e-9)
    for i in range(count):
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        if spread:
            b = list(a)
            for j in range(e):
                b[(2 * j + 1) * n // (2 * e)] = f"s{rng.randrange(10**6)}"
        elif i % 2:
            b = list(a)
            for j in rng.sample(range(n), e):
                b[j] = f"s{rng.randrange(10**6)}"
        else:
            b = edited(rng, a, e)
        if neardup.alike(a, b, 0.8):
            yield a, b


@pytest.mark.parametrize("n", [5, 6, 9, 10, 15, 20, 30, 50, 52, 53, 60, 66, 100, 200])
def test_recall(n):
    rng, pairs = random.Random(n), []
    for share in (0.1, 0.15, 0.2):
        for spread in (False, True):
            pairs += pairs_at(rng, n, share if share * n >= 1 else 0.2, spread)
    words = Words(pa.array([" ".join(t) for p in pairs for t in p]))
    keys, at = neardup.candidate_keys(words, words.hashes(), neardup.SKETCHES, 0.8)
    sets = [set(keys[i:j].tolist()) for i, j in itertools.pairwise(at)]
    found = sum(not a.isdisjoint(b) for a, b in zip(sets[::2], sets[1::2], strict=True)) / len(pairs)
    print(n, len(pairs), found)
    assert len(pairs) > 150 and (found == 1 if n <= neardup.SHORT else found >= 0.99)


def test_sparse_edits_are_joined(spark):
    rng, rows = random.Random(5), []
    for n in (5, 10, 20, 50, 200):
        for a, b in pairs_at(rng, n, 0.2, True, 8):
            rows += [" ".join(a), " ".join(b)]
    rows = list(enumerate(rows))
    found = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == plain(rows)


def test_texts_of_a_common_passage_meet_once(spark, monkeypatch):
    rng, rows, sent = random.Random(11), [], []
    line = [f"p{i}" for i in range(40)]
    for _ in range(40):  # over half of each text is common, which makes it a candidate of all others, but not similar
        own = [f"x{rng.randrange(10**6)}" for _ in range(30)]
        rows.append(" ".join(line + own))
    late = [f"y{i}" for i in range(30)]
    rows += [" ".join(line + late), " ".join(line + edited(rng, late, 5))]
    rows = list(enumerate(rows))
    plainly = neardup.unresolved
    monkeypatch.setattr(neardup, "MANY", 8, raising=False)
    monkeypatch.setattr(neardup, "unresolved", lambda found, *rest: sent.append(found.count()) or plainly(found, *rest))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == plain(rows)
    assert sent[0] < 6 * len(rows)  # 470 when each bucket stood alone
    # With tiles of few texts one bucket for all would take more rows than the buckets do, so these stay; the classes are the same.
    monkeypatch.setattr(neardup, "TILE", 2)
    assert {r.doc_id: r.class_id for r in neardup.classes(df).collect()} == plain(rows)


def test_fine_signatures_bound_the_distance():
    rng = random.Random(12)
    line = "the line that comes again and again".split()
    texts = []
    for _ in range(12):  # a word occurs over 255 times; the rest differs
        own = [f"z{rng.randrange(10**6)}" for _ in range(120)]
        texts.append(line * 300 + own)
        texts.append(edited(rng, texts[-1], 30))
    words = Words(pa.array([" ".join(t) for t in texts]))
    wide, coarse = (f(words, words.hashes(), len(texts)) for f in (neardup.wide_counts, neardup.signatures))
    coarse = coarse[:, neardup.BITS // 8 :]
    for i in range(0, len(texts), 2):
        assert neardup.least_distance(wide[i], wide[i + 1]) <= 30
        assert neardup.least_distance(wide[i], wide[i - 2]) > neardup.least_distance(coarse[i], coarse[i - 2])


def test_workers_give_back_what_they_took(spark):
    """The workers stay for later stages; after the sketches of 13 MB of text none holds free memory."""
    words = F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.hash(i, "doc_id").cast("string"))
    docs = spark.range(600).withColumnRenamed("id", "doc_id").select("doc_id", F.array_join(words, " ").alias("text")).repartition(2)
    assert neardup.sketched(docs, "doc_id", "text").count() == 600

    def free(batches):
        held = lambda: sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
        for _ in batches:
            before = held()
            released()
            yield pa.RecordBatch.from_pydict({"mb": [before - held()]})

    found = spark.range(64, numPartitions=64).mapInArrow(free, "mb double").collect()  # in turn, each idle worker gets a task
    assert max(r.mb for r in found) < 15  # 3; without giving back 28

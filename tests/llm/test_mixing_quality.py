"""Mixing and quality rules against plain versions."""

import hashlib
import random
import re

import pytest

from emberline.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Shares by weight, an excess over three times a source's size reshared until there is none."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def documents():
    rng = random.Random(12)
    rows = []
    for i in range(300):
        source = rng.choice(["a", "b", "ü", "Z", None] + ["hot"] * 6) if i % 40 else "tiny"
        rows.append((i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 40))), source))
    return rows + [(300, None, "a"), (301, "  ", "empty"), (7, rows[7][1], rows[7][2]), (None, "one two", "b")]


def test_mix(spark):
    rows = documents()
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int").repartition(4)
    size = lambda t: len(WORD.findall(t or ""))
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    found = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(2)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again)) and len(found) == len(rows)
    target = plain_targets(sizes)
    source_of = {i: s for i, _, s in rows}
    longest, taken = {}, {}
    for r in found:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size and list(r.positions) == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions)
        taken[s], longest[s] = taken.get(s, 0) + r.taken, max(longest.get(s, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest[s], s
    copies = mixing.mix(df, carry=True)
    assert copies.columns == ["doc_id", "text", "source", "size", "position"]
    assert sum(size(r.text) for r in copies.collect()) == sum(r.taken for r in found)
    assert mixing.mix(df.limit(0)).count() == 0
    key = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    hot = sorted((r for r in found if source_of[r.doc_id] == "hot"), key=lambda r: key(r.doc_id))
    passes = [len(r.positions) for r in hot if r.size]
    assert passes == sorted(passes, reverse=True)


def plain_measures(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a " * 30, "word " * 8, "LOUD NOISE " * 30, "# $ % & " * 20, "same line of words\n" * 12, "\x0b\x0c\r x"]
    for _ in range(60):
        part = [rng.choice(["alpha", "beta", "gamma", "é", "🙂", "#x"]) + str(rng.randrange(60)) for _ in range(rng.randint(5, 60))]
        words = part + (part[:12] if rng.random() < 0.5 else []) + (part[3:20] if rng.random() < 0.3 else [])
        texts.append("".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = quality.measured(df)
    rows = out.collect()
    kept = set()
    for r in rows:
        n, chars, symbols, dup, rep = plain_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), texts[r.doc_id]
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n) and not (r.base_failed and r.kept)
        kept |= {r.doc_id} if r.kept else set()
    assert sorted(r.doc_id for r in quality.passed(df).collect()) == sorted(kept) and kept
    assert quality.passed(df.limit(0)).count() == 0


def test_order_does_not_matter(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("ok " * 10,), ("#" * 9,), (None,)], "text string")
    text = F.coalesce("text", F.lit(""))
    rules = quality.standard_rules(text)
    names = list(rules)
    first = df.select(quality.verdict(rules, names)).collect()
    assert first == df.select(quality.verdict(rules, names[::-1])).collect() or [r[0] for r in first] == [r[0] for r in df.select(quality.verdict(rules, names[::-1])).collect()]
    assert sorted(quality.cascade(df, rules)) == sorted(names)

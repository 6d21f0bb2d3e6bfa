"""Repeated passages against a plain search over all windows."""

import random

import pytest

from emberline.llm import substring


def plain(rows, window):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        out[i] = (b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode(), len(words), sum(gone))
    return out


def test_against_plain(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("ab") * rng.randint(1, 9) + rng.choice(["", "é", "x"])
    passages = [[word() for _ in range(rng.randint(18, 70))] for _ in range(12)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, 15)
            words += p[a : a + rng.randint(10, 60)] if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 40))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(150, None), (151, ""), (152, rows[3][1]), (153, rows[3][1]), (154, "w " * 200)]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, chunk string, n_words int").repartition(5)
    found = substring.without_repeats(df)
    assert found.columns == ["doc_id", "text", "chunk", "n_words", "n_removed", "removed_spans"]
    expected = plain(rows, 20)
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.n_words, r.n_removed) == expected[r.doc_id], r.doc_id
        assert sum(s.end - s.start for s in r.removed_spans) == r.n_removed and r.chunk == "x"
    assert substring.without_repeats(df.limit(0)).count() == 0


def test_equal_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    assert sorted((r.doc_id or 9, r.n_removed) for r in substring.without_repeats(df).collect()) == [(1, 0), (1, 30), (9, 30)]


def test_words_made_to_collide_and_clashing_names(spark):
    """Two words of 2048 bytes that every polynomial hash modulo 2**64 takes for equal; columns named alike but for case; texts as ids."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rest = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([one, *rest]), 5, "k"), (2, " ".join([two, *rest]), 6, "l"), (3, " ".join([one, *rest]) + " tail", 7, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_Words int, Chunk string")
    found = {r.doc_id: r for r in substring.without_repeats(df).collect()}
    assert [(found[i].n_words, found[i].n_removed, found[i].Chunk) for i in (1, 2, 3)] == [(20, 0, "k"), (20, 0, "l"), (21, 20, "m")]
    with pytest.raises(TypeError):
        substring.without_repeats(df.withColumn("doc_id", df.text))


def test_one_passage_everywhere(spark):
    """A passage of every document and many times in one: of each chunk one occurrence goes to the bucket."""
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(i, f"{passage} own{i} {passage}" if i % 3 else f"own{i} {passage}") for i in range(200)] + [(500, f"{passage} " * 300)]
    expected = plain(rows, 20)
    for r in substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r.text, r.n_words, r.n_removed) == expected[r.doc_id], r.doc_id


def test_packets_compress():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    n = 20_000  # rows of windows: a hash, ascending ids and ascending places
    h = rng.integers(0, 1 << 63, n, np.uint64)
    ids = np.sort(rng.integers(-(1 << 20), 1 << 24, n)).astype(np.int64)
    ids[-3:] = np.iinfo(np.int64).max
    places = np.sort(rng.integers(0, 1 << 19, n)).astype(np.uint32)
    buckets = rng.integers(0, 5, n)
    found = list(substring.packed(buckets, 6, h, ids, places))
    for b, payload in found:
        for got, sent in zip(substring.unpacked(payload, np.uint64, np.int64, np.uint32), (h, ids, places), strict=True):
            assert got.dtype == sent.dtype and (got == sent[buckets == b]).all()
    assert [b for b, _ in found] == list(range(5))
    assert sum(len(pa.Codec("lz4").compress(p)) for _, p in found) < 15 * n  # 20 bytes a row as rows of values

"""Byte-level BPE against tiktoken."""

import random

import public_tokenizers
import tiktoken

from emberline.llm import bpe, queries
from pyspark.sql import functions as F


def test_as_tiktoken(spark):
    ranks = queries.byte_ranks(spark)
    import base64

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.vocabulary(), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    rng = random.Random(2)
    letters = "abcdefghijklmnop éèßäöü ÉñÑ ΑΩ 漢字 🙂🎉 \n\t  .,!?'s't#$%0123456789  ́"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 120))) for _ in range(60)]
    texts += ["", None, " ", "  \n ", "don't they'll we've", "<|endoftext|> hello", "a" * 500, "The quick brown fox.  Twice", "The quick brown fox.  Twice", "x\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for hot in (0, 40):
        rows = ranks.with_decoded(bpe.encoded(df, ranks, hot=hot), "text").collect()
        assert len(rows) == len(texts)
        for r in rows:
            t = texts[r.doc_id] or ""
            assert list(r.ids) == plain.encode_ordinary(t), repr(t)
            assert bytes(r.text) == t.encode()


def test_long_words_and_slices(spark):
    """Words over the fold's length go through the heap; a text of one word of a million letters ends."""
    import base64

    ranks = queries.byte_ranks(spark)
    table = ranks.table
    assert table == {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.vocabulary(), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeinorst", k=k)) for k in (1, 2, 3, 17, 127, 128, 129, 5000)] + ["ab" * 400, "a" * 3000, "é" * 600]
    for w in words:
        assert bpe.heap_ids(w.encode(), table) == plain.encode_ordinary(w)
    texts = [" ".join(words), "x " + "".join(rng.choices("etaoinshr", k=1_000_000)), *words]
    df = spark.createDataFrame([(i, t, 7, 8) for i, t in enumerate(texts)], "doc_id long, text string, IDS int, `words` int").repartition(2)
    rows = ranks.with_decoded(bpe.encoded(df, ranks, hot=3)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        assert list(r.ids) == plain.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded) == texts[r.doc_id].encode()


def test_runs_of_words():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([["a"] * n for n in (3, 0, 9, 1, 1, 4)])], ["key", "words"])
    parts = list(bpe.slices_of(batch.slice(1), 1, 4))
    assert [p.column(0).to_pylist() for p in parts] == [[1], [2], [3, 4], [5]]
    assert not list(bpe.slices_of(batch.slice(6), 1, 4))


def test_shared_ids_and_empty(spark):
    ranks = queries.byte_ranks(spark)
    df = spark.createDataFrame([(1, "one text"), (1, "other text"), (1, "one text"), (None, "third")], "doc_id long, text string")
    rows = ranks.with_decoded(bpe.encoded(df, ranks, hot=1)).select("doc_id", F.col("decoded").cast("string").alias("t")).collect()
    assert sorted((r.doc_id or 0, r.t) for r in rows) == [(0, "third"), (1, "one text"), (1, "one text"), (1, "other text")]
    assert bpe.encoded(df.limit(0), ranks).count() == 0


def test_the_vocabulary_is_not_spelled_out_in_plans(spark):
    ranks = queries.byte_ranks(spark)
    df = spark.createDataFrame([(1, "one rather unusual word: zyxwvutrq")], "doc_id long, text string")
    ids = bpe.encoded(df, ranks, hot=0)
    described = spark._jvm.PythonSQLUtils.explainString(ids._jdf.queryExecution(), "formatted")
    assert len(described) < 50_000  # 750,000 with the pairs of the vocabulary as a literal
    assert "subquery" in described
    assert ranks.with_decoded(ids).first().decoded == b"one rather unusual word: zyxwvutrq"


def test_joined_bytes_and_numbers():
    import numpy as np
    import pyarrow as pa

    parts = pa.array([b"a", b"", b"\xff\x00", b" 12"], pa.large_binary())
    lists = pa.array([[9], [3, 0], [], [1], [2, 2, 0]], pa.list_(pa.int32())).slice(1)
    ends, data = bpe.joined(lists, parts)
    assert [bytes(data[a:b]) for a, b in zip(ends, ends[1:])] == [b" 12a", b"", b"", b"\xff\x00\xff\x00a"]
    for empty in (lists.slice(1, 1), lists.slice(0, 0)):
        ends, data = bpe.joined(empty, parts)
        assert ends.tolist() == [0] * (len(empty) + 1) and not len(data)
    for n in (0, 4):
        known = pa.array(["the", " of", "é", "x"][:n], pa.string())
        words = pa.array(["x", "the", "thé", "x", " of", ""])
        assert bpe.numbered(words, known).tolist() == ([3, 0, -1, 3, 1, -1] if n else [-1] * 6)
        assert bpe.numbered(words.slice(0, 0), known).tolist() == []
        assert bpe.numbered(words.slice(1, 2), known).dtype == np.int64


def grown(run) -> float:
    """MB that ``run`` prints, in a fresh process."""
    import os
    import subprocess
    import sys
    import textwrap

    code = """
import re, sys, threading, time
import numpy as np, pyarrow as pa
from emberline.llm import bpe, common
held = lambda: sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
""" + textwrap.dedent(run)
    path = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    return float(subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True, check=True, timeout=120).stdout)


PEAK = """
common.released()
most, ended, before = [0.0], [], held()
def watch():
    while not ended:
        most[0] = max(most[0], held())
        time.sleep(0.001)
t = threading.Thread(target=watch)
t.start()
work()
ended.append(1)
t.join()
print(most[0] - before)
"""


def test_memory_of_a_worker():
    """Joining takes little more than the bytes joined, known words cost no table of their own, and a worker that waits holds nothing free."""
    lists = """
rng = np.random.default_rng(1)
lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 500_001, 500, dtype=np.int32)), pa.array(rng.integers(0, 50_000, 500_000).astype(np.int32)))
table = bpe.numerals(50_000)
def work():
    for _ in range(5): bpe.joined(lists, table)
"""
    assert grown(lists + PEAK) < 25  # 7; by places of single bytes 56
    known = """
known = pa.array([f" word{i}" for i in range(500_000)])
words = pa.array([f" word{i % 20_000 * 30}" for i in range(500_000)])
def work():
    for _ in range(5): bpe.numbered(words, known)
"""
    assert grown(known + PEAK) < 22  # 13; with a table of the known words 33
    waits = """
def run(batches):
    for _ in batches:
        yield bpe.numbered(pa.array([f" word{i}" for i in range(500_000)]), pa.array(["x"]))
for _ in common.lean(run)([0]): pass
del _
common.released()
before = held()
for _ in common.lean(run)([0, 1]): pass
del _
print(held() - before)
"""
    assert grown(waits) < 20  # 2; without giving back 63

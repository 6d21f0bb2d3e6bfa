"""The pipeline's stages, one after another, against plain versions of each."""

import base64
import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from emberline.llm import queries

from .test_mixing_quality import plain_measures, plain_targets
from .test_neardup import edited
from .test_neardup import plain as plain_classes
from .test_substring import plain as plain_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(21)
    vocab = [f"{rng.choice('abcdefgh')}{rng.choice(['ing', 'er', 'tion', 'é'])}{i}" for i in range(500)]
    passage = rng.choices(vocab, k=40)
    rows = []
    for i in range(24):
        words = rng.choices(vocab, k=rng.randint(30, 70))
        rows.append(" ".join(words))
        if i % 4 == 0:
            rows += [" ".join(edited(rng, words, 2)), " ".join(words)]
        if i % 5 == 0:
            rows.append(" ".join(rng.choices(vocab, k=15) + passage + rng.choices(vocab, k=15)))
    rows += [None, "", "too short", "SHOUTING WORDS " * 20, "# $ % " * 20, "say it again and again now please friend " * 6]
    return [(i, t, "en", rng.choice(["s1", "s1", "s2", "s3", None]), len(t or "")) for i, t in enumerate(rows)]


def plain_quality(text):
    n, chars, symbols, dup, rep = plain_measures(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    letters, capitals = sum(c.isalpha() for c in text or ""), sum(c.isupper() for c in text or "")
    return not (n < 20 or 100 * rep > 30 * n or 10 * symbols > n or 100 * dup > 30 * len(lines) or chars < 2 * n or chars > 15 * n or 2 * capitals > letters or 2 * letters < chars)


def test_stages(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = {r[0]: r for r in rows if plain_quality(r[1])}
    classes = plain_classes([(i, r[1]) for i, r in docs.items()])
    docs = {i: docs[i] for i in set(classes.values())}
    texts = {i: t for i, (t, _, _) in plain_repeats([(i, r[1]) for i, r in docs.items()], 20).items() if t}
    source, size = {i: docs[i][3] for i in texts}, {i: len(WORD.findall(t)) for i, t in texts.items()}
    sizes = Counter()
    for i in texts:
        sizes[source[i]] += size[i]
    target, copies = plain_targets(dict(sizes)), Counter()
    for s in sizes:
        before = 0
        for i in sorted((i for i in texts if source[i] == s), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
            copies[i] = sum(r * sizes[s] + before + size[i] / 2 <= target[s] for r in range(3))
            before += size[i]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.vocabulary(), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for i, n in copies.items():
        ids = plain.encode_ordinary(texts[i])
        expected += [(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())] * n
    assert len(docs) < len(rows) - 8 and expected
    found = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(expected)
    columns = df.columns
    stage = df
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == columns and stage.dtypes == df.dtypes


def test_empty_and_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    prose = " ".join(f"plain{i} words" for i in range(30))
    rows = [(None, prose, None, None, None), (1, None, "en", "a", 0), (2, prose, "en", None, 0), (2, prose, "en", None, 0), (3, f"{prose} and some more of it", None, "a", None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r.doc_id for r in found} <= {None, 2} and any(r.doc_id == 2 for r in found)

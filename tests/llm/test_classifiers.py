"""The chain against enumeration, the index against brute force, and both classifiers on small texts."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from emberline.llm import langid, toxicity
from emberline.llm.common import Words, window_hashes


def test_words():
    texts = ["a b", "", None, "  é\tx\n", "w", "end "]
    words = Words(pa.array(texts))
    assert words.counts().tolist() == [len((t or "").encode().split()) for t in texts]
    assert [bytes(x.as_py()) for x in words.array()] == [w for t in texts for w in (t or "").encode().split()]
    h = Words(pa.array(["one two one two three one two"])).hashes()
    assert h[0] == h[2] == h[5] and len(set(h.tolist())) == 3
    w = window_hashes(h, 2)
    assert w[0] == w[2] == w[5] and len(set(w.tolist())) == 4 and len(window_hashes(h, 8)) == 0


@pytest.mark.parametrize("span", [1, 2, 3, 50])
def test_forward_backward(monkeypatch, span):
    monkeypatch.setattr(langid, "SPAN", span)
    rng = np.random.default_rng(span)
    k, counts = 3, [4, 0, 1, 6]
    offsets = np.concatenate([[0], np.cumsum(counts)])
    scores, t = rng.normal(size=(offsets[-1], k)), rng.normal(size=(k, k))
    marginal, moves = langid.forward_backward(scores, offsets, t)
    expected, expected_moves = np.zeros_like(scores), np.zeros((k, k))
    for a, b in itertools.pairwise(offsets):
        if a == b:
            continue
        weights = {}
        for labels in itertools.product(range(k), repeat=b - a):
            for before in range(k):
                path = (before, *labels)
                weights[path] = np.exp(sum(scores[a + i, y] for i, y in enumerate(labels)) + sum(t[x, y] for x, y in itertools.pairwise(path)))
        total = sum(weights.values())
        for path, w in weights.items():
            for i, y in enumerate(path[1:]):
                expected[a + i, y] += w / total
            for x, y in itertools.pairwise(path):
                expected_moves[x, y] += w / total
    assert np.allclose(marginal, expected) and np.allclose(moves, expected_moves)


def test_language(spark):
    rng = random.Random(1)
    made = {"aa": ["tha", "the", "wis"], "bb": ["eau", "oui", "que"]}
    text = lambda lang, n: " ".join("".join(rng.choices(made[lang], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(lang := "ab"[i % 2] * 2, rng.randint(3, 60)), lang if i % 7 else None) for i in range(120)]
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "12 34 !!", "aa"), (203, text("aa", 40) + " " + text("bb", 40), None), (0, rows[0][1], "aa"), (None, text("aa", 9), "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.learned(langid.training_rows(df), per_lang=30)
    found = langid.labelled(df, model).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert all(by_id[i].lang_pred == "ab"[i % 2] * 2 for i in range(120))
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (200, 201, 202))
    assert {r.lang for r in by_id[203].runs} == {"aa", "bb"} and by_id[203].runs[0].lang == "aa"
    assert langid.labelled(df.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.labelled(df, langid.learned(df.limit(0))).collect()} == {"und"}


def test_nearest_is_exact():
    rng = random.Random(6)
    vectors = []
    for _ in range(500):
        v = {t: rng.random() for t in rng.sample(range(40), rng.randint(0, 6))}
        size = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / size for t, x in v.items()} if v else {})
    index = toxicity.Index(vectors, 40)
    near = lambda qs, k, **o: index.nearest([(t := np.array(sorted(q), np.int64), np.array([q[i] for i in t])) for q in qs], k, **o)
    for k in (1, 7, 600):
        for found, q in zip(near(vectors[:60], k), vectors[:60], strict=True):
            scores = sorted((-round(sum(w * v.get(t, 0) for t, w in q.items()), 9), i) for i, v in enumerate(vectors))
            assert [(i, -s) for i, s in zip(*found, strict=True)] == [(i, s) for s, i in scores if s < 0][:k]
    for i, (ids, _) in enumerate(near(vectors[:60], 7, without=np.arange(60))):
        assert i not in ids
    assert index.nearest([], 3) == []


def test_toxicity(spark):
    rng = random.Random(8)
    vocab, bad = [f"w{i}" for i in range(200)], ["nasty", "vile", "awful", "rotten"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = rng.choices(vocab, k=30) + (rng.choices(bad, k=8) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = spark.createDataFrame([*labels, (5000, 1), (3, None)], "doc_id long, toxic int")
    found = toxicity.scored(docs, toxicity.trained(docs, table.filter(~toxicity.held_out()))).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert all((r.score >= 0.3) == (r.doc_id % 4 == 0 and r.doc_id < 400) for r in found)
    assert all(len(r.evidence) > 0 for r in found if r.score >= 0.3)
    none = toxicity.trained(docs, table.limit(0))
    assert len({r.score for r in toxicity.scored(docs, none).collect()}) == 1


def test_rare_terms_count(spark):
    """Each of the toxic words is in two examples of 200; none has a high chi-square."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocab, k=20) + ([f"{i // 2 % 50}bad", f"{i // 2 % 50}evil"] if i % 2 else []))) for i in range(200)]
    rows.append((900, "7bad 7evil"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.trained(docs, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int"))
    assert {w[:4] for _, t in rows for w in t.split()} == set(model.terms)
    row = toxicity.scored(docs.filter("doc_id = 900"), model).first()
    assert {e.id for e in row.evidence} == {15, 115} and row.score >= 0.3


def test_evidence_by_brute_force(spark):
    """All neighbours that vote, against plain TF-IDF cosines over all terms; ties, repeated rows, nulls and clashing columns included."""
    rng = random.Random(10)
    vocab = [f"{i}Wört{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 25))) for _ in range(120)]
    texts += [texts[0], texts[0], "", None, "unheard of", " ".join(vocab * 500)]
    rows = [(i, t, i, "x") for i, t in enumerate(texts)] + [(None, texts[5], 0, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, SCORE long, evidence string").repartition(3)
    labels = [(i, i % 3 == 0) for i in range(0, 122, 2)]
    model = toxicity.trained(docs, spark.createDataFrame([(i, int(y)) for i, y in labels], "doc_id long, toxic int"))
    terms = lambda t: Counter(w[:4] for w in (t or "").lower().split())
    df = Counter(w for r in rows for w in terms(r[1]))
    known = {w for i, _ in labels for w in terms(texts[i])}

    def vector(t):
        v = {w: (1 + math.log(n)) * (math.log((len(rows) + 1) / (df[w] + 1)) + 1e-3) for w, n in terms(t).items() if w in known}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = {i: vector(texts[i]) for i, _ in labels}
    found = toxicity.scored(docs, model).collect()
    assert len(found) == len(rows)
    for r in found:
        q = vector(texts[5] if r.doc_id is None else texts[r.doc_id])
        cosine = {i: sum(x * v.get(w, 0) for w, x in q.items()) for i, v in vectors.items()}
        best = sorted((c for c in cosine.values() if c > 0), reverse=True)[: toxicity.NEIGHBOURS]
        assert [e.similarity for e in r.evidence] == pytest.approx(best, abs=1e-8)
        assert [cosine[e.id] for e in r.evidence] == pytest.approx(best, abs=1e-8) and all(e.label == (e.id % 3 == 0) for e in r.evidence)
    assert toxicity.scored(docs.limit(0), model).count() == 0
    with pytest.raises(TypeError):
        toxicity.scored(docs.withColumn("doc_id", docs.text), model)


def test_isotonic():
    assert toxicity.isotonic([1, 2, 3, 4], [0, 1, 0, 1], [1, 1, 1, 1]) == ([1, 2, 4], [0, 0.5, 1])

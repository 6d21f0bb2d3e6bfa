"""Toxicity from the nearest labelled examples: exact TF-IDF cosine by a block-max inverted index.

Terms are words cut to their first ``STEM`` characters, a stemmer that suits inflected languages of any kind. Training takes
a bounded sample of labelled documents (``examples`` a class, whole texts) and all of their terms. Document frequencies of
these terms are then counted over all documents. Examples and documents are TF-IDF vectors of unit length. Terms that no
example has are in no vector; they would change the order of no neighbours.

The index holds postings of each term in blocks of ``BLOCK`` examples; examples are numbered so that alike ones share a block.
A query reads the postings of its rarer terms and adds for each block what its common terms can give at most (their greatest
weights there). The postings of common terms are then read in the blocks of the greatest bounds, and after that in all blocks whose
bound reaches the k-th best similarity found so far, which makes the k nearest examples exact.
Neighbours vote with weight 1 / (1 - similarity + 0.05) times the number of documents that an example stands for; isotonic
regression over the examples themselves (each left out of its own vote) turns votes into calibrated scores. All neighbours
that vote are the evidence. A document without any term has the rate of such examples.

Ids are whole numbers (others raise a TypeError); null ids stay. Null texts count as empty. Repeated rows score alike; of
equally similar examples those of lower number are nearer. Without labels of both kinds every score is the rate of label 1. An
id that several labelled texts share stands for the least of their term lists. A very long text costs time in its words and memory in its
distinct terms. An empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import opened, shared, whole_numbers
from emberline.llm.sampling import remainder, sampled_ids

BLOCK, NEIGHBOURS, STEM = 64, 15, 4
#: At most this many examples of each label (times 1.5).
EXAMPLES = 2000
#: Frequent terms and directions by which examples are numbered.
COMMON, DIRECTIONS = 256, 4
#: Terms of this share of the examples are common.
MANY = 1 / 16
#: Blocks that a query reads first, and queries that go together.
FIRST, TOGETHER = 4, 64
PUNCTUATION = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits (all characters but ASCII ones count as such), cut to their first characters."""
    return [w[:STEM] for w in (text or "").lower().encode().translate(PUNCTUATION).decode().split()]


class Index:
    """Examples as unit vectors over terms, in blocks of ``BLOCK``.

    Terms of few examples have postings. Terms of many (a share of ``MANY``) have a row over all examples instead, in which a
    block's part is its postings, and their greatest weights by block.
    """

    def __init__(self, vectors: list[dict[int, float]], n_terms: int):
        self.n, self.blocks = len(vectors), -(-len(vectors) // BLOCK) or 1
        sizes = np.array([len(v) for v in vectors], np.int64)
        terms = np.fromiter((t for v in vectors for t in v), np.int64, sizes.sum())
        weights = np.fromiter((w for v in vectors for w in v.values()), float, sizes.sum())
        owner = np.repeat(np.arange(self.n), sizes)
        many = np.bincount(terms, minlength=n_terms) >= max(2, MANY * self.n)
        self.row = np.where(many, np.cumsum(many) - 1, -1)
        on = many[terms]
        dense = np.zeros((int(many.sum()), self.blocks * BLOCK))
        dense[self.row[terms[on]], owner[on]] = weights[on]
        dense = dense.reshape(len(dense), self.blocks, BLOCK)
        self.dense, self.most = np.ascontiguousarray(dense.transpose(1, 0, 2)), dense.max(axis=2, initial=0.0)
        terms, owner, weights = terms[~on], owner[~on], weights[~on]
        order = np.lexsort((owner, terms))
        self.ids, self.weights = owner[order].astype(np.int32), weights[order]
        self.first = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights): the k most similar examples with a similarity over 0, equal ones by their number, and their similarities.

        Queries go together: each reads its most promising blocks, and then all whose bound reaches the k-th best similarity found there.
        """
        if not queries:
            return []
        q, width = len(queries), self.blocks * BLOCK
        owner = np.repeat(np.arange(q), [len(t) for t, _ in queries])
        terms, weights = (np.concatenate([x[i] for x in queries]) for i in (0, 1))
        few = self.row[terms] < 0
        first = self.first[terms[few]]
        post, of = ranges(first, self.first[terms[few] + 1] - first)
        score = np.bincount(owner[few][of] * width + self.ids[post], weights[few][of] * self.weights[post], q * width).astype(float).reshape(q, self.blocks, BLOCK)
        common = np.zeros((q, len(self.most)))
        common[owner[~few], self.row[terms[~few]]] = weights[~few]
        bound = score.max(axis=2) + common @ self.most
        read, least = np.zeros((q, self.blocks), bool), np.zeros(q)
        wanted = bound >= np.sort(bound, axis=1)[:, max(0, self.blocks - FIRST)][:, None]
        for _ in range(2):
            wanted &= (bound > 0) & ~read
            for b in np.flatnonzero(wanted.any(axis=0)):
                rows = np.flatnonzero(wanted[:, b])
                score[rows, b] += common[rows] @ self.dense[b]
            read |= wanted
            full = np.where(read[:, :, None], score, 0).reshape(q, width)
            if without is not None:
                full[np.arange(q), without] = 0
            if width > k:
                least = np.partition(full, width - k, axis=1)[:, width - k]
            wanted = bound + 1e-9 >= least[:, None]
        out = []
        for i in range(q):
            some = np.flatnonzero((full[i] > 0) & (full[i] >= least[i] - 2e-9))
            similar = np.round(full[i, some], 9)
            best = np.lexsort((some, -similar))[:k]
            out.append((some[best], similar[best]))
        return out


def alike_together(counts: list[Counter]) -> np.ndarray:
    """An order of the examples in which alike ones are near: by the leading directions of their most frequent terms."""
    common = Counter(t for c in counts for t in c)
    place = {t: i for i, t in enumerate(sorted(common, key=lambda t: (-common[t], t))[:COMMON])}
    dense = np.zeros((len(counts), len(place)))
    for row, c in enumerate(counts):
        for t, n in c.items():
            if t in place:
                dense[row, place[t]] = 1 + math.log(n)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    if not dense.size:
        return np.arange(len(counts))
    values = dense @ np.linalg.eigh(dense.T @ dense)[1][:, ::-1][:, 1 : DIRECTIONS + 1]
    sides = values > np.median(values, axis=0) if values.size else np.zeros((len(counts), 0), bool)
    return np.lexsort((values[:, -1], *sides.T[::-1])) if values.size else np.arange(len(counts))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers starts[i] to starts[i] + sizes[i] for all i in a row, and the i of each."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner], owner


def isotonic(x: list[float], y: list[float], w: list[float]) -> tuple[list[float], list[float]]:
    """The best non-decreasing fit of y by x, as steps (lower ends, values)."""
    steps: list[list[float]] = []
    for a, b, c in sorted(zip(x, y, w, strict=True)):
        if steps and steps[-1][0] == a:
            s = steps[-1]
            s[1], s[2] = (s[1] * s[2] + b * c) / (s[2] + c), s[2] + c
        else:
            steps.append([a, b, c])
    out: list[list[float]] = []
    for s in steps:
        out.append(s)
        while len(out) > 1 and out[-2][1] >= out[-1][1]:
            a = out.pop()
            out[-1] = [out[-1][0], (out[-1][1] * out[-1][2] + a[1] * a[2]) / (out[-1][2] + a[2]), out[-1][2] + a[2]]
    return [s[0] for s in out], [s[1] for s in out]


class Model:
    def __init__(self, terms: list[str]):
        self.terms = {t: i for i, t in enumerate(terms)}

    def counts(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of the known terms, by number."""
        get = self.terms.get
        known = [(i, n) for t, n in words.items() if (i := get(t)) is not None]
        terms, n = np.array([i for i, _ in known], np.int64), np.array([n for _, n in known], np.int64)
        order = np.argsort(terms)
        return terms[order], n[order]

    def vector(self, terms: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = (1 + np.log(n)) * self.idf[terms]
        size = math.sqrt(float(v @ v))
        return v / size if size else v

    def vote(self, near: np.ndarray, similar: np.ndarray) -> float:
        w = self.stand[near] / (1.05 - similar)
        return float((w * self.labels[near]).sum() / w.sum()) if len(near) else 0.0

    def fit(self, idf: np.ndarray, ids: list, counts: list[Counter], labels: list[int], stand: list[float]) -> None:
        self.idf, order = idf, alike_together(counts)
        self.ids, self.labels, self.stand = [ids[i] for i in order], np.array(labels, np.int64)[order], np.array(stand, float)[order]
        rows = [self.counts(counts[i]) for i in order]
        vectors = [self.vector(*r) for r in rows]
        self.index = Index([dict(zip(t.tolist(), v.tolist(), strict=True)) for (t, _), v in zip(rows, vectors, strict=True)], len(self.terms))
        rate = (float(self.stand @ self.labels) + 0.1) / (float(self.stand.sum()) + 1)
        empty = np.array([not len(t) for t, _ in rows], bool)
        self.rate = (float(self.stand[empty] @ self.labels[empty]) + rate) / (float(self.stand[empty].sum()) + 1)
        some = np.flatnonzero(~empty)
        votes = []
        for at in range(0, len(some), TOGETHER):
            part = some[at : at + TOGETHER]
            votes += [self.vote(*near) for near in self.index.nearest([(rows[i][0], vectors[i]) for i in part], NEIGHBOURS, part)]
        self.steps = isotonic(votes, self.labels[some].astype(float).tolist(), self.stand[some].tolist()) if len(some) else ([], [])

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Score, neighbours and their similarities for texts given as (terms, counts)."""
        out = []
        for near, similar in self.index.nearest([(t, self.vector(t, n)) for t, n in texts], NEIGHBOURS):
            if len(near) and self.steps[0]:
                vote = self.vote(near, similar)
                at = int(np.searchsorted(self.steps[0], vote, side="right")) - 1
                # The vote itself orders documents within a step of the calibration.
                out.append((min(1.0, max(0.0, 0.98 * self.steps[1][max(at, 0)] + 0.02 * vote)), near, similar))
            else:
                out.append((min(1.0, max(0.0, self.rate)), near[:0], similar[:0]))
        return out


def examples_of(docs: DataFrame, ids: list, id_col: str, text_col: str) -> dict[int, Counter]:
    """Terms of the whole texts of these ids, counted where the texts are; the caller bounds the ids."""
    sent = shared(docs.sparkSession, frozenset(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = opened(sent)
        for batch in batches:
            rows = [(i, sorted(Counter(terms_of(t.as_py())).items())) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if i in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([[t for t, _ in c] for _, c in rows], pa.list_(pa.string())), pa.array([[n for _, n in c] for _, c in rows], pa.list_(pa.int64()))], ["id", "terms", "n"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("id is not null and text is not null")
    found: dict[int, tuple] = {}
    for r in source.mapInArrow(run, "id long, terms array<string>, n array<long>").collect():
        found[r["id"]] = min(found.get(r["id"], (r["terms"], r["n"])), (r["terms"], r["n"]))
    return {i: Counter(dict(zip(*c, strict=True))) for i, c in found.items()}


def document_frequencies(docs: DataFrame, terms: list[str], text_col: str) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many have each term; each task sends a row for each term that it met."""
    sent = shared(docs.sparkSession, {t: i for i, t in enumerate(terms)})
    n = len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = opened(sent).get
        total = np.zeros(n + 1, np.int64)  # the last counts the documents
        for batch in batches:
            for text in batch.column(0):
                total[n] += 1
                hits = set(map(get, terms_of(text.as_py())))
                hits.discard(None)
                if hits:
                    total[np.fromiter(hits, np.int64, len(hits))] += 1
        met = np.flatnonzero(total)
        for i in range(0, len(met), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(met[i : i + (1 << 16)]), pa.array(total[met[i : i + (1 << 16)]])], ["term", "df"])

    parts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "term long, df long")
    sums = parts.groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(n + 1, np.int64)
    df[sums["term"].to_numpy()] = sums["df"].to_numpy()
    return int(df[n]), df[:n]


def trained(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES) -> Model:
    """A model from (id_col, label_col) rows whose label is 0 or 1."""
    whole_numbers(docs, id_col)
    chosen = sampled_ids(labels.filter(F.col(label_col).isin(0, 1)), label_col, examples, id_col)
    words = examples_of(docs, [i for i, _, _ in chosen], id_col, text_col)
    chosen = [x for x in chosen if x[0] in words]
    model = Model(sorted({t for c in words.values() for t in c}))
    n, df = document_frequencies(docs, list(model.terms), text_col)
    model.fit(np.log((n + 1) / (df + 1)) + 1e-3, [x[0] for x in chosen], [words[x[0]] for x in chosen], [int(x[1]) for x in chosen], [float(x[2]) for x in chosen])
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, evidence): evidence lists the examples that vote, nearest first, their similarity and label. A narrow map."""
    whole_numbers(docs, id_col)
    sent = shared(docs.sparkSession, model)
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(sent)
        ids = np.array(m.ids, np.int64)
        for batch in batches:
            found, texts = [], batch.column(1)
            for start in range(0, len(texts), TOGETHER):
                found += m.scores([m.counts(Counter(terms_of(t.as_py()))) for t in texts.slice(start, TOGETHER)])
            scores = [x[0] for x in found]
            near, similar = [np.zeros(0, np.int64), *(x[1] for x in found)], [np.zeros(0), *(x[2] for x in found)]
            at = pa.array(np.cumsum([len(a) for a in near]).astype(np.int32))
            near = np.concatenate(near)
            evidence = pa.StructArray.from_arrays([pa.array(ids[near]), pa.array(np.concatenate(similar)), pa.array(m.labels[near].astype(np.int32))], ["id", "similarity", "label"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.ListArray.from_arrays(at, evidence)], [id_col, "score", "evidence"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, score double, evidence array<struct<id:bigint,similarity:double,label:int>>")


def held_out(id_col: str = "doc_id"):
    return remainder(id_col, 4) == 2

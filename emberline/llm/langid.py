"""Languages of words and texts by a linear-chain conditional random field.

Features of a word are its lower-cased affixes, its n-grams (two to four bytes, word ends included) and its entry in a
lexicon of words seen in training. Training maximises the likelihood of bounded samples of labelled texts (``per_lang``
documents a language, whole texts): every word bears its document's language, and the transitions between the labels of
neighbouring words are learned with the feature weights. Labelling is by forward-backward: a word's marginals, their mean
over a text, and runs of words of one language, which show code-switching.

Chains are computed exactly and in step: blocks of words give transfer matrices, whose products carry the messages from
block to block; so very long texts cost no more a word than short ones.

A null text or one without a letter is ``und`` with score 0. Repeated rows get equal results, ties go to the first language
by name. Without training data every text is ``und``. An empty table gives an empty result; further columns do not matter. A
very long text is labelled at once, in memory that grows with its words and, a word, with the square of the number of languages; texts
are taken a few at a time, the fewer the more languages there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import BYTE_HASH, GOLDEN, Words, mix, opened, shared, single, slices
from emberline.llm.sampling import remainder, sampled_ids, texts_of

#: Documents of each language in training (times 1.5 at most), feature weights, steps, words in a block, and the least count of a lexicon word.
PER_LANG, SIZE_BITS, STEPS, SPAN, LEAST = 120, 18, 30, 32, 3
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
END = np.uint64(0x1B873593CC9E2D51)


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, owner word) of words data[off[i]:off[i+1]]; the lexicon entry is not among them."""
    n, size = len(off) - 1, np.diff(off)
    padded_off = off + 2 * np.arange(n + 1)
    padded = np.full(int(padded_off[-1]), END, np.uint64)
    padded[np.arange(len(data)) + np.repeat(2 * np.arange(n), size) + 1] = BYTE_HASH[LOWER[data]]
    owner = np.repeat(np.arange(n), size + 2)
    left = np.repeat(padded_off[1:], size + 2) - np.arange(len(padded))
    found, owners, h = [], [], padded.copy()
    for g in range(2, 5):
        h = h[:-1] if g > 2 else h[: max(0, len(padded) - 1)]
        h = h * np.uint64(GOLDEN) + padded[g - 1 :][: len(h)]
        on = left[: len(h)] >= g
        found.append((mix(h[on] + np.uint64(g)) >> np.uint64(64 - SIZE_BITS)).astype(np.int64))
        owners.append(owner[: len(h)][on])
    return np.concatenate(found), np.concatenate(owners)


class Emissions:
    """Scores of distinct words: sums of the weights of their features and of their lexicon entry."""

    def __init__(self, langs: list[str], lexicon: np.ndarray):
        self.langs, self.lexicon = langs, lexicon  # sorted hashes
        self.weights = np.zeros((1 << SIZE_BITS, len(langs)), np.float32)
        self.entries = np.zeros((len(lexicon) + 1, len(langs)), np.float32)  # the last is for words that are not in it
        self.transitions = np.zeros((len(langs), len(langs)))

    def entry(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.lexicon, h)
        return np.where((at < len(self.lexicon)) & (self.lexicon[np.minimum(at, max(len(self.lexicon) - 1, 0))] == h), at, len(self.lexicon)) if len(self.lexicon) else np.zeros(len(h), np.int64)

    def scores(self, feats: np.ndarray, owner: np.ndarray, entry: np.ndarray) -> np.ndarray:
        out = self.entries[entry].astype(np.float64)
        n = np.maximum(np.bincount(owner, minlength=len(entry)), 1)
        for j in range(out.shape[1]):
            out[:, j] += np.bincount(owner, self.weights[feats, j], len(entry)) / n * 8
        return out


def unit(x: np.ndarray, axes) -> np.ndarray:
    return x / np.maximum(x.max(axis=axes, keepdims=True), 1e-300)


def forward_backward(scores: np.ndarray, offsets: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every word, and expected numbers of transitions; a text begins as after an even choice of label."""
    total, k = scores.shape
    if not total:
        return np.zeros((0, k)), np.zeros((k, k))
    psi, t = np.exp(scores - scores.max(axis=1, keepdims=True)), np.exp(transitions - transitions.max())
    counts = np.diff(offsets)
    blocks = -(-counts // SPAN)
    first_block = np.cumsum(blocks) - blocks
    doc = np.repeat(np.arange(len(counts)), blocks)
    number = np.arange(len(doc)) - first_block[doc]
    start = offsets[:-1][doc] + number * SPAN
    size = np.minimum(SPAN, offsets[1:][doc] - start)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    live = np.searchsorted(-size, -np.arange(SPAN), side="left")
    moved = np.broadcast_to(np.eye(k), (len(order), k, k)).copy()
    for i in range(SPAN):
        n = live[i]
        moved[:n] = unit((moved[:n] @ t) * psi[start[:n] + i][:, None, :], (1, 2))
    into, back = np.full((len(order), k), 1 / k), np.ones((len(order), k))
    longest = np.argsort(-blocks, kind="stable")
    for j in range(1, int(blocks.max())):
        d = longest[: np.searchsorted(-blocks[longest], -j, side="left")]
        to, before = rank[first_block[d] + j], rank[first_block[d] + j - 1]
        into[to] = unit(np.einsum("ni,nij->nj", into[before], moved[before]), 1)
    for j in range(int(blocks.max()) - 2, -1, -1):
        d = longest[: np.searchsorted(-blocks[longest], -(j + 1), side="left")]
        here, after = rank[first_block[d] + j], rank[first_block[d] + j + 1]
        back[here] = unit(np.einsum("nij,nj->ni", moved[after], back[after]), 1)
    alpha, beta, prior = np.empty((total, k)), np.empty((total, k)), np.empty((total, k))
    for i in range(SPAN):
        n = live[i]
        at = start[:n] + i
        prior[at] = into[:n]
        into[:n] = unit((into[:n] @ t) * psi[at], 1)
        alpha[at] = into[:n]
    for i in range(SPAN - 1, -1, -1):
        n = live[i]
        at = start[:n] + i
        beta[at] = back[:n]
        back[:n] = unit((back[:n] * psi[at]) @ t.T, 1)
    marginal = alpha * beta
    marginal /= marginal.sum(axis=1, keepdims=True)
    right = psi * beta
    norm = np.einsum("ni,ij,nj->n", prior, t, right)
    return marginal, np.einsum("ni,ij,nj->ij", prior / norm[:, None], t, right)


def fitted(samples: list[tuple[str, str]]) -> Emissions:
    """A field from (text, language) pairs by AdaGrad steps on the likelihood."""
    langs = sorted({x for _, x in samples})
    words = Words(pa.array([t for t, _ in samples], pa.string()))
    h = words.hashes()
    distinct, first, code, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    model = Emissions(langs, distinct[count >= LEAST])
    if not len(h):
        return model
    off = np.concatenate([[0], np.cumsum((words.ends - words.starts)[first])])
    data = words.buf[np.arange(off[-1]) + np.repeat(words.starts[first] - off[:-1], np.diff(off))]
    feats, owner = features(data, off)
    entry = model.entry(distinct)
    per_word = np.maximum(np.bincount(owner, minlength=len(distinct)), 1)
    gold = np.array([langs.index(x) for _, x in samples])[words.text_of()]
    k = len(langs)
    observed = np.zeros((k, k))
    inner = np.ones(len(h), bool)
    inner[words.offsets[:-1][words.counts() > 0]] = False
    np.add.at(observed, (gold[1:][inner[1:]], gold[:-1][inner[1:]]), 1)
    first_gold = gold[words.offsets[:-1][words.counts() > 0]]
    observed += np.bincount(first_gold, minlength=k)[None, :] / k
    target = np.bincount(code * k + gold, minlength=len(distinct) * k).reshape(-1, k)
    sums = [np.full_like(model.weights, 1e-6), np.full_like(model.entries, 1e-6), np.full_like(model.transitions, 1e-6)]
    for _ in range(STEPS):
        scores = model.scores(feats, owner, entry)
        marginal, moves = forward_backward(scores[code], words.offsets, model.transitions)
        grad = target - np.stack([np.bincount(code, marginal[:, j], len(distinct)) for j in range(k)], axis=1)
        by_feature = np.stack([np.bincount(feats, (grad[:, j] / per_word * 8)[owner], 1 << SIZE_BITS) for j in range(k)], axis=1)
        by_entry = np.stack([np.bincount(entry, grad[:, j], len(model.entries)) for j in range(k)], axis=1)
        by_entry[-1] = 0
        for value, g, s, rate in zip((model.weights, model.entries, model.transitions), (by_feature, by_entry, observed - moves), sums, (0.15, 0.15, 0.1), strict=True):
            g = g - 0.01 * value
            s += g * g
            value += (rate * g / np.sqrt(s)).astype(value.dtype)
    return model


def learned(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_lang: int = PER_LANG) -> Emissions:
    """A field from the rows of ``docs`` that have a language; the sample is bounded by ``per_lang``."""
    chosen = sampled_ids(docs.filter(docs[text_col].isNotNull()), lang_col, per_lang, id_col)
    texts = texts_of(docs, [i for i, _, _ in chosen], id_col, text_col)
    return fitted([(texts[i], x) for i, x, _ in chosen if i in texts])


def labelled(docs: DataFrame, model: Emissions, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, runs): runs of words (start, end exclusive) of one language. A narrow map."""
    sent = shared(docs.sparkSession, model)
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(sent)
        for batch in batches:
            for part in slices(batch, "_text", max(1 << 16, (4 << 20) * 64 // max(64, len(m.langs) ** 2))):
                yield labels_of(part, m, id_col)

    return source.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, runs array<struct<start:int,end:int,lang:string>>")


def labels_of(part: pa.RecordBatch, m: Emissions, id_col: str) -> pa.RecordBatch:
    texts = single(part.column(1))
    words = Words(texts)
    n = len(texts)
    lang, score = np.full(n, -1), np.zeros(n)
    run_off, run_rows = np.zeros(n + 1, np.int32), ([], [], [])
    if len(words) and m.langs:
        coded = pc.dictionary_encode(words.array())
        off = np.frombuffer(coded.dictionary.buffers()[1], np.int64, len(coded.dictionary) + 1)
        data = np.frombuffer(coded.dictionary.buffers()[2], np.uint8)
        distinct = Words(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(coded.dictionary), coded.dictionary.buffers()))
        code = coded.indices.to_numpy()
        each = m.scores(*features(data, off), m.entry(distinct.hashes()))
        marginal, _ = forward_backward(each[code], words.offsets, m.transitions)
        best = marginal.argmax(axis=1)
        has = words.counts() > 0
        share = np.add.reduceat(marginal, words.offsets[:-1][has], axis=0) / words.counts()[has, None]  # text by text, so that equal texts have equal sums
        lang[has], score[has] = share.argmax(axis=1), np.clip(np.round(share.max(axis=1), 9), 0, 1)
        change = np.ones(len(best), bool)
        change[1:] = best[1:] != best[:-1]
        change[words.offsets[:-1][has]] = True
        starts = np.flatnonzero(change)
        doc = words.text_of()
        ends = np.append(starts[1:], len(best))
        run_off = np.searchsorted(starts, words.offsets).astype(np.int32)
        base = words.offsets[doc[starts]]
        run_rows = (starts - base, ends - base, best[starts])
    for i in np.flatnonzero(lang >= 0):
        part_bytes = words.buf[words.bounds[i] : words.bounds[i + 1]]
        plain = part_bytes | 32
        if not ((plain >= 97) & (plain <= 122) & (part_bytes < 128)).any() and not any(c.isalpha() for c in texts[i].as_py()):
            lang[i], score[i] = -1, 0.0
    names = np.array([*m.langs, "und"], object)
    runs = pa.ListArray.from_arrays(pa.array(run_off, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(np.asarray(run_rows[0], np.int32)), pa.array(np.asarray(run_rows[1], np.int32)), pa.array(names[np.asarray(run_rows[2], np.int64)], pa.string())], ["start", "end", "lang"]))
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(names[lang], pa.string()), pa.array(score), runs], [id_col, "lang_pred", "score", "runs"])


def held_out(id_col: str = "doc_id"):
    return remainder(id_col, 3) == 1


def training_rows(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    return docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull())

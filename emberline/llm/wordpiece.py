"""Token counts by a longest-match automaton.

The pieces form a trie. For a node whose text cannot be continued, ``fail`` names the node that the greedy
longest-match split leaves after its complete pieces are taken off, and ``popped`` counts those pieces. Both are
precomputed, so a word is counted in one pass over its bytes, in time linear in its length, and no piece is built.

Splits are by word: a word is one space and the bytes up to the next ASCII white space. A byte that no piece covers
counts as one token. Null and empty texts have 0 words and 0 tokens. Repeated rows give repeated results. A very long text
or word costs time and memory in proportion to its length. An empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from emberline.llm.common import Words, opened, shared, single, slices


def read_pieces(path: str) -> list[bytes]:
    """The pieces of a rank file: base64 of the bytes, a blank, the rank, on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """The trie with failure links, its edges in an open-addressing table; its size depends on the vocabulary only."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in [*pieces, *(bytes([b]) for b in range(256))]:
            node = 0
            for b in piece:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    final.append(False)
                node = nxt
            if piece:
                final[node] = True
        fail, popped = [-1] * len(children), [0] * len(children)
        level = [0]
        while level:
            following = []
            for u in level:
                for b, v in children[u].items():
                    following.append(v)
                    if final[v]:
                        fail[v], popped[v] = 0, 1
                        continue
                    z, n = fail[u], popped[u]
                    while b not in children[z]:  # the root has every byte
                        n += popped[z]
                        z = fail[z]
                    fail[v], popped[v] = children[z][b], n
            level = following
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int32)
        edges = np.array([(u << 8 | b, v) for u, c in enumerate(children) for b, v in c.items()], np.int64)
        self.bits = max(8, int(len(edges) * 2.5).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        key, val = edges[:, 0], edges[:, 1]
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = key[free]
            placed = self.keys[slot] == key
            self.values[slot[placed]] = val[placed]
            key, val, slot = key[~placed], val[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node below, or -1."""
        key = node.astype(np.int64) << 8 | byte
        slot, out = self._slot(key), np.full(len(key), -1, np.int32)
        todo = np.arange(len(key))
        while len(todo):
            found = self.keys[slot]
            hit = found == key[todo]
            out[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (found >= 0)
            todo, slot = todo[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out

    def count(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each word, the words in step: a byte of every word at a time, longest words last to finish."""
        n, total = len(start), np.zeros(len(start), np.int64)
        if not n:
            return total
        order = np.argsort(start - end, kind="stable")
        size = (end - start)[order]
        node = np.full(n, self.child(np.zeros(1, np.int64), np.array([32]))[0], np.int32)
        tokens = np.zeros(n, np.int64)
        live = np.searchsorted(-size, -np.arange(int(size[0])), side="left") if size[0] else []
        for at, k in enumerate(live):
            byte = buf[start[order[:k]] + at].astype(np.int64)
            todo = np.arange(k)
            while len(todo):
                nxt = self.child(node[todo], byte[todo])
                got = nxt >= 0
                node[todo[got]] = nxt[got]
                todo = todo[~got]
                tokens[todo] += self.popped[node[todo]]
                node[todo] = self.fail[node[todo]]
        todo = np.flatnonzero(node > 0)
        while len(todo):
            tokens[todo] += self.popped[node[todo]]
            node[todo] = self.fail[node[todo]]
            todo = todo[node[todo] > 0]
        total[order] = tokens
        return total


def token_counts(docs: DataFrame, pieces: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_tokens) of every row of ``docs``: a narrow map, without a shuffle.

    The automaton goes out as a broadcast whose size the vocabulary fixes. Equal words of a slice are counted once.
    """
    sent = shared(docs.sparkSession, Automaton(pieces))
    source = docs.select(docs[id_col], docs[text_col].cast("string").alias("_text"))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = opened(sent)
        for batch in batches:
            for part in slices(batch, "_text", 8 << 20):
                words = Words(single(part.column(1)))
                coded = pc.dictionary_encode(words.array())
                off = np.frombuffer(coded.dictionary.buffers()[1], np.int64, len(coded.dictionary) + 1) if len(coded.dictionary) else np.zeros(1, np.int64)
                data = np.frombuffer(coded.dictionary.buffers()[2], np.uint8) if len(coded.dictionary) else np.zeros(0, np.uint8)
                each = automaton.count(data, off[:-1], off[1:])[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
                total = np.zeros(len(each) + 1, np.int64)
                np.cumsum(each, out=total[1:])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.counts()), pa.array(np.diff(total[words.offsets]))], [id_col, "n_words", "n_tokens"])

    return source.mapInArrow(run, schema)

"""Media columns and token counts against plain versions."""

import hashlib

import numpy as np
import pytest

from emberline.llm import media, wordpiece


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 5000, media.WIDTH * media.MOST_ROWS + 1])
def test_payload_comes_back(size):
    rng = np.random.default_rng(size)
    payload = media.filled(rng.integers(0, 256, size, dtype=np.uint8).tobytes())
    other = media.filled(b"plain words " * 50)
    streams = media.encode([payload, other, payload])
    assert streams[0] == streams[2]
    read = media.thumbnails(streams)
    assert [b"".join(t.tobytes() for _, _, t in p) for p in read] == [payload, other, payload]
    assert all(t.shape == (-(-h // 8), -(-w // 8)) for p in read for w, h, t in p)


def naive(word, pieces):
    n, at, longest = 0, 0, max(map(len, pieces))
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 1, -1) if word[at : at + k] in pieces), 1)
        at, n = at + size, n + 1
    return n


def test_token_counts(spark):
    pieces = [b" a", b"ab", b"abc", b"bcd", b"cd", b" ab", b"abcde", b"aaaa", b"aa"]
    texts = ["abcd aaaaa", "", None, "abcdabcdeabc xyz", "ab\tab\n abcde", "é" * 9, "a" * 5000, "abcd aaaaa"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_tokens) for r in wordpiece.token_counts(df, pieces).collect()}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        assert found[i] == (len(words), sum(naive(b" " + w, set(pieces)) for w in words))
    assert wordpiece.token_counts(df.limit(0), pieces).count() == 0


def test_media_table(spark):
    texts = ["some words", None, "", "some words", "x" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in media.media_table(df).collect()}
    for i, t in enumerate(texts):
        assert bytes(rows[i].thumbnail) == media.filled((t or "").encode()) and rows[i].n_bytes == len((t or "").encode())
    assert hashlib.sha256(rows[0].media).digest() == hashlib.sha256(rows[3].media).digest()

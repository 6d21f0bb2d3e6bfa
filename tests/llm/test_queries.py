"""Every registered query of this subpackage over the smallest tables, against its SQL or a plain version of its contract."""

import glob
import hashlib
import itertools
import os
import re
import zlib

import pytest

from emberline.llm import neardup, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return c


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def of(spark, name):
    return {r[0]: r for r in queries.QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({queries.ORACLES[name]})").fetchall()
    near = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert near(tuple(r) for r in df.select(*columns).collect()) == near(expected)


def test_media(spark, docs):
    found = of(spark, "op2_media_columns")
    assert found.keys() == docs.keys()
    by_text = {}
    for i, r in found.items():
        data = (docs[i].text or "").encode()
        size = max(1, -(-len(data) // 576)) * 576
        payload = data + b"\xff" * (size - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), size, sha(payload), zlib.crc32(payload[-32:]))
        assert by_text.setdefault(data, tuple(r)[1:]) == tuple(r)[1:]


def test_languages(spark, docs):
    found = of(spark, "op3_language_id")
    assert found.keys() == docs.keys()
    right = total = 0
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[i].text or ""))
        if r.held_out and docs[i].lang and r.lang_pred != "und":
            total, right = total + 1, right + (r.lang_pred == docs[i].lang)
    assert total > 20 and right / total > 0.9


def test_near_duplicates(spark, docs):
    found = of(spark, "op4_near_duplicates")
    words = {i: WORD.findall((r.text or "").encode()) for i, r in docs.items()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(sorted(i for i, r in docs.items() if r.text is not None), 2):
        if docs[i].text == docs[j].text or (words[i] and words[j] and neardup.alike(words[i], words[j], 0.8)):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    assert {i: (r.class_id, r.n_words) for i, r in found.items()} == {i: (root(i), len(words[i])) for i in docs}


def test_toxicity(spark, docs):
    found = of(spark, "op7_toxicity")
    assert found.keys() == docs.keys()
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert not any(zlib.crc32(str(e).encode()) % 4 == 2 for e in r.evidence_ids)


def test_urls(spark):
    found = of(spark, "op8_url_filters")
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert found.keys() == pages.keys()
    for i, url in pages.items():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1], m[2]) if m else ("", "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(r), r, v) for r, v in queries.URL_RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        best = max(fits, default=(0, None, None))
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, best[1])
        assert found[i].verdict == best[2] if best[1] else found[i].verdict in ("allow", "block")


def test_byte_bpe(spark, docs):
    import public_tokenizers
    import tiktoken

    table = queries.byte_ranks(spark).table
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    found = of(spark, "op10_byte_bpe")
    assert found.keys() == docs.keys()
    for i, r in found.items():
        text = docs[i].text or ""
        ids = plain.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode()))

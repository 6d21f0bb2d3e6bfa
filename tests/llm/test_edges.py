"""Nulls, empty and very long texts, repeated rows, clashing columns and empty tables: every operator gives each row its result."""

import pytest

from emberline.llm import bpe, langid, media, mixing, neardup, quality, queries, substring, toxicity, wordpiece

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
ROWS = [(1, "a short text of a few words only", "en"), (2, "", "en"), (3, None, "de"), (4, LONG, None), (5, "  \n\t ", None), (1, "a short text of a few words only", "en"), (7, "x" * 60_000, "de"), (None, "no id here", "en"), (8, "ünïcödé 🙂 \x01 \ue000", "de")]
#: Names that the operators use themselves, or that differ from theirs by case only.
CLASHES = ["Text_", "N_WORDS", "size", "TAKEN", "ids", "Score", "words", "class_ID", "_words", "id", "key", "digest", "Media", "source", "runs"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, *[f"{i}" for i in range(len(CLASHES))]) for r in ROWS]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", *[f"`{c}` string" for c in CLASHES]])).repartition(3)


def operators(spark):
    ranks = queries.byte_ranks(spark)
    pieces = wordpiece.read_pieces(queries.vocabulary())
    model = langid.learned(spark.createDataFrame([(i, "the word of it" if i % 2 else "das wort von ihm", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string"))
    some = spark.createDataFrame([(i, f"fine words {i}" if i % 2 else f"nasty words {i}") for i in range(40)], "doc_id long, text string")
    toxic = toxicity.trained(some, some.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) as toxic"))
    return {
        "substring": substring.without_repeats, "media": media.media_table, "langid": lambda d: langid.labelled(d, model), "neardup": neardup.classes, "mixing": mixing.mix,
        "quality": quality.measured, "toxicity": lambda d: toxicity.scored(d, toxic), "wordpiece": lambda d: wordpiece.token_counts(d, pieces), "bpe": lambda d: ranks.with_decoded(bpe.encoded(d, ranks, hot=5)),
    }


@pytest.fixture(scope="module")
def found(spark):
    return operators(spark)


@pytest.mark.parametrize("name", ["substring", "media", "langid", "neardup", "mixing", "quality", "toxicity", "wordpiece", "bpe"])
def test_every_row_has_a_result(spark, docs, found, name):
    rows = found[name](docs).collect()
    assert sorted(r.doc_id or 0 for r in rows) == sorted(r[0] or 0 for r in ROWS)
    twice = [r for r in rows if r.doc_id == 1]
    assert len(twice) == 2 and (name in ("substring", "mixing") or twice[0] == twice[1])
    assert found[name](docs.limit(0)).count() == 0


def test_stages_on_odd_rows(spark, docs):
    kept = quality.passed(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {4, None}
    one = neardup.one_of_each(docs)
    assert one.columns == docs.columns and sorted(r.doc_id or 0 for r in one.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]
    copies = mixing.mix(docs, carry=True)
    assert set(docs.columns) <= set(copies.columns) and copies.count() > 0


def test_rows_that_share_an_id_keep_their_texts(spark):
    """Unlike texts under one id stay, equal ones stand once; a copy of either under another id goes."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(5, a, 1), (5, b, 2), (5, a, 3), (7, b, 4), (9, "else", 5)], "doc_id long, text string, n int")
    assert sorted((r.doc_id, r.text) for r in neardup.one_of_each(df).collect()) == [(5, a), (5, b), (9, "else")]

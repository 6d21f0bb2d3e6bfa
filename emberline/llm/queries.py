"""The queries of this subpackage, each over a whole table, and the DuckDB statements that give the same rows."""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import bpe, langid, media, mixing, neardup, quality, substring, toxicity, urls, wordpiece
from emberline.llm.common import lean, opened, read, shared


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = media.media_table(read(spark, sf_dir, "documents").select("doc_id", "text"))
    feature = F.format_string("%dx%d/%d a:%s d:%s", "width", "height", "n_pictures", "average_hash", "difference_hash")
    return table.select(
        "doc_id", "n_bytes", F.octet_length("thumbnail").cast("long").alias("payload_bytes"), F.sha2("thumbnail", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(thumbnail, -32)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learned(langid.training_rows(docs))
    found = langid.labelled(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its class and how many words it has."""
    return neardup.classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.measured(docs).drop("text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").filter(~toxicity.held_out())
    found = toxicity.scored(docs, toxicity.trained(docs, labels))
    evidence = F.transform("evidence", lambda x: x["id"]).alias("evidence_ids")
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), evidence)


#: Production rules: host, a slash, the beginning of a path.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(read(spark, sf_dir, "documents"), wordpiece.read_pieces(vocabulary()))


def byte_ranks(spark: SparkSession) -> bpe.Ranks:
    import public_tokenizers

    with open(vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return bpe.Ranks(spark, ranks, public_tokenizers.PATTERN)


def digests(rows: DataFrame, ranks: bpe.Ranks) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows (doc_id, ids): hashes of what the ids spell in decimals and of what they decode to."""
    pieces = shared(rows.sparkSession, (bpe.pieces_of(ranks.table), bpe.numerals(max(ranks.table.values()) + 1)))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = opened(pieces)
        def sha(ids: pa.ListArray, parts: pa.Array, skip: int) -> pa.Array:
            ends, data = bpe.joined(ids, parts)
            return pa.array([hashlib.sha256(data[a + skip : b]).hexdigest() for a, b in itertools.pairwise(ends.tolist())], pa.string())

        for batch in batches:
            for part in bpe.slices_of(batch, 1):
                ids = part.column(1)
                decoded, listed = (sha(ids, t, skip) for t, skip in zip(tables, (0, 1), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ids.offsets.to_numpy()), pa.int64()), listed, decoded], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.select("doc_id", "ids").mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_ranks(spark)
    return digests(bpe.encoded(read(spark, sf_dir, "documents"), ranks), ranks)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_media_columns": op2_media_columns,
    "op3_language_id": op3_language_id,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_mixed_sources": op5_mixed_sources,
    "op6_quality_cascade": op6_quality_cascade,
    "op7_toxicity": op7_toxicity,
    "op8_url_filters": op8_url_filters,
    "op9_token_counts": op9_token_counts,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM texts),
wins AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS win FROM places),
ranked AS (SELECT doc_id, i, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS later FROM wins),
cover AS (SELECT doc_id, i, word, max(CAST(later AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM ranked),
kept AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS text FROM cover GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM documents d LEFT JOIN kept k USING (doc_id)
""",
    "op5_mixed_sources": r"""
WITH base AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM sources),
ratios AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM ranked),
spread AS (SELECT *, row_number() OVER o AS place,
  CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM ratios WINDOW o AS (ORDER BY ratio, encode(source) NULLS LAST)),
goals AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, (SELECT arg_min(level, place) FROM spread WHERE level <= ratio) * weight) AS target FROM spread),
placed AS (SELECT b.*, g.source_size, g.target, coalesce(sum(size) OVER (PARTITION BY b.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM base b JOIN goals g ON b.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * len([r FOR r IN [0, 1, 2] IF size > 0 AND CAST(r * source_size + start AS DOUBLE) + CAST(size AS DOUBLE) / 2 <= target]) AS BIGINT) AS taken FROM placed
""",
    "op6_quality_cascade": r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
ws AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM texts),
places AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, w FROM ws),
wins AS (SELECT r, i, CASE WHEN i + 7 <= len(w) THEN array_to_string(w[i:i + 7], ' ') END AS win FROM places),
counted AS (SELECT r, i, win IS NOT NULL AND count(*) OVER (PARTITION BY r, win) > 1 AS twice FROM wins),
cover AS (SELECT r, max(CAST(twice AS INT)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM counted),
reps AS (SELECT r, CAST(sum(c) AS BIGINT) AS n FROM cover GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  len(lines) AS n_lines, length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS capitals FROM ws LEFT JOIN reps USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * capitals > letters OR 2 * letters < word_chars) AS kept FROM f
""",
}

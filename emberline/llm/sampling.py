"""Bounded, reproducible samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, by: int):
    """crc32 of the id as text, modulo ``by`` (null id: as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(by))


def sampled_ids(labelled: DataFrame, label: str, most: int, id_col: str = "doc_id") -> list[tuple]:
    """(id, label, weight) of about ``most`` and at most 1.5 * ``most`` rows of each label, those of lowest id hash; weight is how many rows one stands for.

    Counts come first; a label's threshold on the hash follows from its count, so nothing is sorted as a whole.
    """
    rows = labelled.filter(F.col(f"`{id_col}`").isNotNull() & F.col(label).isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(label).alias("label"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    out = []
    for value in sorted(counts):
        part = rows.filter((F.col("label") == F.lit(value)) & (place < min(1.0, most / counts[value])))
        got = sorted({r["id"] for r in part.limit(most + most // 2).collect()})
        out += [(i, value, counts[value] / max(1, len(got))) for i in got]
    return out


def texts_of(docs: DataFrame, ids: list, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The whole texts of these ids (their number is bounded by the caller's sample, so they go out as a broadcast); an id's first text by order."""
    if not ids:
        return {}
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i,) for i in ids], f"id {docs.schema[id_col].dataType.simpleString()}")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).filter("text is not null").join(F.broadcast(wanted), "id", "left_semi").collect()
    out: dict = {}
    for r in rows:
        out[r["id"]] = min(out.get(r["id"], r["text"]), r["text"])
    return out

"""Quality rules in a short-circuit cascade, in DataFrame operations only.

A rule is a Column that is true where a text is to be rejected. On a sample, drawn by a hash of the text, the cascade measures
what each rule costs and how much it rejects, and then asks the rules in the order of rejection per cost: a CASE expression
stops at the first rule that rejects. A rule's cost is the time that it adds to a job over the sample, repeated ``TIMES`` over so
that evaluation and not the start of the job is what is measured. The order changes the work, never the verdict.

Null text counts as empty (no words). Repeated rows get equal verdicts, tied rules keep the order that was given, and so do all
if the table is empty. A very long text costs memory in its words. Columns named like the results are replaced, whatever the case.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import WORD, free, with_columns

#: Rows of the sample (about) on which costs and selectivities are estimated, and how often each is evaluated in a measurement.
SAMPLE_ROWS, TIMES = 512, 16


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once a row, however often the body uses it: a fold of nothing that starts and ends with it."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda whole, _: whole, body)


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def windows(words: Column, n: int) -> Column:
    """A 64-bit hash of each n words in a row."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(n))))).otherwise(F.array().cast("array<long>"))


def covered(starts: Column, n: int) -> Column:
    """Words in the windows of n words that begin at these ascending places."""
    gaps = F.transform(starts, lambda x, j: F.least(F.lit(n), F.coalesce(F.get(starts, j + 1) - x, F.lit(n))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated(hashes: Column, n: int) -> Column:
    """Words in windows that occur twice or more. Texts without a repeat end at the count of distinct windows."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        marked = F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
        return let(F.sort_array(F.filter(marked, lambda i: i.isNotNull())), lambda starts: covered(starts, n))

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, twice))


def word_measures(text: Column, n: int = 8) -> Column:
    """struct(n_words, n_repeat_words)."""
    return let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), let(windows(w, n), lambda h: repeated(h, n)).alias("n_repeat_words")))


def line_measures(text: Column) -> Column:
    """struct(n_lines, n_dup_lines) of the lines that have a word."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


def n_symbols(text: Column) -> Column:
    return F.length(without(text, r"[^#*$%&|<>]+")).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(without(text, r"[\x20\x09-\x0D]+")).cast("long")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def measures(text: Column) -> dict[str, Column]:
    """What the rules and the results share: struct(n_words, n_repeat_words), struct(n_lines, n_dup_lines), word_chars and n_symbols."""
    return {"words": word_measures(text), "lines": line_measures(text), "chars": word_chars(text), "symbols": n_symbols(text)}


def standard_rules(text: Column, known: dict[str, Column] | None = None) -> dict[str, Column]:
    """The rules besides the base: symbols, repeated lines, word length, capitals, letters; over the measures that are ``known``. All thresholds leave ordinary prose alone."""
    m = known or {"words": F.struct(F.regexp_count(text, F.lit(WORD)).alias("n_words"))} | {k: v for k, v in measures(text).items() if k != "words"}
    n_words, letters = m["words"]["n_words"], F.length(without(text, r"[^\p{L}]+"))
    return {
        "symbols": 10 * m["symbols"] > n_words,
        "repeated_lines": let(m["lines"], lambda x: 100 * x["n_dup_lines"] > 30 * x["n_lines"]),
        "word_length": let(F.struct(m["chars"].alias("c"), n_words.alias("n")), lambda x: (x["c"] < 2 * x["n"]) | (x["c"] > 15 * x["n"])),
        "capitals": 2 * F.length(without(text, r"[^\p{Lu}]+")) > letters,
        "letters": 2 * letters < m["chars"],
    }


def base_rules(text: Column) -> dict[str, Column]:
    return {"words": F.regexp_count(text, F.lit(WORD)) < 20, "repetition": let(word_measures(text), lambda m: base_failed(m["n_words"], m["n_repeat_words"]))}


def sampled(docs: DataFrame, text: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows of ``docs``, those of the least hashes of the text."""
    share = min(1.0, rows / max(1, docs.count()))
    return docs.filter(F.pmod(F.xxhash64(text, F.lit(7)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def cascade(sample: DataFrame, rules: dict[str, Column]) -> list[str]:
    """The names of the rules by rejections per second on a sample of bounded size; ties keep the order given."""
    sample = sample.cache()
    try:
        if not sample.count():
            return list(rules)
        repeated_rows = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(TIMES))).alias(free(sample, "time")))

        def measured(rule: Column) -> tuple[int, float]:
            run, times = repeated_rows.agg(F.count_if(rule).alias("n")), []
            for _ in range(2):
                began = time.perf_counter()
                n = run.first()["n"]
                times.append(time.perf_counter() - began)
            return n, min(times)

        start = measured(F.lit(True))[1]
        rate = {}
        for name, rule in rules.items():
            n, seconds = measured(rule)
            rate[name] = n / max(seconds - start, 0.02 * start)  # what is shorter cannot be told from the job's start
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda r: -rate[r])


def verdict(rules: dict[str, Column], order: list[str]) -> Column:
    """False at the first rule, in this order, that rejects; else true."""
    out = F
    for name in order:
        out = out.when(rules[name], F.lit(False))
    return out.otherwise(F.lit(True)) if order else F.lit(True)


def passed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, base rules included. A narrow filter."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rules = base_rules(text) | standard_rules(text)
    return docs.filter(verdict(rules, cascade(sampled(docs.select(f"`{text_col}`"), text), rules)))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept (columns of these names are replaced).

    What is measured for the results is measured once; the rules read it from there.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    names = {k: free(docs, f"_{k}") for k in ("words", "lines", "chars", "symbols")}
    of = lambda df: df.withColumns({names[k]: v for k, v in measures(text).items()})
    m = {k: F.col(n) for k, n in names.items()}
    rules = standard_rules(text, m)
    order = cascade(of(sampled(docs.select(f"`{text_col}`"), text)), rules)
    failed = base_failed(m["words"]["n_words"], m["words"]["n_repeat_words"])
    return with_columns(of(docs), {
        "n_words": m["words"]["n_words"], "word_chars": m["chars"], "n_symbols": m["symbols"], "n_dup_lines": m["lines"]["n_dup_lines"],
        "n_repeat_words": m["words"]["n_repeat_words"], "base_failed": failed, "kept": F.when(failed, F.lit(False)).otherwise(verdict(rules, order)),
    }).drop(*names.values())

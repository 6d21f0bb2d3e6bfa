"""URL rules, and trust and distrust spread over the links between hosts.

Hosts get trust in proportion to their pages that an allow rule fits, and distrust in proportion to their pages that a
block rule fits; both seeds add up to 1, so that neither side wins by the mere number of pages that it fits. Personalised
PageRank carries trust along links; distrust goes against them, from a blocked host to those that link to it. Mass of hosts
without a link returns to the seeds. A host is blocked if its distrust exceeds its trust by more than ``margin`` times the sum of
both; a host that neither reaches is allowed. Pages that a rule fits follow the rule, of several the longest (host and
path together; equally long ones: the one of the longer host, then the first by text).

Edges are counted by host before the shuffle; each round joins the scores with the host edges and sums them before its
shuffle, and every few rounds are cut by a checkpoint. Rounds go on until the mass that can still arrive anywhere is under ``TOLERANCE``.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule and, having no seeds, are allowed. Null html has
no links. Repeated rows count as often as they occur. Without rules all are allowed. An empty table gives an empty result. A
very long page costs time in its length; further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import checkpointed

DAMPING = 0.85
#: Rounds between checkpoints, and the mass that may be missing when they end (all seeds of a kind have a mass of 1).
STRIDE, TOLERANCE = 3, 1e-6
#: Ways between hosts to a partition, and ways up to which the scores (no more than these and the seeds) go to all tasks.
WAYS, BROADCAST = 100_000, 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII letters in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. A rule is a host, a slash and the beginning of a path."""
    out = F
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), -len(r[0].partition("/")[0]), r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = out.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
    return out.otherwise(F.lit(None)) if rules else F.lit(None).cast("struct<rule:string,verdict:string>")


def link_host(link: Column, own: Column) -> Column:
    """The host that a link leads to: its own, that of the page for a relative link, null for other schemes."""
    full = F.when(link.startswith("//"), F.concat(F.lit("http:"), link)).otherwise(link)
    return F.when(full.rlike(r"^(?i)https?://"), host_of(full)).when(full.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)).otherwise(own)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) from rows (host, html)."""
    links = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)))).alias("link"))
    links = links.select(F.col("host").alias("src"), link_host(F.col("link"), F.col("host")).alias("dst"))
    return links.filter("dst is not null and dst <> '' and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def returned(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(kind, host, score): personalised PageRank for each kind of edges (kind, src, dst, n) and seeds (kind, host, mass).

    Mass of hosts without links returns to the seeds of its kind. Returned mass follows the ways of the seeds' own, so it is
    left out of the rounds and the scores are scaled at the end to add up to the seeds' mass.

    Every score only grows, by at most ``damping`` times the growth of the round before. Rounds go on until the growth that
    can follow is under ``tolerance`` in sum over all hosts (or under what a double can tell of that sum).
    """
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    steps = checkpointed(edges.join(out, ["kind", "src"]).select(F.col("kind").alias("k"), "src", "dst", (F.col("n") / F.col("total")).alias("share")))
    source = checkpointed(seeds.select("kind", "host", (F.col("mass") * (1 - damping)).cast("double").alias("score")))
    # Rounds over a small graph would otherwise leave a file for each of many nearly empty partitions.
    size = steps.count() + source.count()
    parts, everywhere = 1 + size // WAYS, F.broadcast if size <= BROADCAST else lambda scores: scores
    steps, source = steps.coalesce(parts), source.coalesce(parts)
    masses = {r["kind"]: r["mass"] / (1 - damping) for r in source.groupBy("kind").agg(F.sum("score").alias("mass")).collect()}

    def moved(scores: DataFrame) -> DataFrame:
        sent = steps.join(everywhere(scores), (scores.kind == steps.k) & (scores.host == steps.src)).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        return source.unionByName(sent).groupBy("kind", "host").agg(F.sum("score").alias("score")).coalesce(parts)

    scores, before = source, {kind: (1 - damping) * m for kind, m in masses.items()}
    while masses:
        for _ in range(STRIDE):
            scores = moved(scores)
        scores = checkpointed(scores)
        sums = {r["kind"]: r["s"] for r in scores.groupBy("kind").agg(F.sum("score").alias("s")).collect()}
        # The last of the rounds grew least; scaling can enlarge what is missing by masses / sums.
        left = {kind: (total - before[kind]) / STRIDE * damping / (1 - damping) for kind, total in sums.items()}
        if all(left[kind] * masses[kind] / total <= max(tolerance, 1e-13 * masses[kind]) for kind, total in sums.items()):
            break
        before = sums
    factor = F.lit(1.0)
    for kind, total in sums.items() if masses else ():
        factor = F.when(F.col("kind") == kind, F.lit(masses[kind] / total)).otherwise(factor)
    return scores.select("kind", "host", (F.col("score") * factor).alias("score"))


def judged(pages: DataFrame, rules: list[tuple[str, str]], margin: float = 1e-3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, host, path, rule, verdict, trust, distrust) of every page."""
    url = F.col(f"`{url_col}`").cast("string")
    base = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(f"`{html_col}`").cast("string").alias("html"))
    base = base.withColumn("fit", fitting(F.col("host"), F.col("path"), rules))
    edges = checkpointed(host_edges(base.select("host", "html")))
    counted = checkpointed(base.filter("fit is not null").groupBy("host", F.col("fit.verdict").alias("kind")).agg(F.count("*").alias("n")))
    totals = counted.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = counted.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("mass"))  # two rows at most
    ways = edges.withColumn("kind", F.lit("allow")).unionByName(edges.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    scores = returned(ways, seeds)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    hosts = scores.groupBy(F.col("host").alias("h")).agg(of("allow").alias("trust"), of("block").alias("distrust"))
    rows = base.drop("html").join(hosts, F.col("host") == F.col("h"), "left")
    more = F.col("distrust") - F.col("trust") > margin * (F.col("distrust") + F.col("trust"))
    by_host = F.when(F.coalesce(more, F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_host).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))

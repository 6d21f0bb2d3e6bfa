"""Near-duplicates by Order MinHash, verified by banded alignment.

Sketches: the k-mers of a text (two words in a row) are labelled with their occurrence, so that a repeated k-mer counts as
often as it occurs. Each of ``SKETCHES`` hash functions picks the ``LENGTH`` smallest labelled k-mers and keeps them in the
order of the text; two texts of small edit distance agree on such a tuple far more often than two that merely share
k-mers. Texts that agree on a tuple are candidates.

Short texts: e edits of m words leave m - e words in at most e + 1 runs, so two texts that are similar enough share a run
whose least length follows from m (three words at a similarity of 0.8, two where m is 5). Up to ``SHORT`` words all runs of
that length are keys, and no pair is missed.

Verification: two texts are linked if the edit distance of their word sequences, by an alignment confined to the band that
the threshold leaves, is at most (1 - similarity) of the longer one. Before texts are fetched, signatures of fixed size that
bound the distance from below rule out most pairs that are not; texts of buckets with several components get finer ones.

Exact copies are taken together first. Then each bucket's texts are aligned with its first, and components are formed.
Where a bucket still holds several components, the pairs between two components are tried in two rounds: the
likeliest two in a bucket, then all that are left; what the first joins needs no further pairs. So no link between candidates is lost, and a
group of thousands of copies costs a few alignments a text. Buckets of more than ``MANY`` texts that overlap, as those of texts with a
passage in common do, give way to one bucket of all their texts where that takes no more rows, so such texts meet once instead of
once a key. Any other bucket of more than ``TILE`` texts is replaced by smaller ones that lose no similar pair: similar texts share most of their words, so they share one of the rarest words of both (a prefix
filter over all words, rarest first).

Ids are whole numbers (others raise a TypeError). Null texts are alike to nothing; rows with a null id get a null class. Empty
texts are exact copies of each other. Rows that share an id are one document, which has the links of them all. A very long
text costs time in the number of its words, and memory for its alignment in the band. An empty table gives an empty result;
further columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import GOLDEN, Words, checkpointed, lean, mix, opened, shared, single, slices, stored, whole_numbers
from emberline.llm.components import components

#: Words in a k-mer, hash functions, and k-mers that each picks.
K, SKETCHES, LENGTH = 2, 64, 3
#: Slots of a signature: bits and counters.
BITS, COUNTERS = 1024, 256
#: Counters of the finer signatures that texts of mixed buckets have besides.
WIDE = 2048
#: Pairs whose shorter text has at most this many words share a key for certain.
SHORT = 52
#: Texts of one bucket that a task compares with as many others at a time.
TILE = 1024
#: Texts of a bucket from which on it is taken together with those that it overlaps.
MANY = 128
#: Pairs between two components that a round tries in a bucket; the last round tries all.
ROUNDS = (2, None)
#: Counters of how frequent words are, by hash.
SLOTS = 1 << 16
#: Distances up to this one are found by diagonals.
FEW = 16
#: Ids that are few enough to go to all tasks; the rows of more are fetched by a shuffle.
BROADCAST = 400_000
#: Pairs of one text that are joined with it in one task.
GROUP = 512


def occurrence(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often the same hash came before in the same text."""
    order = np.lexsort((h, owner))
    hs, os = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (os[1:] != os[:-1])
    starts = np.flatnonzero(new)
    out = np.empty(len(h), np.uint64)
    out[order] = (np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))).astype(np.uint64)
    return out


def kmer_hashes(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of all texts, and the texts' offsets among them; a shorter text is one k-mer."""
    n = words.counts()
    filled = np.zeros(len(hashes) + k, np.uint64)
    filled[: len(hashes)] = hashes
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(offsets[-1]) + np.repeat(words.offsets[:-1] - offsets[:-1], counts)
    ends = np.repeat(words.offsets[1:], counts)
    out = np.full(len(at), 7, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(GOLDEN) + np.where(at + i < ends, filled[at + i], np.uint64(0)))
    return out, offsets


def order_minhash(kmers: np.ndarray, offsets: np.ndarray, sketches: int, length: int) -> np.ndarray:
    """One row of ``sketches`` hashes for each text; each has ``length`` k-mers or more.

    The low bits of a hash are replaced by the k-mer's place, so the least one names its place.
    """
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    labelled = mix(kmers + occurrence(kmers, owner) * np.uint64(0xFF51AFD7ED558CCD))
    starts, top = offsets[:-1], np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.empty((len(starts), sketches), np.uint64)
    low = np.uint64((1 << int(len(kmers)).bit_length()) - 1)
    places = np.arange(len(kmers), dtype=np.uint64)
    for i in range(sketches):
        h = labelled * np.uint64(int(mix(np.array([(i + 1) * GOLDEN & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]) | 1)
        h &= ~low
        h |= places
        picked = []
        for _ in range(length):
            place = (np.minimum.reduceat(h, starts) & low).astype(np.int64)
            h[place] = top
            picked.append(place)
        chosen = np.sort(np.stack(picked), axis=0)
        s = np.full(len(starts), i + 1, np.uint64)
        for j in range(length):
            s = mix(s * np.uint64(GOLDEN) + labelled[chosen[j]])
        out[:, i] = s
    return out


def sure_run(longer: int, similarity: float) -> int:
    """Words in a row, three at most, that two similar texts share if the longer has ``longer`` words."""
    edits = allowed(longer, longer, similarity)
    return max(1, min(3, -(-(longer - edits) // (edits + 1))))


def candidate_keys(words: Words, hashes: np.ndarray, sketches: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all texts, and the texts' offsets among them: all sure runs where a partner may be short, sketches of the texts over ``SHORT`` words."""
    n = words.counts()
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    limit = int(SHORT / similarity + 1e-9)
    runs = [{sure_run(m, similarity) for m in range(i, min(int(i / similarity + 1e-9), limit) + 1)} for i in range(limit + 1)]
    for k in sorted(set().union(*runs[1:])):
        has = np.array([i > 0 and k in r for i, r in enumerate(runs)] + [False])[np.minimum(n, limit + 1)]
        kmers, offsets = kmer_hashes(words, hashes, k)
        owner = np.repeat(np.arange(len(n)), np.diff(offsets))
        owners.append(owner[has[owner]])
        found.append(kmers[has[owner]])
    kmers, offsets = kmer_hashes(words, hashes, K)
    sizes = np.diff(offsets) * (n > SHORT)
    if sizes.any():
        kmers = kmers[np.repeat(n > SHORT, np.diff(offsets))]
        owners.append(np.repeat(np.flatnonzero(sizes), sketches))
        found.append(order_minhash(kmers, np.concatenate([[0], np.cumsum(sizes[sizes > 0])]), sketches, LENGTH).reshape(-1))
    owner, keys = np.concatenate(owners), np.concatenate(found)
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(n)))])


def signatures(words: Words, hashes: np.ndarray, n_texts: int) -> np.ndarray:
    """Words of each text by hash: ``BITS`` bits and then ``COUNTERS`` counters that stop at 255. Their distances bound the edit distance from below."""
    owner = words.text_of()
    bits = np.zeros((n_texts, BITS), bool)
    bits[owner, (hashes >> np.uint64(20)).astype(np.int64) % BITS] = True
    counted = np.bincount(owner * COUNTERS + (hashes >> np.uint64(40)).astype(np.int64) % COUNTERS, minlength=n_texts * COUNTERS)
    return np.concatenate([np.packbits(bits, axis=1), np.minimum(counted, 255).astype(np.uint8).reshape(n_texts, COUNTERS)], axis=1)


def wide_counts(words: Words, hashes: np.ndarray, n_texts: int) -> np.ndarray:
    """Words of each text by hash in ``WIDE`` counters that stop at 255, for texts whose many words share the counters of a signature."""
    counted = np.bincount(words.text_of() * WIDE + (hashes >> np.uint64(30)).astype(np.int64) % WIDE, minlength=n_texts * WIDE)
    return np.minimum(counted, 255).astype(np.uint8).reshape(n_texts, WIDE)


def finely_signed(docs: DataFrame) -> DataFrame:
    """(id, n, signature, wide) of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for at in range(0, part.num_rows, TILE):  # of very short texts, the signatures are what takes memory
                    some = part.slice(at, TILE)
                    words = Words(single(some.column("text")))
                    signed = [pa.array([x.tobytes() for x in f(words, words.hashes(), some.num_rows)], pa.binary()) for f in (signatures, wide_counts)]
                    yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(words.counts(), pa.int32()), *signed], ["id", "n", "signature", "wide"])

    return docs.select("id", "text").mapInArrow(lean(run), "id long, n int, signature binary, wide binary")


def parted(signed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bits, as 64-bit numbers, and the counters of signatures."""
    both = np.frombuffer(b"".join(signed), np.uint8).reshape(len(signed), BITS // 8 + COUNTERS)
    return np.ascontiguousarray(both[:, : BITS // 8]).view(np.uint64), both[:, BITS // 8 :]


def least_by_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words of one text whose bit the other lacks: each must be edited."""
    return np.maximum(np.bitwise_count(a & ~b).sum(-1, dtype=np.int64), np.bitwise_count(b & ~a).sum(-1, dtype=np.int64))


def least_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a.astype(np.int16) - b
    return np.maximum(np.maximum(d, 0).sum(-1, dtype=np.int64), np.maximum(-d, 0).sum(-1, dtype=np.int64))


def allowed(n: int, m: int, similarity: float) -> int:
    return int((1 - similarity) * max(n, m) + 1e-9)


def banded_distance(a: list, b: list, most: int) -> int | None:
    """The edit distance of two sequences, or None if it is over ``most``: by diagonals while it is small, else by bit vectors within the band."""
    lo, end_a, end_b = 0, len(a), len(b)
    if abs(end_a - end_b) > most:
        return None
    while lo < end_a and lo < end_b and a[lo] == b[lo]:
        lo += 1
    while end_a > lo and end_b > lo and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[lo:end_a], b[lo:end_b]
    found = by_diagonals(a, b, min(most, FEW))
    return found if found is not None or most <= FEW else by_bits(a, b, most)


def by_diagonals(a: list, b: list, most: int) -> int | None:
    """The distance by the furthest-reaching points on the diagonals of the band; time in its square."""
    n, m = len(a), len(b)
    goal, reach = n - m, {}
    for d in range(most + 1):
        now = {}
        for k in range(-d, d + 1):
            if k < -m or k > n or abs(goal - k) > most - d:
                continue
            # k = place in a - place in b; the value is the place in a
            x = max(reach.get(k, -2) + 1, reach.get(k - 1, -2) + 1, reach.get(k + 1, -2)) if d else 0
            x = min(x, n, m + k)
            if x < 0 or x < k:
                continue
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            if k == goal and x == n:
                return d
            now[k] = x
        reach = now
    return None


def by_bits(a: list, b: list, most: int) -> int | None:
    """The distance by columns of vertical differences, a bit a row of ``a``.

    Rows above the band are dropped, 64 at a time; the row over the first one left then counts as one more in each column,
    which is never too little and exact for paths within the band.
    """
    if not a:
        return len(b) if len(b) <= most else None
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    rows, base = len(a), 0
    full = (1 << rows) - 1
    up, down, distance = full, 0, len(a)
    for j, w in enumerate(b):
        if j - most >= base + 64 and rows > 64:
            base, rows = base + 64, rows - 64
            full, up, down = full >> 64, up >> 64, down >> 64
        same = at.get(w, 0) >> base
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        right_up, right_down = down | (full & ~(diagonal | up)), diagonal & up
        last = 1 << rows - 1
        distance += bool(right_up & last) - bool(right_down & last)
        if distance - (len(b) - j - 1) > most:
            return None
        right_up = right_up << 1 | 1
        up, down = (right_down << 1 | ~(diagonal | right_up)) & full, diagonal & right_up & full
    return distance if distance <= most else None


def alike(a: list, b: list, similarity: float) -> bool:
    """Whether two word sequences are similar enough. Words that only one of them has bound the distance from below, which settles most pairs that are not."""
    most = allowed(len(a), len(b), similarity)
    if max(len(a), len(b)) - (Counter(a) & Counter(b)).total() > most:
        return False
    return banded_distance(a, b, most) is not None


def sketched(docs: DataFrame, id_col: str, text_col: str, sketches: int = SKETCHES, similarity: float = 0.8) -> DataFrame:
    """(id, h1, h2, n, keys, signature) of every row; h1 and h2 are null where the text is."""
    text = F.col(f"`{text_col}`").cast("string")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), *hashed(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(single(part.column(1)))
                hashes = words.hashes()
                keys, at = candidate_keys(words, hashes, sketches, similarity)
                signed = signatures(words, hashes, part.num_rows)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), part.column(3), pa.array(words.counts(), pa.int32()),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys.view(np.int64))), pa.array([c.tobytes() for c in signed], pa.binary()),
                ], ["id", "h1", "h2", "n", "keys", "signature"])

    return source.mapInArrow(lean(run), "id long, h1 long, h2 long, n int, keys array<long>, signature binary")


def hashed(text) -> list:
    """Two hashes that tell texts apart, null for a null one."""
    return [F.when(text.isNotNull(), F.xxhash64(text)).alias("h1"), F.when(text.isNotNull(), F.xxhash64(text, F.lit("second"), F.length(text))).alias("h2")]


def attached(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """(u, v, a, b): the pairs with the column of both. The value of a v of many pairs goes to several tasks; values has rows (id, column)."""
    parts = pairs.groupBy("v").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    spread = parts.join(values, F.col("id") == F.col("v")).select("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col(column).alias("b"))
    placed = pairs.join(parts, "v").select("v", "u", F.pmod(F.xxhash64("u"), "parts").cast("int").alias("part"))
    return placed.join(spread, ["v", "part"]).select("u", "v", "b").join(values.select(F.col("id").alias("u"), F.col(column).alias("a")), "u").select("u", "v", "a", "b")


def needed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ``ids``, each of which stands there once."""
    ids = checkpointed(ids)
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, "id", "left_semi")


def ids_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def possible(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) that the signatures do not rule out."""
    values = needed(rows, ids_of(pairs)).select("id", F.struct("n", "signature").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (n, a), (m, b) = ((c.field("n").to_numpy(), parted(c.field("signature").to_pylist())) for c in (batch.column(2), batch.column(3)))
                most = most_edits(n, m, similarity)
                good = (least_by_bits(a[0], b[0]) <= most) & (least_distance(a[1], b[1]) <= most)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good))

    return attached(pairs, values, "value").mapInArrow(lean(run), "u long, v long").distinct()


def most_edits(n, m, similarity: float) -> np.ndarray:
    """``allowed`` for arrays of word counts."""
    return ((1 - similarity) * np.maximum(n, m) + 1e-9).astype(np.int64)


def verified(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose texts align within the band; docs has rows (id, text)."""
    texts = needed(docs, ids_of(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: dict = {}

        def words(text: str) -> list:
            if text not in split:
                if len(split) >= 8:  # texts of many pairs come one after another
                    split.clear()
                split[text] = text.encode().split()
            return split[text]

        for batch in batches:
            good = [alike(words(a.as_py()), words(b.as_py()), similarity) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return attached(pairs, texts, "text").mapInArrow(lean(run), "u long, v long").distinct()


def across(table: pa.Table, similarity: float, quota: int | None) -> pa.Table:
    """Of one tile: pairs of different components that the signatures leave possible, the likeliest ``quota`` of each two components. Side 0 meets side 1, or in a tile of the diagonal itself."""
    side, ids, comp, n = (table[c].to_numpy() for c in ("side", "id", "component", "n"))
    bits, counters = parted(table["signature"].to_pylist())
    wide = np.frombuffer(b"".join(table["wide"].to_pylist()), np.uint8).reshape(len(ids), WIDE)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    found = [np.zeros((3, 0), np.int64)]
    for i in left:
        most = most_edits(n[right], n[i], similarity)
        keep = (comp[right] != comp[i]) & (np.abs(n[right] - n[i]) <= most)
        other, most = right[keep], most[keep]
        keep = least_by_bits(bits[other], bits[i]) <= most
        other, most = other[keep], most[keep]
        keep = least_distance(counters[other], counters[i]) <= most
        other, most = other[keep], most[keep]
        least = least_distance(wide[other], wide[i])
        found.append(np.stack([np.full(len(other), i), other, least])[:, least <= most])
    x, y, least = np.concatenate(found, axis=1)
    swap = ids[x] > ids[y]
    v, u = np.where(swap, y, x), np.where(swap, x, y)
    if quota is not None and len(v):
        a, b = np.minimum(comp[v], comp[u]), np.maximum(comp[v], comp[u])
        order = np.lexsort((ids[u], ids[v], least, b, a))
        a, b, v, u = a[order], b[order], v[order], u[order]
        new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        rank = np.arange(len(a)) - np.repeat(new, np.diff(np.append(new, len(a))))
        v, u = v[rank < quota], u[rank < quota]
    return pa.table({"v": ids[v].astype(np.int64), "u": ids[u].astype(np.int64)})


def mixed(buckets: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, id, component, size) of the buckets that hold several components."""
    placed = buckets.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size")).filter("a <> b").drop("a", "b")
    return placed.join(several, "key").select("key", "id", "component", "size")


def unresolved(found: DataFrame, signed: DataFrame, tested: DataFrame, similarity: float, quota: int | None) -> DataFrame:
    """Candidate pairs (v, u) between components that share a bucket (see ``mixed``), without those that were tested already."""
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    spread = found.withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    # A text of tile t goes to the pairs of tiles (t, x) and (x, t); which side it is on follows from the order.
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).join(signed, "id")
    spread = spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "component", "n", "signature", "wide")
    pairs = spread.groupBy("key", "i", "j").applyInArrow(lambda t: across(t, similarity, quota), "v long, u long").distinct()
    return pairs.join(tested, ["v", "u"], "left_anti")


def rarest_words(docs: DataFrame, similarity: float) -> DataFrame:
    """(key, id): for each text of rows (id, text) its rarest words, as many as two similar texts cannot differ in, so that they share a key.

    Words are labelled with their occurrence and ordered by how frequent their slot is in ``docs``, then by hash. Two texts
    of m words or more share at least similarity * m of them, so one is among the first m - similarity * m + 1 of both.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount((Words(single(part.column("text"))).hashes() % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["slot", "n"])

    counts = docs.mapInArrow(lean(counted), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(SLOTS, np.int64)
    frequency[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    sent = shared(docs.sparkSession, frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(sent)
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(single(part.column("text")))
                hashes, owner, n = words.hashes(), words.text_of(), words.counts()
                labelled = mix(hashes + occurrence(hashes, owner) * np.uint64(0xFF51AFD7ED558CCD))
                order = np.lexsort((labelled, known[(hashes % np.uint64(SLOTS)).astype(np.int64)], owner))
                first = np.arange(len(order)) - np.repeat(words.offsets[:-1], n) < np.repeat(most_edits(n, 0, similarity) + 1, n)
                chosen = order[first]
                yield pa.RecordBatch.from_arrays([pa.array(labelled[chosen].view(np.int64)), part.column("id").take(pa.array(owner[chosen]))], ["key", "id"])

    return docs.mapInArrow(lean(run), "key long, id long")


def gathered(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mixed buckets of which large ones that overlap are one: those that stay as they were, and those of all texts of several.

    Texts that shared a bucket still do. Buckets become one only if its tiles take no more rows than the buckets did.
    """
    large = checkpointed(found.filter(F.col("size") > MANY))
    if large.isEmpty():
        return found, large
    leads = large.groupBy("key").agg(F.min("id").alias("v"))
    linked = components(large.join(leads, "key").select(F.col("id").alias("u"), "v")).withColumnRenamed("component", "cluster")
    placed = checkpointed(large.join(linked, "id"))
    texts = placed.groupBy("cluster", "id").agg(F.first("component").alias("component"), F.count("*").alias("rows"))
    sizes = texts.groupBy("cluster").agg(F.count("*").alias("texts"), F.sum("rows").alias("rows")).filter(F.col("texts") * F.ceil(F.col("texts") / TILE) <= F.col("rows"))
    sizes = checkpointed(sizes)
    together = texts.drop("rows").join(sizes, "cluster").select(F.xxhash64("cluster", F.lit("cluster")).alias("key"), "id", "component", F.col("texts").alias("size"))
    apart = placed.join(sizes, "cluster", "left_anti").select("key", "id", "component", "size")
    return checkpointed(found.filter(F.col("size") <= MANY).unionByName(apart)), checkpointed(together)


def without_large(found: DataFrame, comp: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Mixed buckets, of which large ones that overlap are one, and others of more than ``TILE`` texts have given way to buckets of their texts' rarest words."""
    found, together = gathered(found)
    large = found.filter(F.col("size") > TILE)
    if large.isEmpty():
        return found.unionByName(together)
    texts = needed(docs, large.select("id").distinct())
    more = mixed(rarest_words(texts, similarity).distinct(), comp)
    return checkpointed(found.filter(F.col("size") <= TILE).unionByName(more).unionByName(together))


def classes(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", sketches: int = SKETCHES) -> DataFrame:
    """(id_col, class_id, n_words) for every row of ``docs``; class_id is the least id of its class. Null text: a class of its own."""
    whole_numbers(docs, id_col)
    rows = stored(sketched(docs, id_col, text_col, sketches, similarity))
    known = rows.filter("id is not null and h1 is not null")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("id is not null and text is not null")
    if known.select("id").distinct().count() < known.count():  # rows that share an id: each of its texts once
        known, texts = known.dropDuplicates(["id", "h1", "h2"]), texts.dropDuplicates(["id", "text"])
    copies = known.groupBy("h1", "h2").agg(F.min("id").alias("first"))
    member = known.select("id", "h1", "h2").join(copies, ["h1", "h2"]).select("id", "first").distinct()
    firsts = known.join(copies, ["h1", "h2"]).filter("id = first").dropDuplicates(["id", "h1", "h2"])
    every = firsts.select("id", "n", F.explode("keys").alias("key"))
    shared_keys = Window.partitionBy("key")
    buckets = every.withColumn("lead", F.min(F.struct("id", "n")).over(shared_keys)).withColumn("last", F.max("id").over(shared_keys)).filter("lead.id <> last").drop("last")
    buckets = checkpointed(buckets)
    # Lengths rule out most pairs that merely share words; those of ids with several texts are left to the comparison across components.
    near = F.abs(F.col("n") - F.col("lead.n")) <= (1 - similarity) * F.greatest("n", "lead.n") + 1e-9
    star = buckets.filter(F.col("id") > F.col("lead.id")).filter(near).select(F.col("lead.id").alias("v"), F.col("id").alias("u")).distinct()
    tested = checkpointed(possible(checkpointed(star), known, similarity))
    comp = components(verified(tested, texts, similarity))
    left = without_large(checkpointed(mixed(buckets.select("key", "id"), comp)), comp, texts, similarity)
    signed = checkpointed(finely_signed(needed(texts, left.select("id").distinct()))) if not left.isEmpty() else None
    for i, quota in enumerate(ROUNDS if signed else ()):
        left = checkpointed(mixed(left.select("key", "id"), comp)) if i else left
        late = checkpointed(unresolved(left, signed, tested, similarity, quota))
        if not late.isEmpty():
            more = checkpointed(verified(late, texts, similarity))
            tested = tested.unionByName(late.select("u", "v"))
            if not more.isEmpty():
                comp = components(more.unionByName(comp.select(F.col("id").alias("u"), F.col("component").alias("v"))))
    # An exact copy has the class of its first; ids with several texts join the classes of all of them.
    named = member.join(comp.withColumnRenamed("id", "first"), "first", "left").select("id", F.coalesce("component", "first").alias("class"))
    doubled = named.groupBy("id").agg(F.min("class").alias("class"), F.max("class").alias("other"))
    doubled = checkpointed(doubled)
    ties = doubled.filter("class <> other").select(F.col("other").alias("u"), F.col("class").alias("v"))
    result = doubled.select("id", "class")
    if not ties.isEmpty():
        joint = components(ties).select(F.col("id").alias("class"), "component")
        result = result.join(joint, "class", "left").select("id", F.coalesce("component", "class").alias("class"))
    kind = docs.schema[id_col].dataType
    joined = rows.select("id", "n").join(result, "id", "left")
    return joined.select(F.col("id").cast(kind).alias(id_col), F.coalesce("class", "id").alias("class_id"), F.col("n").cast("long").alias("n_words"))


def one_of_each(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their class, one a class; rows without an id stay.

    Of rows that share an id, one for each different text stays (one of equal texts: that of the least hash over all columns).
    """
    keep = classes(docs, similarity, id_col, text_col).filter(F.col(f"`{id_col}`") == F.col("class_id")).select(F.col("class_id").cast("long").alias("id")).distinct()
    own = F.col(f"`{id_col}`")
    named = [F.col(f"`{c}`") for c in docs.columns]
    known = docs.select(F.struct(*named).alias("row"), own.cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("text")).filter("id is not null")
    first = needed(known, keep)
    repeated = known.groupBy("id").count().filter("count > 1").select("id")
    if not repeated.isEmpty():  # only rows that share an id are sorted, whole texts and all
        repeated = checkpointed(repeated)
        same = Window.partitionBy("id", "text").orderBy(F.xxhash64(F.to_json("row")))
        shared_ids = first.join(repeated, "id", "left_semi").withColumn("place", F.row_number().over(same)).filter("place = 1").drop("place")
        first = first.join(repeated, "id", "left_anti").unionByName(shared_ids)
    first = first.select("row.*")
    return first.unionByName(docs.filter(own.isNull()))

"""Near duplicates by SimHash fingerprints and pigeonring filtering.

Fingerprints lie on a ring of ``segments`` bit segments. If two differ in at most ``distance`` bits, some segment starts
a chain whose first l segments together differ in at most ``l * distance / segments`` bits, for every l. The first
segments of such a chain must agree entirely: they are the posting key, and a candidate must keep every longer
chain's budget before its whole Hamming distance is taken.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.llm import copies
from fieldlake.llm.common import LOWER, mixed, raw, slices, squeezed, stage, words
from fieldlake.llm.graph import components

BITS = 64
SEED = 42


def short_fingerprints(column: pa.Array, n: int) -> np.ndarray:
    """The 64 bits of every text's fingerprint."""
    data, offsets = raw(column)
    data = LOWER[data]
    starts, ends, owner = words(data, offsets)
    rows = len(column)
    heads = np.searchsorted(owner, np.arange(rows + 1))
    # the words with one space between them: a shingle is one span
    lengths = ends - starts
    to = np.cumsum(lengths + 1) - (lengths + 1)
    flat = np.full(int((lengths + 1).sum()), 32, np.uint8)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat[np.repeat(to, lengths) + at] = data[np.repeat(starts, lengths) + at]
    body, stop = flat.tobytes(), to + lengths
    counts = np.diff(heads)
    shingle_counts = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    row_of = np.repeat(np.arange(rows), shingle_counts)
    first = np.arange(len(row_of)) - np.repeat(np.cumsum(shingle_counts) - shingle_counts, shingle_counts) + heads[row_of]
    last = np.minimum(first + n, heads[row_of + 1]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(body[a:b], SEED) for a, b in zip(to[first].tolist(), stop[last].tolist(), strict=True)),
                    np.uint64, len(row_of))
    result = np.zeros(rows, np.uint64)
    filled = np.flatnonzero(shingle_counts)
    if len(filled):
        edge = np.searchsorted(row_of, filled)
        total = shingle_counts[filled]
        for bit in range(BITS):
            ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), edge)
            result[filled] |= (2 * ones > total).astype(np.uint64) << np.uint64(bit)
    return result


def _fingerprints(n: int):
    def run(batches):
        for batch in slices(batches, "__text"):
            found = short_fingerprints(batch.column("__text"), n)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(found.view(np.int64))], ["id", "fp"])
    return run


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``id``, ``fp`` (64 bits as a long) of every row: bit set when over half the shingles' hashes set it.

    Shingles are runs of ``shingle`` lower-cased words, repeats included; fewer words give the whole sequence, none
    (also a null text) gives zero.
    """
    return (docs.select(F.col(id).alias("__id"), F.col(text).alias("__text"))
            .mapInArrow(_fingerprints(shingle), f"id {docs.schema[id].dataType.simpleString()}, fp long"))


def _spans(segments: int) -> list[int]:
    """Bit masks of the segments."""
    edges = [round(k * BITS / segments) for k in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chains(segments: int, distance: int) -> tuple[int, list[list[int]]]:
    """Length of the clean start of a chain, and for each start the masks of its first 1, 2, ... segments."""
    spans = _spans(segments)
    clean = max(n for n in range(1, segments + 1) if n * distance < segments)
    masks = [[reduce(int.__or__, (spans[(i + j) % segments] for j in range(n))) for n in range(1, segments + 1)]
             for i in range(segments)]
    return clean, masks


def _mask(masks: list[list[int]], n: int) -> Column:
    """The mask of the first ``n`` segments of the row's chain."""
    return F.element_at(F.array(*[F.lit(_signed(m[n - 1])) for m in masks]), F.col("i") + 1)


def links(prints: DataFrame, distance: int = 2, segments: int = 5, bucket: int = 64) -> DataFrame:
    """Edges ``a``, ``b`` that connect exactly the fingerprints (distinct column ``fp``) at most ``distance`` bits apart.

    Buckets of up to ``bucket`` fingerprints are compared pair by pair. The fingerprints of fuller buckets are linked
    without pairs: each lists all values at most ``distance / 2`` bits away, and those that share a value, which are
    at most ``distance`` apart, are linked to the smallest of them. So no link is lost and no bucket is squared.
    """
    if distance < 0 or distance % 2 or distance >= segments:
        raise ValueError("distance must be even and smaller than the number of segments")
    clean, masks = _chains(segments, distance)
    posted = (prints.select("fp", F.explode(F.array(*[F.lit(i) for i in range(segments)])).alias("i"))
              .withColumn("key", F.col("fp").bitwiseAND(_mask(masks, clean))))
    sizes = posted.groupBy("i", "key").agg(F.count("*").alias("n")).filter("n > 1")
    held = stage(posted.join(sizes, ["i", "key"]).select("i", "key", "fp", (F.col("n") <= bucket).alias("few")), "postings")
    few = held.filter("few")
    x = F.col("a").bitwiseXOR(F.col("b"))
    pairs = (few.select("i", "key", F.col("fp").alias("a")).join(few.select("i", "key", F.col("fp").alias("b")), ["i", "key"])
             .filter("a < b"))
    for n in range(clean + 1, segments):
        pairs = pairs.filter(F.bit_count(x.bitwiseAND(_mask(masks, n))) <= n * distance // segments)
    pairs = pairs.filter(F.bit_count(x) <= distance).select("a", "b")
    flips = [0] + [sum(1 << b for b in c) for k in range(1, distance // 2 + 1) for c in combinations(range(BITS), k)]
    near = (held.filter("not few").select("fp").distinct()
            .select("fp", F.explode(F.array(*[F.lit(_signed(v)) for v in flips])).alias("flip"))
            .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value")))
    lowest = near.groupBy("value").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).filter("b < top")
    stars = near.join(lowest, "value").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2,
                    segments: int = 5) -> DataFrame:
    """One row per document: ``id``, ``fp`` and ``component``, the smallest id reachable over links.

    Equal fingerprints link at any group size because only distinct ones are compared. Rows with a repeated id give a
    row each. A null id takes part; a component of null ids alone is null. No rows give no rows. Other columns are
    not read.
    """
    prints = stage(fingerprints(docs, id, text, shingle), "fingerprints")
    groups = stage(prints.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    roots = components(links(groups.select("fp"), distance, segments))
    rooted = groups.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stage(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.join(smallest, "root").select("fp", "component")
    return prints.join(named, "fp").select("id", "fp", "component")


WORDS = 24  # 64-bit words of a long fingerprint
CHAIN = 16  # bits of its segments: a posting key holds a segment without differences
LANES = np.uint64(0x0101010101010101)  # the lowest bit of every byte


def long_fingerprints(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """``WORDS`` words of SimHash bits of every row's distinct shingle hashes (by row), and its posting keys: one for each
    segment, made of its bits and the smallest hashes of two of the words."""
    seeds = mixed(np.arange(1, WORDS + 1, dtype=np.uint64))
    parts = WORDS * 64 // CHAIN
    one = np.arange(parts) % WORDS  # a pair of words for each segment, all pairs different
    two = (one + 1 + np.arange(parts) // WORDS) % WORDS
    prints = np.zeros((rows, WORDS), np.uint64)
    least = np.zeros((rows, WORDS), np.uint64)
    filled, edge, total = np.unique(row, return_index=True, return_counts=True)
    # blocks of at most 255 shingles of a row: eight bits are counted at once, each in a byte of a 64-bit sum
    blocks = -(-total // 255)
    first = np.cumsum(blocks) - blocks
    block = np.repeat(edge, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    for w in range(WORDS if len(filled) else 0):
        g = mixed(h ^ seeds[w])
        least[filled, w] = np.minimum.reduceat(g, edge)
        for bit in range(8):
            sums = np.add.reduceat((g >> np.uint64(bit)) & LANES, block).astype("<u8")
            ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
            set_ = (2 * ones > total[:, None]).astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(bit))
            prints[filled, w] |= np.bitwise_or.reduce(set_, axis=1)
    bits = np.unpackbits(prints.view(np.uint8), axis=1).reshape(rows, parts, CHAIN)
    segments = (bits @ (1 << np.arange(CHAIN, dtype=np.int64)) + (np.arange(parts, dtype=np.int64) << CHAIN)).astype(np.uint64)
    return prints, mixed(mixed(segments ^ least[:, one]) + least[:, two])


def _long_prints(n: int):
    def run(batches):
        for batch in slices(batches, "__text"):
            rows = batch.num_rows
            h, row = copies.sets(batch.column("__text"), n)
            size, mark = copies.marks(h, row, rows)
            _, keys = long_fingerprints(h, row, rows)
            keys = copies.lists(keys[size > 0].view(np.int64).ravel(), np.where(size > 0, keys.shape[1], 0))
            short = short_fingerprints(batch.column("__text"), n)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), squeezed(batch.column("__text")), batch.column("__at"), pa.array(size.astype(np.int64)), mark, keys,
                                              pa.array(short.view(np.int64))], ["id", "text", "at", "n", "mark", "keys", "fp"])
    return run


def similar_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every row, for copies that a distance of a few bits cannot find.

    Sets of shingles of a Jaccard similarity s differ in arccos(2s / (1 + s)) / pi of their SimHash bits: 15 % at 0.8. The
    fingerprint has ``WORDS * 64`` bits, cut into segments of ``CHAIN`` bits. Candidates agree in a whole segment and in the
    smallest hashes of two of the fingerprint's words, which similar sets share with a chance of s each: 64 bits in all, so that
    unlike texts do not fill a posting list however many there are. Texts whose 64-bit fingerprints pigeonring links (``links``, as in
    ``near_duplicates``) are candidates too. ``copies.grouped`` compares the whole sets of shingles of
    candidates, so nothing is joined below the similarity. Which lists two texts share is a matter of chance: of pairs
    above the threshold most meet in one of them (the README has figures). Rows with equal sets are one, texts without words too; rows that
    share an id are judged by their own texts. Rows without an id are left out, no rows give no rows.
    """
    return _similar(docs, id, text, shingle, similarity).select("id", F.col("least.id").alias("component"))


def _mark(text: str) -> Column:
    """Tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _ring_pairs(prints: DataFrame, shingle: int) -> DataFrame:
    """``a``, ``b``: candidates among sets, by the smallest ``at`` of each. Every set meets the first one with its 64-bit fingerprint, and
    the first ones of fingerprints that pigeonring links (``links``) meet. A table without the fingerprints ``fp`` has plain texts."""
    if "fp" not in prints.columns:
        prints = prints.join(fingerprints(prints, "at", "text", shingle).withColumnRenamed("id", "at"), "at")
    filled = prints.filter("n > 0").select("at", "mark", "fp")
    short = stage(filled.select("mark", "fp").distinct().join(filled.groupBy("mark").agg(F.min("at").alias("node")), "mark").select("fp", "node"), "short")
    lowest = stage(short.groupBy("fp").agg(F.min("node").alias("first")), "lowest")
    one, two = (lowest.select(F.col("fp").alias(x), F.col("first").alias(f"n{x}")) for x in "ab")
    ends = links(lowest.select("fp")).join(one, "a").join(two, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    equal = short.join(lowest, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return stage(equal.unionAll(ends).filter("a <> b").distinct(), "ring")


def _similar(docs: DataFrame, id: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """``id``, ``mark`` (of the text) and ``least``, the smallest (id, mark) reachable, of every row with an id."""
    kind = docs.schema[id].dataType.simpleString()
    prints = stage(docs.select(F.struct(F.col(id).alias("id"), _mark(text).alias("mark")).alias("__id"), F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__at"))
                   .filter("__id.id is not null")
                   .mapInArrow(_long_prints(shingle), f"id struct<id:{kind},mark:bigint>, text binary, at long, n long, mark binary, keys array<long>, fp long"), "prints")
    named = copies.grouped(prints, shingle, round(100 * similarity), _ring_pairs(prints, shingle))
    return prints.select("id", "mark").join(named, "mark").select("id.id", "id.mark", "least")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that are the smallest (id, mark of the text) of their component of similar documents; all columns stay.

    Rows without an id are kept. Rows that share an id leave only if their own text is a copy. Of rows that share both id
    and text, one stays, whichever its other columns are.
    """
    found = _similar(docs, id, text, shingle, similarity)
    dropped = found.filter(F.struct("id", "mark") != F.col("least")).select(F.col("id").alias("__dropped"), F.col("mark").alias("__dropped_mark")).distinct()
    marked = docs.withColumn("__mark", _mark(text))
    kept = marked.join(dropped, (marked[id] == F.col("__dropped")) & (marked["__mark"] == F.col("__dropped_mark")), "left_anti")
    once = kept.filter(F.col(id).isNotNull()).dropDuplicates([id, "__mark"])
    return once.unionByName(kept.filter(F.col(id).isNull())).drop("__mark")

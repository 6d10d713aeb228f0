"""Components of texts whose whole sets of word shingles are similar, from lists of candidates; shared by the near-copy operators.

An operator gives every text some keys; texts that share a key are candidates, and a candidate is linked only after the whole
sets have been compared. No list is cut, and no group is squared:

1. Equal sets are one node, so copies of a text cost one row each.
2. Each node is compared with two leaders (first members) of its lists, chosen by hash, then with two that are not in its
   component yet (``LEADERS``). Then every list compares one member of each of its components with one of the largest (``_delegates``).
   A group of near copies is joined by a few comparisons per member.
3. What is left are pairs of a list in different components. Short lists (``SHORT``) are compared pair by pair. Nodes of
   longer lists, families of texts that are alike without being copies, are joined on their rarest elements instead
   (``_rare_pairs``): members of a family share mostly frequent ones. That is exact for those nodes.

So two similar texts with a common key end in one component. Links are never expanded to all pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from fieldlake.llm.common import LOWER, mixed, prefix_hash, raw, shingles, span_hash, squeezed, stage, unsqueezed, words
from fieldlake.llm.graph import components

LEADERS = (2, 2)  # leaders that a node is compared with in each pass
SHORT = 8  # members of a list that is compared pair by pair
PER_PART = 2000  # pairs of one leader that meet in one task
SLICE = 1 << 20  # bytes of text of one pass, of each side


def sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text and their rows, by row and hash."""
    data, offsets = raw(column)
    data = LOWER[data]
    starts, ends, owner = words(data, offsets)
    h, row = shingles(span_hash(prefix_hash(data), starts, ends), owner, len(column), n)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))


def marks(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, pa.Array]:
    """Size of every row's set and its mark of 128 bits: two sums over the elements, equal for equal sets."""
    size = np.bincount(row, minlength=rows)
    filled = np.flatnonzero(size)
    sums = np.zeros((rows, 2), np.uint64)
    if len(filled):
        edge = np.searchsorted(row, filled)
        for k in range(2):
            sums[filled, k] = mixed(np.add.reduceat(mixed(h ^ np.uint64(k + 1)), edge) + size[filled].astype(np.uint64))
    return size, pa.array([m.tobytes() for m in sums], pa.binary())


def _alike(percent: int) -> Column:
    """Sizes ``na`` and ``nb`` allow the similarity."""
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent


def _confirmed(n: int, percent: int):
    def run(batches):
        for batch in unsqueezed(batches, ["ta", "tb"], 2 * SLICE):
            (ha, ra), (hb, rb) = (sets(batch.column(t), n) for t in ("ta", "tb"))
            h, row = np.concatenate([ha, hb]), np.concatenate([ra, rb])
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            twice = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
            both = np.bincount(row[1:][twice], minlength=batch.num_rows)
            union = np.bincount(row, minlength=batch.num_rows) - both
            yield batch.filter(pa.array(100 * both >= percent * union)).select(["a", "b"])
    return run


def _linked(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The distinct rows ``a``, ``b`` of ``pairs`` whose whole sets are similar enough; a ``b`` with many partners is spread
    over as many parts as they need."""
    pairs = stage(pairs.distinct(), "pairs")
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PER_PART).cast("int").alias("parts"))
    copies = (texts.select(F.col("node").alias("b"), F.col("text").alias("tb")).join(parts, "b")
              .select("b", "tb", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    spread = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    both = spread.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(copies, ["b", "part"])
    return stage(both.select("a", "b", "ta", "tb").mapInArrow(_confirmed(n, percent), "a long, b long"), "links")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return (rows.join(roots.withColumnRenamed("root", "__root"), "node", "left")
            .withColumn("root", F.coalesce("__root", "node")).drop("__root"))


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``node``, ``root`` after more links: only the components they join are looked at again."""
    if roots is None:
        return stage(components(links), "roots")
    ends = _rooted(links.withColumnRenamed("a", "node"), roots).select(F.col("root").alias("ra"), F.col("b").alias("node"))
    joined = components(_rooted(ends, roots).filter("ra <> root").select(F.col("ra").alias("a"), F.col("root").alias("b")).distinct())
    moved = joined.select(F.col("node").alias("root"), F.col("root").alias("__to"))
    known = roots.join(moved, "root", "left").select("node", F.coalesce("__to", "root").alias("root"))
    return stage(known.unionAll(joined.join(roots.select("node"), "node", "left_anti").select("node", "root")), "roots")


def _mixed(led: DataFrame, roots: DataFrame) -> DataFrame:
    """Members, with their ``root``, of the lists that hold more than one component."""
    every = _rooted(led.select("key", "node", "n", "members"), roots)
    several = every.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("top")).filter("low < top").select("key")
    return stage(every.join(several, "key", "left_semi"), "rest")


def _delegates(led: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Of every list, one member of each component beside one of the largest component: ``a``, ``b``.

    Which member stands for a component differs from list to list, so a text that shares many lists with a large group is
    compared with many of its members, and a list costs as many pairs as it has components.
    """
    first = F.min_by(F.struct("node", "n"), F.xxhash64("node", "key"))
    parts = _rooted(led.select("key", "node", "n"), roots).groupBy("key", "root").agg(first.alias("one"), F.count("*").alias("size"))
    largest = parts.groupBy("key").agg(F.max_by(F.struct("root", "one"), F.struct("size", "root")).alias("top"))
    both = parts.join(largest, "key").filter(F.col("root") != F.col("top.root"))
    return both.select(F.col("one.node").alias("a"), F.col("one.n").alias("na"), F.col("top.one.node").alias("b"), F.col("top.one.n").alias("nb")).filter(_alike(percent)).select("a", "b")


def _rare_pairs(texts: DataFrame, n: int, percent: int, roots: DataFrame) -> DataFrame:
    """Candidates ``a``, ``b`` in different components among ``texts``: they share one of each one's rarest elements.

    Sets of sizes x <= y with the similarity share at least a = percent (x + y) / (100 + percent) elements. In one order of all
    elements, their first common one has at most x - a elements before it in the one and y - a in the other: of the smaller
    set only its first (100 - percent) / (100 + percent) are looked at, of the larger one (100 - percent) / 100. A set that has so many
    elements of its own (those of no other set come first) looks for no partner.
    """
    def split(batches):
        for batch in unsqueezed(batches, ["text"], SLICE):
            h, row = sets(batch.column("text"), n)
            counts = np.bincount(row, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(counts), lists(h.view(np.int64), counts)], ["node", "n", "h"])

    elements = texts.mapInArrow(split, "node long, n long, h array<long>").select("node", "n", F.explode("h").alias("h"))
    known = elements.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    # elements of one set only come first and are never posted; the others follow by rarity
    ranked = (elements.join(known, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("order"))
              .withColumn("alone", F.col("n") - F.size("order"))
              .withColumn("reach", F.floor(F.col("n") * (100 - percent) / 100).cast("int") + 1 - F.col("alone"))
              .filter("reach > 0"))
    posted = _rooted(ranked.select("node", "n", "alone", F.posexplode(F.slice("order", F.lit(1), F.col("reach").cast("int"))).alias("place", "e"))
                     .select("node", "n", F.col("e.h").alias("h"), (F.col("place") + F.col("alone")).alias("place")), roots)
    posted = stage(posted, "rare")
    several = posted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("top")).filter("low < top").select("h")
    posted = posted.join(several, "h", "left_semi")
    one, two = (posted.select("h", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("place").alias(f"p{x}"), F.col("root").alias(f"r{x}")) for x in "ab")
    one = one.filter(F.col("pa") * (100 + percent) <= F.col("na") * (100 - percent))
    need = lambda x: (F.col(f"n{x}") - F.col(f"p{x}")) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent  # noqa: E731  enough elements are left
    return one.join(two, "h").filter("ra <> rb and na <= nb").filter(_alike(percent)).filter(need("a") & need("b")).select("a", "b").distinct()


def _squeezed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("at"), squeezed(batch.column("text"))], ["at", "text"])


def grouped(prints: DataFrame, shingle: int, percent: int, near: DataFrame | None = None) -> DataFrame:
    """``mark``, ``least``: the smallest id in the component of every set.

    ``prints`` is a stored table with a row per text: ``id`` (of any ordered type), ``text`` (plain, or binary as ``squeezed`` makes it),
    ``at`` (a number of its own), ``n`` (size of the set), ``mark`` (of the set) and ``keys``. Sets link when 100 * intersection >= ``percent`` * union, with 50 <= ``percent`` <= 100.
    Equal sets are one node whether they have keys or not. ``near`` are more candidates: ``a`` and ``b``, the smallest ``at`` of their sets.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be between 50 and 100")
    # a node is the first row of its set: it brings its keys along, so that no join has to find them again
    one = F.min(F.struct("at", "n", "keys")).alias("one")
    nodes = stage(prints.groupBy("mark").agg(one, F.min("id").alias("low")).select("mark", F.col("one.at").alias("node"), "low", "one.n", "one.keys"), "nodes")
    posted = nodes.select("node", "n", F.explode("keys").alias("key"))
    # most keys have one member: the others are found first, then their leader, the first member
    several = posted.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    held = stage(posted.join(several, "key").select("key", "node", "n", "members"), "held")
    used = held.select("node")
    if near is not None:
        used = used.unionAll(near.select("a")).unionAll(near.select("b"))
    plain = prints.select("at", "text")
    if plain.schema["text"].dataType != BinaryType():
        plain = plain.mapInArrow(_squeezed, "at long, text binary")
    texts = stage(plain.withColumnRenamed("at", "node").join(used.distinct(), "node"), "texts")

    roots = None if near is None else _merged(None, _linked(near, texts, shingle, percent))
    first = held.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"))
    meeting = held.join(first, "key").select("node", F.col("n").alias("na"), F.col("first.node").alias("leader"), F.col("first.n").alias("nb"))
    meeting = stage(meeting.filter("node <> leader").filter(_alike(percent)).select("node", "leader").distinct(), "near")
    for leaders in LEADERS:
        left = meeting
        if roots is not None:
            mine = _rooted(meeting, roots).select(F.col("node").alias("a"), F.col("root").alias("ra"), F.col("leader").alias("node"))
            left = _rooted(mine, roots).filter("ra <> root").select(F.col("a").alias("node"), F.col("node").alias("leader"))
        # a node has at most one leader for each of its keys
        some = F.array_sort(F.collect_list(F.struct(F.xxhash64("node", "leader").alias("order"), "leader")))
        chosen = left.groupBy("node").agg(F.slice(some, 1, leaders).alias("some"))
        found = _linked(chosen.select(F.col("node").alias("a"), F.explode("some.leader").alias("b")), texts, shingle, percent)
        roots = _merged(roots, found)

    roots = _merged(roots, _linked(_delegates(held, roots, percent), texts, shingle, percent))

    rest = _mixed(held, roots)
    few = rest.filter(F.col("members") <= SHORT)
    one, two = (few.select("key", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("root").alias(f"r{x}")) for x in "ab")
    pairs = one.join(two, "key").filter("ra < rb").filter(_alike(percent)).select("a", "b")
    many = stage(rest.filter(F.col("members") > SHORT).select("node").distinct(), "many")
    if not many.isEmpty():
        pairs = pairs.unionAll(_rare_pairs(texts.join(many, "node", "left_semi"), shingle, percent, roots))
    roots = _merged(roots, _linked(pairs, texts, shingle, percent))

    rooted = stage(_rooted(nodes.select("mark", "node", "low"), roots), "rooted")
    return rooted.join(rooted.groupBy("root").agg(F.min("low").alias("least")), "root").select("mark", "least")

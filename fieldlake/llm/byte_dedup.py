"""Removal of byte strings that start more than once in all documents, by suffix arrays of shards.

A string of ``width`` bytes can only repeat where a content-defined anchor repeats: of the hashes of all
``GRAM``-byte strings within it the smallest is an anchor, a choice that depends on the bytes alone. So

1. anchors are counted, and only repeated ones go on, with a hash of the bytes around them (the context: all strings
   that hold the anchor lie in it);
2. contexts that occur more than once as a whole are repeated throughout; of each, one stays as a witness;
3. the other contexts of an anchor are brought together in shards. A shard sorts its contexts in a suffix array
   (Larsson-Sadakane) and reads the repeated strings off the common prefixes (Kasai). An anchor with more than
   ``SHARD_CONTEXTS`` different contexts is spread over several shards;
4. the sorted strings of an anchor that was spread are merged across its shards by binary search.

Repeats found are spans of documents; their union is cut out of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.common import mixed, prefix_hash, raw, slices, span_hash, stage
from fieldlake.llm.suffix_array import repeated_starts

WIDTH = 200
GRAM = 40
SHARD_CONTEXTS = 4096
SHARD_BYTES = 1 << 19  # contexts sorted at once, which fit in a processor cache: as many whole shards as fit
_LOW = np.uint64((1 << 20) - 1)


def _anchors(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all rows: places, hashes and rows. Every ``width``-byte string of a row holds one."""
    n, w = len(data), width - gram + 1
    row_sizes = np.diff(offsets)
    if n < width or not (row_sizes >= width).any():
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    sums = prefix_hash(data)
    at = np.arange(n - gram + 1)
    high = span_hash(sums, at, at + gram) | _LOW  # ordered by the upper 44 bits, then by place
    key = (high ^ _LOW) | (at.astype(np.uint64) & _LOW)
    smallest, reach = key, 1
    while reach * 2 <= w:
        smallest = np.minimum(smallest[:-reach], smallest[reach:])
        reach *= 2
    if reach < w:
        smallest = np.minimum(smallest[:len(smallest) - (w - reach)], smallest[w - reach:])
    # strings that lie within a row
    first = np.repeat(offsets[:-1], np.maximum(row_sizes - width + 1, 0))
    step = np.maximum(row_sizes - width + 1, 0)
    starts = first + np.arange(len(first)) - np.repeat(np.cumsum(step) - step, step)
    own = np.repeat(np.arange(len(row_sizes)), step)
    place = starts + ((smallest[starts] & _LOW).astype(np.int64) - starts & int(_LOW))
    changed = np.ones(len(place), bool)
    changed[1:] = place[1:] != place[:-1]
    place, own = place[changed], own[changed]
    order = np.argsort(place, kind="stable")
    place, own = place[order], own[order]
    changed = np.ones(len(place), bool)
    changed[1:] = place[1:] != place[:-1]
    place, own = place[changed], own[changed]
    h = high[place] >> np.uint64(20)
    # of close anchors with the same bytes (periodic text) those at the ends of the run and one in each 40 bytes stay
    step_size = w // 4
    like = (h[1:] == h[:-1]) & (own[1:] == own[:-1]) & (place[1:] - place[:-1] <= step_size)
    kept = np.ones(len(place), bool)
    block = place // step_size
    kept[1:-1] = ~(like[:-1] & like[1:] & (block[1:-1] == block[:-2]))
    return place[kept], h[kept], own[kept]


def _contexts(width: int, gram: int):
    def run(batches):
        for batch in slices(batches, "__text"):
            data, offsets = raw(batch.column("__text"))
            place, h, own = _anchors(data, offsets, width, gram)
            low = np.maximum(place - (width - gram), offsets[own])
            high = np.minimum(place + width, offsets[own + 1])
            around = span_hash(prefix_hash(data), low, high) if len(place) else np.empty(0, np.uint64)
            around = mixed(around ^ (place - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            rows = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id").take(rows), batch.column("__mark").take(rows), pa.array(low - offsets[own]),
                 pa.array((high - low).astype(np.int32)), pa.array(h.astype(np.int64)), pa.array(around.view(np.int64))],
                ["id", "mark", "low", "size", "anchor", "around"])
    return run


def _cut_out(batches):
    """Bytes of the wanted contexts of each document."""
    for batch in slices(batches, "__text"):
        data, offsets = raw(batch.column("__text"))
        wanted = batch.column("__wanted")
        counts = np.diff(wanted.offsets.to_numpy()) if len(wanted) else np.empty(0, np.int64)
        rows = np.repeat(np.arange(batch.num_rows), counts)
        structs = wanted.flatten()
        fields = dict(zip((f.name for f in structs.type), structs.flatten(), strict=True))
        low, size = (fields[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("low", "size"))
        body, base = data.tobytes(), offsets[rows] + low
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("__id").take(take), batch.column("__mark").take(take), fields["low"], fields["anchor"], fields["part"],
             fields["parts"], fields["known"],
             pa.array([body[a:a + s] for a, s in zip(base.tolist(), size.tolist(), strict=True)], pa.binary())],
            ["id", "mark", "low", "anchor", "part", "parts", "known", "body"])


def _runs(rows: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans covered by ``width``-byte strings at the given places of each row."""
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + width)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(rows)) - 1
    return rows[heads], starts[heads], starts[tails] + width


def _sorted_shards(width: int):
    """Of each shard: spans of repeated strings (kind 0), and of spread anchors all different strings (kind 1).

    Rows come sorted by (anchor, part); whole shards are gathered until SHARD_BYTES and sorted in one suffix array. That
    strings of several shards meet in it only finds repeats that are true.
    """
    names = ["kind", "id", "mark", "low", "high", "w1", "w2", "shard", "sure"]

    def solve(table: pa.Table):
        bodies = table.column("body").to_pylist()
        part, place, number = repeated_starts(bodies, width)
        known = table.column("known").to_numpy().astype(bool)
        spread = table.column("parts").to_numpy() > 1
        low = table.column("low").to_numpy()
        if not len(part):
            return
        first = np.ones(len(number), bool)
        first[1:] = number[1:] != number[:-1]
        group = np.cumsum(first) - 1
        # contexts of one document overlap, so equal strings count by their places; a witness stands for several places
        code = table.column("id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)[part]
        mark, at = table.column("mark").to_numpy()[part], low[part] + place
        order = np.lexsort((at, mark, code, group))
        other = np.ones(len(order), bool)
        other[1:] = False
        for column in (group, code, mark, at):
            other[1:] |= column[order][1:] != column[order][:-1]
        repeated = (np.bincount(group[order][other]) > 1) | (np.bincount(group, known[part]) > 0)
        found = repeated[group] & ~known[part]
        rows, a, b = _runs(part[found], place[found], width)
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(rows), np.int8)), table.column("id").combine_chunks().take(take), table.column("mark").combine_chunks().take(take),
             pa.array(low[rows] + a), pa.array(low[rows] + b), *[pa.array(np.zeros(len(rows), np.int64))] * 3,
             pa.array(np.ones(len(rows), bool))], names)
        # one of each different string of a spread anchor, for the merge across its shards
        one = np.flatnonzero(spread[part])
        if len(one):
            shard = mixed(table.column("anchor").to_numpy().astype(np.uint64) * np.uint64(1 << 16) + table.column("part").to_numpy().astype(np.uint64)).view(np.int64)
            pairs = np.stack([group[one], shard[part[one]]])
            _, pick = np.unique(pairs, axis=1, return_index=True)
            one = one[pick]
            digests = [xxhash.xxh3_128_intdigest(bodies[p][s:s + width]) for p, s in zip(part[one].tolist(), place[one].tolist(), strict=True)]
            w1 = np.array([d >> 64 for d in digests], np.uint64).view(np.int64)
            w2 = np.array([d & 0xFFFFFFFFFFFFFFFF for d in digests], np.uint64).view(np.int64)
            take = pa.array(part[one])
            at = low[part[one]] + place[one]
            sure = pa.array(repeated[group[one]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(one), np.int8)), table.column("id").combine_chunks().take(take), table.column("mark").combine_chunks().take(take),
                 pa.array(at), pa.array(at + width), pa.array(w1), pa.array(w2), pa.array(shard[part[one]]), sure], names)

    def run(batches):
        waiting, size = [], 0
        for batch in batches:
            anchors, parts = batch.column("anchor").to_numpy(), batch.column("part").to_numpy()
            lengths = np.diff(raw(batch.column("body"))[1])
            change = np.flatnonzero((anchors[1:] != anchors[:-1]) | (parts[1:] != parts[:-1])) + 1
            last = 0
            for edge in [*change.tolist(), batch.num_rows]:
                piece = batch.slice(last, edge - last)
                if size >= SHARD_BYTES and waiting and not _same(waiting[-1], piece):
                    yield from solve(pa.Table.from_batches(waiting))
                    waiting, size = [], 0
                waiting.append(piece)
                size += int(lengths[last:edge].sum())
                last = edge
        if waiting:
            yield from solve(pa.Table.from_batches(waiting))
    return run


def _same(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
    return all(a.column(n)[a.num_rows - 1] == b.column(n)[0] for n in ("anchor", "part"))


def _merged(batches):
    """Strings that several shards hold, by binary search of each shard's sorted strings in those merged before.

    The same place may come from two shards; it is a repeat only if a shard has seen the string at another place.
    """
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    w1, w2, shard, mark, low, sure = (table.column(n).to_numpy() for n in ("w1", "w2", "shard", "mark", "low", "sure"))
    code = table.column("id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    key = mixed(w1.view(np.uint64) ^ (w2.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    hit = np.zeros(len(key), bool)
    order = np.lexsort((key, shard))
    edges = np.flatnonzero(np.append(True, shard[order][1:] != shard[order][:-1]))
    seen, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        mine = order[a:b]
        at = np.searchsorted(seen, key[mine])
        met = at < len(seen)
        met[met] = seen[at[met]] == key[mine[met]]
        met[met] = (w1[mine[met]] == w1[owner[at[met]]]) & (w2[mine[met]] == w2[owner[at[met]]])
        here, there = mine[met], owner[at[met]]
        true = (mark[here] != mark[there]) | (low[here] != low[there]) | (code[here] != code[there]) | sure[here] | sure[there]
        hit[here[true]] = True
        hit[there[true]] = True
        fresh = mine[~met]
        into = np.searchsorted(seen, key[fresh])
        seen, owner = np.insert(seen, into, key[fresh]), np.insert(owner, into, fresh)
    found = pa.array(np.flatnonzero(hit))
    yield from table.select(["id", "mark", "low", "high"]).take(found).to_batches()


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM,
                   shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """``id, mark, low, high``: spans, possibly overlapping, whose union are the bytes to remove.

    ``mark`` is a hash of the text; rows that repeat both are further places of the same strings.
    """
    kind = docs.schema[id].dataType.simpleString()
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(id).alias("__id"), F.xxhash64(body).alias("__mark"), body.alias("__text"))
    anchors = source.mapInArrow(_contexts(width, gram), f"id {kind}, mark long, low long, size int, anchor long, around long")
    common = anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    held = stage(anchors.join(common, "anchor", "left_semi"), "anchors")
    kinds = stage(held.groupBy("anchor", "around").agg(F.count("*").alias("n"), F.min(F.struct("id", "mark", "low", "size")).alias("x")), "contexts")
    whole = (held.join(kinds.filter("n > 1").select("anchor", "around"), ["anchor", "around"], "left_semi")
             .select("id", "mark", "low", (F.col("low") + F.col("size")).alias("high")))
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    parts = F.ceil(F.col("kinds") / shard_contexts)
    wanted = (kinds.join(several, "anchor")
              .select("x.id", "x.mark", F.struct(F.col("x.low").alias("low"), F.col("x.size").alias("size"), "anchor",
                                                 F.pmod(F.xxhash64("around"), parts).alias("part"), parts.alias("parts"),
                                                 (F.col("n") > 1).alias("known")).alias("c"))
              .groupBy("id", "mark").agg(F.collect_list("c").alias("__wanted")))
    bodies = (source.join(wanted, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__mark") == F.col("mark"))).select("__id", "__mark", "__text", "__wanted")
              .mapInArrow(_cut_out, f"id {kind}, mark long, low long, anchor long, part long, parts long, known boolean, body binary"))
    sharded = bodies.repartition(F.col("anchor"), F.col("part")).sortWithinPartitions("anchor", "part")
    solved = stage(sharded.mapInArrow(_sorted_shards(width), f"kind byte, id {kind}, mark long, low long, high long, w1 long, w2 long, shard long, sure boolean"), "spans")
    merged = (solved.filter("kind = 1").select("id", "mark", "low", "high", "w1", "w2", "shard", "sure").repartition("w1", "w2")
              .mapInArrow(_merged, f"id {kind}, mark long, low long, high long"))
    return whole.unionByName(solved.filter("kind = 0").select("id", "mark", "low", "high")).unionByName(merged)


def _kept(batches):
    for batch in slices(batches, "__text"):
        data, offsets = raw(batch.column("__text"))
        spans = batch.column("__spans")
        removed, count, kept, lows, highs, starts = [], [], [], [], [], [0]
        lists = spans.to_pylist()
        for row in range(batch.num_rows):
            text = data[offsets[row]:offsets[row + 1]]
            own = sorted((s["low"], s["high"]) for s in lists[row] or [])
            joined: list[list[int]] = []
            for a, b in own:
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            left, at = [], 0
            for a, b in joined:
                left.append(text[at:a].tobytes())
                at = b
            left.append(text[at:].tobytes())
            kept.append(b"".join(left))
            lows += [a for a, _ in joined]
            highs += [b for _, b in joined]
            starts.append(len(lows))
            count.append(len(text))
            removed.append(sum(b - a for a, b in joined))
        spans = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(lows, pa.int64()), pa.array(highs, pa.int64())], ["low", "high"]))
        yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), spans,
                                          pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "spans", "kept"])


def dedup_bytes(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, **options) -> DataFrame:
    """``id, n_bytes, n_removed, spans, kept`` of every row: the maximal removed runs and the bytes that are left.

    A byte goes if it is covered by a ``width``-byte string that also starts anywhere else, in this row or another.
    Every copy goes, the first too. Null texts are empty; rows that repeat id and text are further places; null
    ids are ids like others. Other columns are not read.
    """
    found = (repeated_spans(docs, id, text, width, **options).distinct().groupBy("id", "mark")
             .agg(F.collect_list(F.struct("low", "high")).alias("__spans")))
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(id).alias("__id"), F.xxhash64(body).alias("__mark"), body.alias("__text"))
    both = source.join(found, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__mark") == F.col("mark")), "left").select("__id", "__text", "__spans")
    return both.mapInArrow(_kept, f"id {docs.schema[id].dataType.simpleString()}, n_bytes long, n_removed long, "
                                  "spans array<struct<low:long,high:long>>, kept binary")

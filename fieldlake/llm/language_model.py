"""Smoothed n-gram scores from a weighted backoff automaton, and a word-count baseline.

States are the last words read, each with a failure arc to a shorter memory:

* pairs of words, with an arc for every word (and the end) seen after them;
* single words and the start of a text, with an arc for every word (and the end) seen after them;
* no memory, with an arc for every word of the training texts and one for all unknown words.

All states and arcs of the training texts count: ``FREQUENT`` and ``VERY_FREQUENT`` are 0. A share above 0 would lump words below
that share of all training words together as "any other word", in the states of one and of two words; such a word has no arc.

So the arcs grow with the corpus, and no task holds them all. Documents share batches of bounded size. A batch asks each bucket
of words for their counts and numbers and brings its own counts (``_wanted``, ``_told``). Then it sends each bucket of states what it has read there
(``_asked``); the bucket adds up the batches' counts and answers each with what it asked for (``_answered``). A word with much of
the corpus after it is dealt over as many buckets as its share needs. Answers come in the order of the question, so they name nothing.

Weights are absolutely discounted; the failure arcs carry what the discounts leave, and an arc's weight already holds
its share from the state below. One pass from left to right carries the state through a text and adds up logarithms.
Unknown words are one type, as in the baseline's V + 1.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fieldlake.llm.common import LOWER, mixed, prefix_hash, raw, span_hash, squeeze, squeezed, unsqueeze, unsqueezed, words

FREQUENT = 0.0
VERY_FREQUENT = 0.0
BATCH_BYTES = 6 << 20  # text that shares one look-up of counts
BUCKETS = 2  # buckets of states for each batch of text
SLICE = 1 << 19  # bytes of text of one pass

OTHER, START, END, FIRST = 0, 1, 2, 3  # numbers of any other word, of both ends of a text and of the first word
LOW = np.int64((1 << 32) - 1)


@dataclass
class Tokens:
    """Words of a chunk: the different hashes, which of them each word is, and its row."""

    unique: np.ndarray
    back: np.ndarray
    owner: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
        data = LOWER[data]
        starts, ends, owner = words(data, offsets)
        unique, back = np.unique(span_hash(prefix_hash(data), starts, ends), return_inverse=True)
        return Tokens(unique, back.astype(np.int32), owner.astype(np.int32))


def with_ends(values: np.ndarray, owner: np.ndarray, rows: int, end) -> np.ndarray:
    """Values of the words, with ``end`` after each row."""
    out = np.full(len(values) + rows, end, values.dtype)
    out[np.arange(len(values)) + owner] = values
    return out


def token_rows(owner: np.ndarray, rows: int) -> np.ndarray:
    return np.repeat(np.arange(rows), np.bincount(owner, minlength=rows) + 1)


def _discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once and twice else 0.5


@dataclass
class Totals:
    """What every task knows of the training texts."""

    total: int  # training tokens N, ends included
    distinct: int  # different ones V, the end included
    ends: int
    discount: float
    buckets: int
    frequent: float
    very_frequent: float

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """Probability without memory; all unknown words together have what the discounts of the known ones leave."""
        if not self.total:
            return np.ones(len(count))
        return np.where(count > 0, count - self.discount, self.discount * self.distinct) / self.total

    def above(self, count: np.ndarray, share: float) -> np.ndarray:
        return (count > 0) & (count >= share * (self.total - self.ends))


def _place(state: np.ndarray, part: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed((state.astype(np.uint64) << np.uint64(32)) + part.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _vocabulary(docs: pa.Table, buckets: int) -> tuple[list[tuple[pa.RecordBatch, Tokens]], np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of slices of a batch, its different words in order, their places by bucket and the edges of the buckets."""
    parts = [(b, Tokens.of(*raw(b.column("__text")))) for b in unsqueezed(docs.to_batches(), ["__text"], SLICE)]
    found = np.unique(np.concatenate([np.empty(0, np.uint64), *(t.unique for _, t in parts)]))
    bucket = found.view(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    return parts, found, order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values in order, which of them each value is, and the first place of each; in less memory than ``np.unique``."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    values, first = values[new], order[new]
    back = np.empty(len(order), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    return values, back, first


class Batch:
    """The tokens of a batch of documents and the different states and arcs they read, by bucket.

    ``pairs`` are (state of one word, token); a pair of two words is a state too, with ``triples`` (place of the pair, token).
    ``states`` are (bucket, word): a state that is dealt over several buckets is asked for in all of them. Their order depends on
    what the texts hold, not on the order of the rows.
    """

    def __init__(self, model: Totals, docs: pa.Table, told: pa.Table):
        parts, found, order, _ = _vocabulary(docs, model.buckets)
        counts, numbers = np.zeros(len(found) + 1), np.zeros(len(found) + 1, np.int32)
        counts[order], numbers[order] = _unpacked(told, "counts", LONG)[0], _unpacked(told, "numbers", INT)[0]
        at, row, rows, held = [], [], 0, [np.empty(0, bool)]
        while parts:
            batch, tokens = parts.pop(0)
            at.append(with_ends(np.searchsorted(found, tokens.unique).astype(np.int32)[tokens.back], tokens.owner, batch.num_rows, -1))
            row.append((rows + token_rows(tokens.owner, batch.num_rows)).astype(np.int32))
            rows += batch.num_rows
            held.append(batch.column("__held").to_numpy(zero_copy_only=False).astype(bool))
        self.rows = rows
        at, self.row = np.concatenate([np.empty(0, np.int32), *at]), np.concatenate([np.empty(0, np.int32), *row])
        end = at < 0
        self.count = np.where(end, model.ends, counts[at])
        number = numbers[at]
        learnt = ~np.concatenate(held)[self.row]

        one, two = (np.where(end, END, np.where(model.above(self.count, share), number, OTHER)).astype(np.int32)
                    for share in (model.frequent, max(model.frequent, model.very_frequent)))
        key = np.full(len(one), START, np.int64)
        key[1:] = np.where(end[:-1], START, one[:-1])
        key <<= 32
        key |= one
        del at, end, number, one
        pairs, pair, first = _distinct(key)
        del key
        n_pairs = np.bincount(pair, learnt, len(pairs)).astype(np.int32)
        # the state of two words before each token, where both are words of this text
        self.third = 2 + np.flatnonzero((two[:-2] >= FIRST) & (two[1:-1] >= FIRST)).astype(np.int32)
        triples, triple, _ = _distinct(pair[self.third - 1].astype(np.int64) << 32 | two[self.third])
        n_triples = np.bincount(triple, learnt[self.third], len(triples)).astype(np.int32)

        # a word with more than a bucket's share of all tokens is dealt over several, by the token after it
        self.u, at = np.unique(pairs >> 32, return_index=True)
        share = self.count[first[at] - 1]  # of the word before the token
        share[self.u == START] = model.ends
        share[self.u == OTHER] = model.total if model.frequent else 0
        parts = np.maximum(np.ceil(share / max(model.total, 1) * model.buckets).astype(np.int64), 1)
        u_of = np.searchsorted(self.u, pairs >> 32)
        bucket = _place(pairs >> 32, (mixed((pairs & LOW).astype(np.uint64)) % parts[u_of].astype(np.uint64)).astype(np.int64), model.buckets)
        many = np.flatnonzero(parts > 1)
        part = np.arange(parts[many].sum()) - np.repeat(np.cumsum(parts[many]) - parts[many], parts[many])
        spread = np.repeat(self.u[many], parts[many])
        self.states = np.unique(np.concatenate([bucket << 32 | pairs >> 32, _place(spread, part, model.buckets) << 32 | spread]))

        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        self.pairs, self.pair, self.bucket, self.n_pairs = pairs[order], rank[pair], bucket[order], n_pairs[order]
        triples = rank[triples >> 32].astype(np.int64) << 32 | triples & LOW
        order = np.argsort(triples, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        self.triples, self.triple, self.n_triples = triples[order], rank[triple], n_triples[order]


WANTED = "bucket int, batch long, words binary, n binary"
TOLD = "bucket int, batch long, numbers binary, counts binary, known binary"
ASKED = f"{TOLD}, u binary, pairs binary, v binary, n binary, triples binary, w binary, m binary"
ANSWERED = f"{TOLD}, follow binary, other binary, kinds binary, n binary, others binary, kindss binary, m binary, counted binary"
INT, LONG = np.dtype("<i4"), np.dtype("<i8")


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _packed(values: np.ndarray, edges: np.ndarray, kind: np.dtype) -> pa.Array:
    """Integers of each row as bytes: all first bytes, then all second ones and so on, so that the zeros of small numbers lie together
    and zstd has them in little."""
    planes = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(-1, kind.itemsize)
    return pa.array([squeeze(planes[a:b].T.tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())


def _unpacked(table: pa.Table, name: str, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All integers of a column and the edges of its rows."""
    rows = table.column(name).to_pylist()
    edges = np.cumsum([0, *(int.from_bytes(x[:8], "little") // kind.itemsize for x in rows)])
    out = np.empty(edges[-1], np.int64)
    for x, a, b in zip(rows, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        planes = np.frombuffer(unsqueeze(x), np.uint8).reshape(kind.itemsize, -1)
        out[a:b] = np.ascontiguousarray(planes.T).view(kind).ravel()
    return out, edges


def _nothing(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.table([pa.array([], kinds[part.split()[1]]) for part in schema.split(", ")], _names(schema))


def _rows(docs: pa.Table, buckets: int) -> list[pa.Array]:
    return [pa.array(np.arange(buckets), pa.int32()), pa.array(np.full(buckets, docs.column("__batch")[0].as_py(), np.int64))]


def _wanted(buckets: int):
    """A row for every bucket of words, with the training counts ``n`` of its words in the batch."""
    def run(docs: pa.Table) -> pa.Table:
        parts, found, order, edges = _vocabulary(docs, buckets)
        n = np.zeros(len(found), np.int64)
        for batch, tokens in parts:
            learnt = ~batch.column("__held").to_numpy(zero_copy_only=False).astype(bool)[tokens.owner]
            n[np.searchsorted(found, tokens.unique)] += np.bincount(tokens.back, learnt, len(tokens.unique)).astype(np.int64)
        return pa.table([*_rows(docs, buckets), _packed(found[order].view(np.int64), edges, LONG), _packed(n[order], edges, INT)], _names(WANTED))

    return run


def _told(buckets: int):
    """Numbers and counts for each batch, in the order of its question; zero for words that no training text has. ``known``: training words
    of the bucket, different ones, and those seen once and twice. Numbers are small for frequent words: the buckets deal them out in turn."""
    def run(wanted: pa.Table) -> pa.Table:
        asked, edges = _unpacked(wanted, "words", LONG)
        words, at, _ = _distinct(asked)
        counts = np.bincount(at, _unpacked(wanted, "n", INT)[0], len(words)).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort((words, -counts))] = np.arange(len(words))
        numbers = np.where(counts > 0, FIRST + rank * buckets + wanted.column("bucket")[0].as_py(), OTHER)
        known = [counts.sum(), (counts > 0).sum(), (counts == 1).sum(), (counts == 2).sum()]
        rows = wanted.num_rows
        return pa.table([wanted.column("bucket"), wanted.column("batch"), _packed(numbers[at], edges, INT), _packed(counts[at], edges, LONG),
                         _packed(np.tile(known, rows), np.arange(rows + 1) * 4, LONG)], _names(TOLD))

    return run


def _totals(told: pa.Table, known: Totals) -> Totals:
    """What was ``known`` before with the sums over the answers of all buckets."""
    n, distinct, once, twice = _unpacked(told, "known", LONG)[0].reshape(-1, 4).sum(axis=0).tolist()
    return replace(known, total=n + known.ends, distinct=distinct + (known.ends > 0), discount=_discount(once, twice))


def _asked(known: Totals):
    """A row for every bucket: its states ``u`` of one word with their number of ``pairs``; of each pair the token ``v``, its training
    count ``n`` in the batch and its number of ``triples``; of each of these the token ``w`` and its count ``m``."""
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _nothing(ASKED)
        told = told.sort_by("bucket")
        model = _totals(told, known)
        b = Batch(model, docs, told)
        edges = np.arange(model.buckets + 1)
        by_state = np.searchsorted(b.states >> 32, edges)
        by_pair = np.searchsorted(b.bucket, edges)
        by_triple = np.searchsorted(b.triples >> 32, by_pair)
        pairs = np.bincount(np.searchsorted(b.states, b.bucket << 32 | b.pairs >> 32), minlength=len(b.states))
        triples = np.bincount(b.triples >> 32, minlength=len(b.pairs))
        lists = [(b.states & LOW, by_state), (pairs, by_state), (b.pairs & LOW, by_pair), (b.n_pairs, by_pair), (triples, by_pair), (b.triples & LOW, by_triple), (b.n_triples, by_triple)]
        return pa.table([*_rows(docs, model.buckets), *(told.column(c) for c in _names(TOLD)[2:]), *(_packed(*x, INT) for x in lists)], _names(ASKED))

    return run


def _arcs(owner: np.ndarray, token: np.ndarray, n: np.ndarray, states: int) -> tuple[np.ndarray, ...]:
    """Of every state the tokens read in it, those of them that have no arc, and its arcs."""
    arc = token != OTHER
    return np.bincount(owner, n, states), np.bincount(owner, n * ~arc, states), np.bincount(owner, (n > 0) & arc, states)


def _answered(asked: pa.Table) -> pa.Table:
    """Counts over all batches for each batch that asked, in the order of its question, and how many arcs of each kind were seen
    once and twice in this bucket."""
    (u, by_state), (pairs, _), (v, by_pair), (n, _), (triples, _), (w, by_triple), (m, _) = (_unpacked(asked, c, INT) for c in _names(ASKED)[5:])
    states, state = np.unique(u, return_inverse=True)
    found, pair, _ = _distinct(np.repeat(u, pairs) << 32 | v)
    n = np.bincount(pair, n, len(found))
    thirds, third, _ = _distinct(np.repeat(pair, triples).astype(np.int64) << 32 | w)
    m = np.bincount(third, m, len(thirds))
    one = _arcs(np.searchsorted(states, found >> 32), found & LOW, n, len(states))
    two = _arcs(thirds >> 32, thirds & LOW, m, len(found))
    counted = [(c[(key & LOW) != OTHER] == k).sum() for key, c in ((found, n), (thirds, m)) for k in (1, 2)]
    rows = asked.num_rows
    # a state of two words reads as many tokens as its pair was seen
    lists = ([(x[state], by_state) for x in one] + [(x[pair], by_pair) for x in (n, *two[1:])] + [(m[third], by_triple)]
             + [(np.tile(counted, rows), np.arange(rows + 1) * 4)])
    return pa.table([*(asked.column(c) for c in _names(TOLD)), *(_packed(*x, LONG) for x in lists)], _names(ANSWERED))


def _weights(n: np.ndarray, token: np.ndarray, state: np.ndarray, read: np.ndarray, other: np.ndarray, arcs: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Weight of every arc (zero for a token without one) and what each state's failure arc carries."""
    follow = np.maximum(read, 1)
    weight = np.where(token == OTHER, 0, np.maximum(n - discount, 0)) / follow[state]
    return weight, np.where(read > 0, (other + discount * arcs) / follow, 1)


def log_probability(model: Totals, b: Batch, answers: pa.Table) -> np.ndarray:
    """log10 weight of every token of the batch."""
    follow, other, kinds, n, others, kindss, m, counted = (_unpacked(answers, name, LONG)[0] for name in _names(ANSWERED)[5:])
    once, twice, once_more, twice_more = counted.reshape(-1, 4).sum(axis=0)
    u = np.searchsorted(b.u, b.states & LOW)
    one = [np.bincount(u, x, len(b.u)) for x in (follow, other, kinds)]
    state = np.searchsorted(b.u, b.pairs >> 32)
    weight, fail = _weights(n, b.pairs & LOW, state, *one, _discount(once, twice))
    p = weight[b.pair] + fail[state[b.pair]] * model.unigram(b.count)
    weight, fail = _weights(m, b.triples & LOW, b.triples >> 32, n, others, kindss, _discount(once_more, twice_more))
    p[b.third] = weight[b.triple] + fail[b.pair[b.third - 1]] * p[b.third]
    return np.log10(p)


def is_held_out(id: Column) -> Column:
    """Documents that the model does not learn from: crc32 of the id as text, modulo 7, is 2. A null id is text ''."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _squeezed(batches):
    for batch in batches:
        yield batch.set_column(batch.schema.get_field_index("__text"), "__text", squeezed(batch.column("__text")))


RESULT = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(known: Totals, id_type: pa.DataType):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        answers = answers.sort_by("bucket")
        model = _totals(answers, known)
        b = Batch(model, docs, answers)
        base = np.log10((b.count + 1) / (model.total + 1 * (model.distinct + 1)))
        weight = log_probability(model, b, answers)
        return pa.table([
            docs.column("__id"), docs.column("__held"), pa.array(np.bincount(b.row, minlength=b.rows), pa.int64()),
            pa.array(np.bincount(b.row, b.count > 0, b.rows).astype(np.int64)), pa.array(np.full(b.rows, model.total, np.int64)),
            pa.array(np.bincount(b.row, base, b.rows)), pa.array(np.bincount(b.row, weight, b.rows))], names)

    names = ["id", *_names(RESULT)]
    kinds = id_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()
    return run


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", held_out: Column | None = None) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Both models learn from the rows that are not ``held_out``. All counts cover all training rows:
    documents share batches of bounded size, and each batch asks once for each of its different words, pairs and triples. A null or
    empty text has the end token only. Rows with null or repeated ids are scored like any other. Without training
    rows every count is zero and the model says nothing (a score of 0).
    """
    held = is_held_out(F.col(id)) if held_out is None else held_out
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(id).alias("__id"), body.alias("__text"), F.coalesce(held, F.lit(False)).alias("__held"))
    ends, size = own.agg(F.count_if(~F.col("__held")), F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()
    batches = max(1, -(-size // BATCH_BYTES))
    buckets = BUCKETS * batches
    known = Totals(0, 0, ends, 0, buckets, FREQUENT, VERY_FREQUENT)
    kind = docs.schema[id].dataType.simpleString()
    batched = (own.withColumn("__batch", F.pmod(F.xxhash64("__id", "__text"), F.lit(batches)))
               .mapInArrow(_squeezed, f"__id {kind}, __text binary, __held boolean, __batch long"))
    wanted = batched.groupBy("__batch").applyInArrow(_wanted(buckets), WANTED)
    told = wanted.groupBy("bucket").applyInArrow(_told(buckets), TOLD)
    asked = batched.groupBy("__batch").cogroup(told.groupBy("batch")).applyInArrow(_asked(known), ASKED)
    answers = asked.groupBy("bucket").applyInArrow(_answered, ANSWERED)
    return (batched.groupBy("__batch").cogroup(answers.groupBy("batch"))
            .applyInArrow(_scored(known, to_arrow_type(docs.schema[id].dataType)), f"id {kind}, {RESULT}"))

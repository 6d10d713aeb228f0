"""Token ids of a public byte-level BPE vocabulary, each distinct piece encoded once per worker.

A text is cut before every run of ASCII white space that follows another character. The vocabulary's pre-tokenizer
has a boundary there whatever stands around, so the pieces' ids in a row are the text's ids.

The vocabulary is a ``tokenizers`` file. Its ids are also its merge ranks, so pieces are merged by ``tiktoken``, which is
several times faster and gives the same ids; pieces that hold one of the file's added tokens go to ``tokenizers``.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain, repeat

import numpy as np

from fieldlake.llm.common import SPACE, prefix_hash, span_hash

VOCABULARY = "byte_bpe_50k.json"
CACHE = 400_000  # pieces a worker remembers


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _merger(path: str):
    """The same vocabulary for ``tiktoken``, and its added tokens as bytes."""
    import public_tokenizers
    import tiktoken

    slow = _tokenizer(path)
    added = {t.content for t in slow.get_added_tokens_decoder().values()}
    # the file writes bytes as characters: printable ones as themselves, the others in order from U+0100
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in slow.get_vocab().items() if token not in added}
    fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(token) for token in ranks]
    return fast, sizes, [a.encode() for a in added]


class Known:
    """Ids of pieces seen before, by the pieces' hashes."""

    def __init__(self, path: str):
        self.fast, self.sizes, self.added = _merger(path)
        self.slow = _tokenizer(path)
        self.forget()

    def forget(self) -> None:
        self.index: dict[int, int] = {}
        self.ids, self.begin = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def look_up(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the pieces, those not seen before encoded first."""
        if len(self.index) > CACHE:
            self.forget()
        names = keys.tolist()
        at = np.fromiter(map(self.index.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            ids, sizes = self.encode(data, starts[new], ends[new])
            at[new] = len(self.begin) - 1 + np.arange(len(new))
            self.index.update(zip(keys[new].tolist(), at[new].tolist(), strict=True))
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, ids])
        return at

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in a row and the number of ids of each.

        Pieces that begin with white space and end without are encoded as one text, in which they keep their bounds.
        """
        body = data.tobytes()
        pieces = [body[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        plain = SPACE[data[starts]] & ~SPACE[data[ends - 1]] & ~_wide_space(data, ends)
        if any(a in body for a in self.added):
            plain &= [not any(a in p for a in self.added) for p in pieces]
        together = np.flatnonzero(plain)
        whole = b"".join([pieces[k] for k in together.tolist()])
        ids = np.array(self.fast.encode_ordinary(whole.decode()), np.uint32)
        counts = np.zeros(len(pieces), np.int64)
        last = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(ends[together] - starts[together]), "right")
        counts[together] = np.diff(last, prepend=0)
        lists = {}
        for k in np.flatnonzero(~plain).tolist():
            text = pieces[k].decode()
            special = any(a in pieces[k] for a in self.added)
            lists[k] = self.slow.encode(text, add_special_tokens=False).ids if special else self.fast.encode_ordinary(text)
            counts[k] = len(lists[k])
        if not lists:
            return ids, counts
        out = np.empty(int(counts.sum()), np.uint32)
        out[np.repeat(plain, counts)] = ids
        out[np.repeat(~plain, counts)] = np.fromiter(chain.from_iterable(lists.values()), np.uint32)
        return out, counts


@lru_cache(maxsize=2)
def _known(path: str) -> Known:
    return Known(path)


def _wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space beyond ASCII may end before each place: U+0085, U+00A0, or a character led by E1, E2 or E3
    (where U+1680, U+2000-200A, U+2028/9, U+202F, U+205F and U+3000 are)."""
    out = np.zeros(len(at), bool)
    wide = np.flatnonzero((data[at - 1] >= 0x80) & (at >= 2))
    end = at[wide]
    two = (data[end - 2] == 0xC2) & ((data[end - 1] == 0x85) | (data[end - 1] == 0xA0))
    lead = data[np.maximum(end - 3, 0)]
    out[wide] = two | ((lead >= 0xE1) & (lead <= 0xE3))
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of all rows."""
    space = SPACE[data]
    start = np.zeros(len(data), bool)
    start[1:] = space[1:] & ~space[:-1]
    at = np.flatnonzero(start)
    start[at[_wide_space(data, at)]] = False
    heads = offsets[:-1]
    start[heads[heads < len(data)]] = True
    return np.flatnonzero(start)


def encode(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all rows in a row, the number of ids of each piece, and the pieces' starts."""
    starts = cuts(data, offsets)
    if not len(starts):
        return np.empty(0, np.uint32), np.empty(0, np.int64), starts
    ends = np.append(starts[1:], len(data))
    keys, where, back = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
    known = _known(path)
    number = known.look_up(keys, data, starts[where], ends[where])[back]
    begin = known.begin[number]
    each = known.begin[number + 1] - begin
    total = int(each.sum())
    place = np.arange(total) + np.repeat(begin - np.cumsum(each) + each, each)
    return known.ids[place], each, starts


def row_edges(each: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each row's ids begin, with the end of the last."""
    sums = np.concatenate([[0], np.cumsum(each)])
    return sums[np.searchsorted(starts, offsets)]

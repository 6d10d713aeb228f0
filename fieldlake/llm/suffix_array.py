"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's common prefixes.

The text is a row of byte strings. Every string ends with a separator that differs from all others, so no common
prefix runs over the end of a string.
"""

from __future__ import annotations

import numpy as np

STRIDE = 16  # Kasai's pass advances this many text places apart at once


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all strings, separators being 256, and the strings' starts with the end of the last."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    edges = np.concatenate([[0], np.cumsum(lengths)])
    symbols = np.full(int(edges[-1]), 256, np.uint16)
    flat = np.frombuffer(b"".join(parts), np.uint8)
    inside = np.ones(len(symbols), bool)
    inside[edges[1:] - 1] = False
    symbols[inside] = flat
    return symbols, edges


def first_keys(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The first symbols of every suffix in one integer, whether a separator is among them, bits and symbols of a key.

    Bytes are renumbered without gaps, which gives a key as many symbols as 63 bits hold. What follows a separator
    does not count: separators are in order of their places.
    """
    used = np.unique(symbols[symbols < 256])
    bits = max(1, int(len(used)).bit_length())
    reach = 63 // bits
    number = np.zeros(257, np.uint64)
    number[used] = np.arange(1, len(used) + 1)  # a separator is zero
    n = len(symbols)
    padded = np.concatenate([number[symbols], np.zeros(reach, np.uint64)])
    key, ends = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(reach):
        ends |= padded[k:k + n] == 0
        key <<= np.uint64(bits)
        key |= np.where(ends, np.uint64(0), padded[k:k + n])
    return key, ends, bits, reach


def suffix_array(key: np.ndarray, ends: np.ndarray, reach: int) -> np.ndarray:
    """Suffixes in order, from the keys of their first ``reach`` symbols. A separator makes every suffix differ.

    Sort by the keys, then double: groups of suffixes that agree so far are sorted by the rank of the suffix that many
    places on. Suffixes that stand alone are never looked at again, so the work shrinks to the repeats.
    """
    n = len(key)
    order = np.argsort(key)
    at = np.flatnonzero(ends[order])  # equal keys with a separator: in order of their places
    tied = order[at]
    order[at] = tied[np.lexsort((tied, key[tied]))]
    held = key[order]
    new = np.ones(n, bool)
    new[1:] = (held[1:] != held[:-1]) | ends[order[1:]]
    heads = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    open_places = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in the order that are not settled
    while len(open_places):
        members = order[open_places]
        both = rank[members] << 32 | rank[members + reach]  # a repeat ends before the last separator, so this is inside
        by = np.argsort(both)
        members, both = members[by], both[by]
        order[open_places] = members  # open places lie in order of their groups
        new = np.ones(len(members), bool)
        new[1:] = both[1:] != both[:-1]
        heads = np.flatnonzero(new)
        rank[members] = np.repeat(open_places[heads], np.diff(np.append(heads, len(members))))
        open_places = open_places[~(new & np.append(new[1:], True))]
        reach *= 2
    return order


def common_prefixes(key: np.ndarray, room: np.ndarray, order: np.ndarray, bits: int, reach: int, limit: int) -> np.ndarray:
    """Symbols, up to ``limit``, that the suffix at each place of the order has in common with the one before it.

    Kasai's bound lets the suffix one place on in the text start from one symbol less. The text is walked from
    ``STRIDE`` residues at once: all places that are equal modulo ``STRIDE`` advance together, a whole key at a time.
    ``room`` is the number of symbols before the next separator.
    """
    n = len(key)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    for residue in range(STRIDE):
        at = np.arange(residue, n, STRIDE)
        at = at[before[at] >= 0]
        other = before[at]
        most = np.minimum(np.minimum(room[at], room[other]), limit)
        length = np.minimum(np.maximum(shared[at - 1] - 1, 0), most) if residue else np.zeros(len(at), np.int64)
        live = np.flatnonzero(length < most)
        while len(live):
            a, b = at[live] + length[live], other[live] + length[live]
            differ = key[a] ^ key[b]
            whole = differ == 0
            length[live[whole]] += reach
            rest = np.flatnonzero(~whole)
            if len(rest):  # equal symbols at the front of the keys
                left = differ[rest]
                length[live[rest]] += sum((left >> np.uint64(bits * k) == 0).astype(np.int64) for k in range(1, reach))
            live = live[whole]
            live = live[length[live] < most[live]]
        shared[at] = np.minimum(length, most)
    return shared[order]


def repeated_starts(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all ``width``-byte strings within ``parts``: the part, the place in it, and a number that equal strings share."""
    symbols, edges = joined(parts)
    key, ends, bits, reach = first_keys(symbols)
    order = suffix_array(key, ends, reach)
    part = np.repeat(np.arange(len(parts)), np.diff(edges))
    room = edges[part + 1] - 1 - np.arange(len(symbols))
    number = np.cumsum(common_prefixes(key, room, order, bits, reach, width) < width)  # of the run of suffixes that begin alike
    kept = room[order] >= width
    places = order[kept]
    return part[places], places - edges[part[places]], number[kept]

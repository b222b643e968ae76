"""Equal substrings of a minimum length by interval expansion on a Burrows-Wheeler transform.

Strings are matched backwards: from the interval of all suffixes, the interval of every ``c + w`` follows from that of
``w`` by the transform's last-to-first map. Breadth-first, an interval of a string of length l + 1 that ends before a
boundary not yet known proves the common prefix there to be l. Common prefixes appear in increasing order, each
boundary is set once, and expansion stops at the minimum length: boundaries still unset then join suffixes that share at
least that much. The whole level is expanded at once with numpy.
"""

from __future__ import annotations

import numpy as np

#: A text has fewer characters than this, so that two ranks and a place fit one 63-bit sort key.
_PLACE = 21
MOST = (1 << _PLACE) - 1


def _ranked(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank from 1) of keys that leave their low bits free for the place."""
    key = np.sort((key << _PLACE) | np.arange(n))
    order, key = key & MOST, key >> _PLACE
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
    return order, rank


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(suffixes sorted by at least ``depth`` characters, packed first characters of each place, how many, bits of one).

    Characters become ranks of the alphabet, as many as fit are packed, and ranks are doubled from there.
    """
    n = len(text)
    used = np.zeros(512, np.int64)
    used[text] = 1
    text = np.cumsum(used)[text]  # from 1; 0 lies beyond the end
    bits = int(text.max()).bit_length()
    width = (63 - _PLACE) // bits
    padded = np.concatenate([text, np.zeros(width, np.int64)])
    packed = np.zeros(n, np.int64)
    for i in range(width):
        packed = (packed << bits) | padded[i : i + n]
    order, rank = _ranked(packed, n)
    have = width
    while have < depth and rank[order[-1]] < n:
        key = rank << _PLACE
        key[: max(0, n - have)] |= rank[have:]
        order, rank = _ranked(key, n)
        have *= 2
    return order, packed, width, bits


def _short_prefixes(order: np.ndarray, packed: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it, where it is shorter than ``width``; else ``width``."""
    x = packed[order[1:]] ^ packed[order[:-1]]
    out = np.full(len(order), width, np.int64)
    differ = np.flatnonzero(x)
    top = np.floor(np.log2(x[differ].astype(np.float64))).astype(np.int64)  # below 2**42: exact
    out[differ + 1] = width - 1 - top // bits
    out[0] = -1
    return out


def classes(pieces: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each position of the joined pieces, start of each piece): positions whose next ``least`` bytes are equal
    and inside a piece have one class. Positions too near their piece's end have classes of no meaning.

    Common prefixes shorter than the packed sort key are read off the key; expansion goes on from there.
    """
    size = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(size + 1) - (size + 1)
    n = int((size + 1).sum()) + 1
    if n > MOST:
        raise ValueError("too much text for one transform")
    text = np.ones(n, np.int32)  # 1 ends a piece, 0 the text, bytes start at 2
    text[-1] = 0
    body = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int32) + 2
    text[np.arange(len(body)) + np.repeat(np.arange(len(pieces)), size)] = body
    order, packed, width, bits = suffix_order(text, least)
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    before = text[order - 1].astype(np.int64)  # the transform
    lf = at[order - 1]
    length = min(width, least)
    short = _short_prefixes(order, packed, width, bits)
    known = np.concatenate([short < length, [True]])
    ends = np.flatnonzero(np.concatenate([short[1:], [-1]]) == length - 1) + 1  # right ends of the intervals to start from
    heads = np.flatnonzero(known[:-1])
    lo, hi = heads[np.searchsorted(heads, ends, "left") - 1], ends
    while len(lo) and length < least:
        span = hi - lo
        total = np.cumsum(span)
        rows = np.arange(total[-1]) + np.repeat(lo - (total - span), span)
        key = ((np.repeat(np.arange(len(lo)), span) << 9) | before[rows]) << _PLACE
        key = np.sort(key | lf[rows])
        group, place = key >> _PLACE, key & MOST
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        count = np.diff(np.concatenate([first, [len(key)]]))
        new_hi = place[first] + count  # sorted by place within a group, which is one interval
        fresh = ~known[new_hi]
        lo, hi = place[first][fresh], new_hi[fresh]
        known[hi] = True
        length += 1
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(known[:n])
    return out, starts


def repeated(pieces: list[bytes], least: int, keep_first: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each piece two masks over its windows of ``least`` bytes: those to remove, and those that stand for their class.

    A window is removed if an equal one starts elsewhere; with ``keep_first`` the first of equal ones stays.
    """
    label, starts = classes(pieces, least)
    windows = [max(0, len(p) - least + 1) for p in pieces]
    where = np.concatenate([np.arange(s, s + w) for s, w in zip(starts, windows)]) if pieces else np.zeros(0, np.int64)
    own = label[where]
    first = np.zeros(len(label) + 1, np.int64)
    first[own[::-1]] = np.arange(len(own))[::-1]  # of equal labels the last one written stays
    leads = first[own] == np.arange(len(own))
    gone = ~leads if keep_first else np.bincount(own, minlength=1)[own] > 1
    cuts = np.cumsum(windows)[:-1]
    return np.split(gone, cuts), np.split(leads, cuts)


def shared(pieces: list[bytes], owner: list[int], least: int) -> np.ndarray:
    """For each owner (0, 1, ...) whether a window of ``least`` bytes in its pieces is equal to one of another owner's."""
    label, starts = classes(pieces, least)
    windows = [max(0, len(p) - least + 1) for p in pieces]
    own = label[np.concatenate([np.arange(s, s + w) for s, w in zip(starts, windows)])]
    of = np.repeat(np.asarray(owner, np.int64), windows)
    low, high = np.full(len(label) + 1, len(owner), np.int64), np.full(len(label) + 1, -1, np.int64)
    np.minimum.at(low, own, of)
    np.maximum.at(high, own, of)
    out = np.zeros(max(owner, default=-1) + 1, bool)
    out[of[low[own] != high[own]]] = True
    return out

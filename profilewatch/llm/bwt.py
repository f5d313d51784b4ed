"""Which fixed-length strings of a set of texts repeat, by a Burrows-Wheeler transform.

Common prefixes of neighbouring suffixes are derived by increasing value: every interval
of suffixes that begin with some string is extended backward, character by character, breadth
first. An extension whose upper boundary has no value yet gets the current length. The
expansion stops at the minimum length; boundaries still without a value then separate
suffixes that agree on at least that many bytes.

Each text ends in a mark of its own, below all bytes, so matches never cross texts.
Works on some MB at a time: about 60 bytes of memory per byte of text.
"""

from __future__ import annotations

import numpy as np

#: Bytes compared at once when suffixes are sorted; the eighth byte tells how many there are.
HEAD = 7


def _heads(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first bytes of every suffix as one number that orders them; ``left`` bytes remain in its text."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(HEAD, np.uint8)))
    key = np.zeros(n, dtype=np.uint64)
    for i in range(HEAD):
        key |= np.where(left > i, padded[i : i + n], 0).astype(np.uint64) << np.uint64(8 * (HEAD - i))
    return key | np.minimum(left, HEAD).astype(np.uint64)


def sorted_suffixes(text: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``depth`` bytes (ties by position), and the heads in that order."""
    n = len(text)
    key = _heads(text, left)
    order = np.argsort(key, kind="stable")
    heads = key[order]
    new = np.concatenate(([True], heads[1:] != heads[:-1]))
    start = np.flatnonzero(new)
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order] = np.repeat(start, np.diff(np.append(start, n))) + 1
    rank[n] = 0
    done = HEAD
    place = np.arange(n)
    tied = _ties(new)
    while done < depth and len(tied):
        at = order[tied]
        beyond = np.minimum(at + done, n)
        second = np.where(left[at] > done, rank[beyond], 0)
        own, second, at = _by_ranks(rank[at], second, at, n)
        order[tied] = at  # groups hold the same places before and after
        fresh = np.concatenate(([True], (own[1:] != own[:-1]) | (second[1:] != second[:-1])))
        first = np.flatnonzero(fresh)
        rank[at] = np.repeat(place[tied][first], np.diff(np.append(first, len(at)))) + 1
        again = _ties(fresh)
        tied = tied[again]
        done *= 2
    return order, heads


def _by_ranks(own: np.ndarray, second: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries ordered by both ranks, ties by position; no value is above ``n``.

    Three values of up to 21 bits are one number, and plain numbers sort several times as
    fast as an order of three arrays. Entries of equal ranks come by position already,
    so a stable order of the two ranks does for longer texts.
    """
    bits = n.bit_length()
    if bits > 21:
        by = np.argsort(own * (n + 1) + second, kind="stable")
        return own[by], second[by], at[by]
    packed = own << 2 * bits | second << bits | at
    packed.sort()
    mask = (1 << bits) - 1
    return packed >> 2 * bits, packed >> bits & mask, packed & mask


def _ties(new: np.ndarray) -> np.ndarray:
    """Entries of runs longer than one, given where runs start."""
    following = np.append(new[1:], True)
    return np.flatnonzero(~(new & following))


def repeated_starts(text: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """For every byte whether the ``length`` bytes from there occur in the texts once more.

    ``ends`` holds the end of each text in the buffer. Texts should not be empty.
    """
    n = len(text)
    out = np.zeros(n, dtype=bool)
    if not n:
        return out
    starts = np.concatenate(([0], ends[:-1]))
    sizes = ends - starts
    # a mark behind every text: it sorts first, having no bytes left
    total = n + len(ends)
    mark = ends + np.arange(len(ends))
    real = np.ones(total, dtype=bool)
    real[mark] = False
    full = np.zeros(total, dtype=np.uint8)
    full[real] = text
    left = np.repeat(mark, sizes + 1) - np.arange(total)
    order, heads = sorted_suffixes(full, left, length)
    # preceding characters: 0 for a mark
    before = np.zeros(total, dtype=np.uint16)
    before[1:] = np.where(real[:-1], full[:-1].astype(np.uint16) + 1, 0)
    bwt = before[order]
    jump = np.empty(total, dtype=np.int64)
    jump[np.argsort(bwt, kind="stable")] = np.arange(total)

    near = left[order]
    set_ = np.ones(total + 1, dtype=bool)  # boundary i stands below suffix i
    set_[1:-1] = (heads[1:] != heads[:-1]) | (near[1:] < HEAD)
    # all strings of HEAD bytes, and those that reach a mark with their last byte
    first = np.flatnonzero(set_[:-1])
    last = np.append(first[1:], total) - 1
    begins = (near[first] >= HEAD) | (near[first] == HEAD - 1)
    low, high = first[begins], last[begins]
    depth = HEAD
    while depth < length and len(low):
        low, high = _extended(low, high, bwt, jump)
        fresh = ~set_[high + 1]
        low, high = low[fresh], high[fresh]
        set_[high + 1] = True
        depth += 1
    same = ~set_[1:-1]
    twice = np.zeros(total, dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    found = np.zeros(total, dtype=bool)
    found[order] = twice & (near >= length)
    out[:] = found[real]
    return out


def _extended(low: np.ndarray, high: np.ndarray, bwt: np.ndarray, jump: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The intervals of every string with one character put before it."""
    one = low == high
    single = low[one]
    single = jump[single[bwt[single] > 0]]
    low, high = low[~one], high[~one]
    if not len(low):
        return single, single
    sizes = high - low + 1
    owner = np.repeat(np.arange(len(low)), sizes)
    at = np.arange(int(sizes.sum())) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
    chars = bwt[at]
    some = chars > 0
    at, key = at[some], owner[some] * 512 + chars[some]
    by = np.argsort(key, kind="stable")
    at, key = at[by], key[by]
    if not len(key):
        return single, single
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    lows, highs = jump[at[new]], jump[at[np.append(new[1:], len(key)) - 1]]
    return np.concatenate((single, lows)), np.concatenate((single, highs))

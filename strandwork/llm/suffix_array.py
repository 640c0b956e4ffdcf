"""A suffix array by induced sorting, and common prefixes in text order, in numpy.

The steps are those of induced sorting: classify suffixes as smaller (S) or larger (L) than the next one; sort the
leftmost S suffixes (LMS) by the substrings between them, recursively where substrings repeat; then induce the order of
all L and of all S suffixes from them in one linear pass each. The substrings, of three characters on average, are packed
into words and sorted as such, so that a level has these two passes once and not a second time for the substrings. A pass
handles a whole bucket of equal first characters at a time: what a bucket holds puts its predecessors at the ends of
their buckets, in waves where they fall in the same one. In the recursion characters are the names of substrings, of
which there can be as many as there are characters; with so few in a bucket the same passes go one character at a time.
"""

from __future__ import annotations

import numpy as np

#: With fewer characters than this in a bucket on average, whole buckets at a time cost more than single characters.
FEW_A_BUCKET = 100


def _smaller_types(text: np.ndarray) -> np.ndarray:
    """True for S. The last character must be the single smallest."""
    n = len(text)
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)  # of runs of equal characters
    run_type = np.append(text[ends[:-1]] < text[ends[:-1] + 1], True)
    return np.repeat(run_type, np.diff(np.concatenate([[-1], ends])))


def _induced(text: np.ndarray, small: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The suffix array that follows from the order of ``lms``."""
    n, k = len(text), len(counts)
    if n < FEW_A_BUCKET * k:
        return _induced_singly(text, small, lms, counts)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(n, -1, np.int64)
    l_counts = np.bincount(text[~small], minlength=k)
    lms_of = np.split(lms[np.argsort(text[lms], kind="stable")], np.cumsum(np.bincount(text[lms], minlength=k))[:-1])
    head = starts.copy()

    def put(sources: np.ndarray, wanted: bool, at: np.ndarray, step: int) -> None:
        """Places predecessors of ``sources`` of the wanted type, in the order of ``sources``."""
        before = sources[sources > 0] - 1
        before = before[small[before] == wanted]
        if not len(before):
            return
        chars = text[before]
        if len(before) == 1:
            c = chars[0]
            sa[at[c]] = before[0]
            at[c] += step
            return
        order = np.argsort(chars, kind="stable")
        before, chars = before[order], chars[order]
        first = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
        rank = np.arange(len(chars)) - np.repeat(first, np.diff(np.append(first, len(chars))))
        sa[at[chars] + step * rank] = before
        at[chars[first]] += step * np.diff(np.append(first, len(chars)))

    used = np.flatnonzero(counts)
    for c in used:
        done = starts[c]
        while done < head[c]:
            upto = head[c]
            put(sa[done:upto], False, head, 1)
            done = upto
        if len(lms_of[c]):
            put(lms_of[c], False, head, 1)
    tail = ends - 1
    for c in used[::-1]:
        done = ends[c] - 1
        while done > tail[c]:
            upto = tail[c]
            put(sa[upto + 1 : done + 1][::-1], True, tail, -1)
            done = upto
        if c == 0:
            sa[0] = n - 1  # the end of the text has no successor to place it
            tail[0] = -1
            put(sa[:1], True, tail, -1)
        if l_counts[c]:
            put(sa[starts[c] : starts[c] + l_counts[c]][::-1], True, tail, -1)
    return sa


def _induced_singly(text: np.ndarray, small: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """As ``_induced``, one character at a time."""
    n = len(text)
    # the character before each suffix if it begins one of the wanted type, else -1; the last is for places still empty
    before_large, before_small = (np.concatenate([[-1], np.where(small[:-1] == kind, text[:-1], -1), [-1]]).tolist() for kind in (False, True))
    ends = np.cumsum(counts)
    sa = [-1] * n
    tail = (ends - 1).tolist()
    for i, c in zip(lms[::-1].tolist(), text[lms[::-1]].tolist(), strict=True):
        sa[tail[c]] = i
        tail[c] -= 1
    head = (ends - counts).tolist()
    for i in sa:  # grows while it is read
        c = before_large[i]
        if c >= 0:
            at = head[c]
            sa[at] = i - 1
            head[c] = at + 1
    tail = (ends - 1).tolist()
    for i in reversed(sa):
        c = before_small[i]
        if c >= 0:
            at = tail[c]
            sa[at] = i - 1
            tail[c] = at - 1
    return np.array(sa)


def _named(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names 0, 1, ... of LMS substrings, each to the next LMS suffix inclusive, by their order; equal ones have one name.

    They are compared by characters and types, of which none begins another, as many at a time as a word holds.
    """
    symbols = (2 * text + small).astype(np.uint64)
    length = np.append(np.diff(lms), 0) + 1
    bits = int(symbols.max()).bit_length()
    step, names, left = 0, np.zeros(len(lms), np.int64), np.arange(len(lms))
    while len(left):  # those that are equal to others so far
        key = np.zeros(len(left), np.uint64)
        upto = step + 64 // bits
        for i in range(step, upto):
            key <<= np.uint64(bits)
            key |= np.where(i < length[left], symbols[np.minimum(lms[left] + i, len(text) - 1)], np.uint64(0))
        order = np.lexsort((key, names[left])) if step else np.argsort(key)
        left, key = left[order], key[order]
        old = names[left]
        at = np.arange(len(left))
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        new = new_old.copy()
        new[1:] |= key[1:] != key[:-1]
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(left)))
        # a name is the place of the first that has it, so that the others' names stay
        names[left] = old + np.repeat(heads, size) - np.maximum.accumulate(np.where(new_old, at, 0))
        left = left[np.repeat(size > 1, size) & (length[left] > upto)]
        step = upto
    used = np.zeros(len(lms), bool)
    used[names] = True
    return (np.cumsum(used) - 1)[names]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``text`` (non-negative integers); a suffix sorts before the longer ones it begins."""
    if not len(text):
        return np.zeros(0, np.int64)
    if text.max() < len(text):
        codes = np.cumsum(np.bincount(text) > 0)[text]
    else:
        codes = np.unique(text, return_inverse=True)[1] + 1
    return _sorted(np.append(codes.astype(np.int64), 0))[1:]


def _sorted(text: np.ndarray) -> np.ndarray:
    """As ``suffix_array``, of characters 0 to k - 1 of which 0 occurs once, at the end."""
    n = len(text)
    counts = np.bincount(text)
    if len(counts) == n:  # all characters are different
        return np.argsort(text)
    small = _smaller_types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    # the last LMS suffix is the end of the text, whose name is 0 and occurs once
    return _induced(text, small, lms[_sorted(_named(text, small, lms))], counts)


def permuted_lcp(data: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For every position of ``data`` (bytes), how far its suffix agrees with the one before it in ``sa``, up to ``most``.

    In text order; eight bytes are compared at a time. Positions near the end are compared against padding, so a caller
    that needs exact prefixes there bounds them by the bytes that are left.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    words = np.ascontiguousarray(words).view("<u8").ravel()
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(before >= 0)
    step = 0
    while len(at) and step < most:
        differ = words[at + step] ^ words[before[at] + step]
        low = differ & (~differ + np.uint64(1))  # lowest bit set
        zeros = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        out[at] += zeros
        at = at[differ == 0]
        step += 8
    return np.minimum(np.minimum(out, most), n - np.maximum(np.arange(n), before))

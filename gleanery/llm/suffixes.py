"""Suffix arrays by induced sorting, and common prefixes in text order."""

from __future__ import annotations

import numpy as np

FEW = 4096     # alphabets up to this size are induced bucket by bucket in array operations


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S), False where larger (L); the last is S."""
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])       # the last letter is the only 0, so a change precedes it
    following = np.repeat(change, np.diff(change, prepend=-1))
    small = np.ones(n, bool)
    small[:-1] = text[following] < text[following + 1]
    return small


def _place(array: np.ndarray, heads: np.ndarray, chars: np.ndarray, values: np.ndarray, step: int) -> None:
    """Append ``values`` to the buckets of ``chars`` in order, moving ``heads`` by ``step``."""
    order = np.argsort(chars, kind="stable")     # 16-bit letters: a radix sort
    chars, values = chars[order].astype(np.int64), values[order]
    new = np.flatnonzero(np.append(True, chars[1:] != chars[:-1]))
    sizes = np.diff(np.append(new, len(chars)))
    within = np.arange(len(chars)) - np.repeat(new, sizes)
    array[heads[chars] + step * within] = values
    heads[chars[new]] += step * sizes


def _induce_arrays(text, small, size, lms):
    text = text.astype(np.uint16)
    counts = np.bincount(text, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    array = np.full(len(text), -1, np.int64)
    placed = {}
    chars = text[lms]
    order = np.argsort(chars, kind="stable")
    sorted_chars, sorted_lms = chars[order], lms[order]
    cuts = np.flatnonzero(np.append(True, sorted_chars[1:] != sorted_chars[:-1]))
    for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        placed[int(sorted_chars[a])] = sorted_lms[a:b]
    present = np.flatnonzero(counts)
    heads = starts.copy()
    for char in present:
        first = starts[char]
        at = first
        while at < heads[char]:                      # runs of one character induce themselves
            before = array[at:heads[char]] - 1
            at = int(heads[char])
            before = before[before >= 0]
            same = before[(text[before] == char) & ~small[before]]
            array[at:at + len(same)] = same
            heads[char] += len(same)
        scanned = array[first:heads[char]]
        if int(char) in placed:
            scanned = np.concatenate([scanned, placed[int(char)]])
        before = scanned - 1
        before = before[before >= 0]
        before = before[~small[before] & (text[before] > char)]
        if len(before):
            _place(array, heads, text[before], before, 1)
    tails = ends - 1
    for char in present[::-1]:
        last = int(tails[char])
        top = int(ends[char]) - 1
        at = top
        while at > last:                             # filled from the bucket's end downwards
            before = array[last + 1:at + 1][::-1] - 1
            at = last
            before = before[before >= 0]
            same = before[(text[before] == char) & small[before]]
            array[at - len(same) + 1:at + 1] = same[::-1]
            last = at - len(same)
        tails[char] = last
        large = array[starts[char]:heads[char]][::-1]
        if char == 0 and top == last:                # the end mark is induced by nothing
            array[top] = len(text) - 1
            tails[char] = last = top - 1
        scanned = np.concatenate([array[last + 1:top + 1][::-1], large])
        before = scanned - 1
        before = before[before >= 0]
        before = before[small[before] & (text[before] < char)]
        if len(before):
            _place(array, tails, text[before], before, -1)
    return array


def _induce_lists(text, small, size, lms):
    n = len(text)
    counts = np.bincount(text, minlength=size)
    ends = np.cumsum(counts)
    text = text.astype(np.int64)
    letters = text.tolist()
    array = [-1] * n
    tails = (ends - 1).tolist()
    for at in lms[::-1].tolist():
        char = letters[at]
        array[tails[char]] = at
        tails[char] -= 1
    # the letter before a place if that suffix is of the wanted kind, else -1
    before = np.append(-1, text[:-1])
    large = np.where(np.append(True, small[:-1]), -1, before).tolist()
    heads = (ends - counts).tolist()
    for place in array:                      # sees what is written ahead of it
        if place > 0:
            char = large[place]
            if char >= 0:
                array[heads[char]] = place - 1
                heads[char] += 1
    less = np.where(np.append(True, ~small[:-1]), -1, before).tolist()
    tails = (ends - 1).tolist()
    for place in reversed(array):
        if place > 0:
            char = less[place]
            if char >= 0:
                array[tails[char]] = place - 1
                tails[char] -= 1
    if array[0] < 0 or array[0] != n - 1:
        array[0] = n - 1
    return np.array(array, np.int64)


def _names(text: np.ndarray, ordered: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ranks of sorted leftmost-smaller substrings; equal ones share a rank."""
    same = np.zeros(len(ordered), bool)
    candidates = np.flatnonzero(lengths[1:] == lengths[:-1]) + 1
    depth = 0
    left, right, size = ordered[candidates - 1], ordered[candidates], lengths[candidates]
    while len(candidates):
        done = depth >= size
        same[candidates[done]] = True
        go = ~done
        candidates, left, right, size = candidates[go], left[go], right[go], size[go]
        equal = text[left + depth] == text[right + depth]
        candidates, left, right, size = candidates[equal], left[equal], right[equal], size[equal]
        depth += 1
    return np.cumsum(~same) - 1


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``names``, which end with the only 0, by doubling their ranks.

    Suffixes that agree in ``step`` names share the place of the first of them as rank;
    only those that still share one are compared further, by the rank ``step`` names on.
    """
    n = len(names)
    order = np.argsort(names)
    rank = np.empty(n, np.int64)
    keys = names[order]
    places, step = np.arange(n), 1
    while True:
        new = np.append(True, keys[1:] != keys[:-1])
        heads = np.flatnonzero(new)
        rank[order[places]] = places[heads].repeat(np.diff(np.append(heads, len(new))))
        alone = new & np.append(new[1:], True)
        places = places[~alone]
        if not len(places):
            return order
        at = order[places]
        keys = rank[at] * n + rank[at + step]
        inner = np.argsort(keys)
        order[places], keys = at[inner], keys[inner]
        step *= 2


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Order of the suffixes of ``text``, numbers below ``size`` that end with the only 0.

    Suffixes are classified, the leftmost-smaller substrings are sorted by induction
    and named, the string of names is sorted by doubling where names repeat, and the
    whole order is induced from theirs. Small alphabets are induced in array
    operations per character, large ones in plain loops.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    induce = _induce_arrays if size <= FEW and n >= 8 * size else _induce_lists
    small = _types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) == 1:
        return induce(text, small, size, lms)
    rough = induce(text, small, size, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    number = np.empty(n, np.int64)
    number[lms] = np.arange(len(lms))
    spans = np.append(np.diff(lms) + 1, 1)
    names = _names(text, ordered, spans[number[ordered]])
    if names[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), np.int64)
        reduced[number[ordered]] = names
        ordered = lms[_order_of_names(reduced)]
    return induce(text, small, size, ordered)


def permuted_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """By place in the text: the common prefix of a suffix with its predecessor in order.

    A value is at least the one before it less one, and exactly that where the
    letters before both suffixes agree. Only the other places are compared.
    """
    n = len(text)
    phi = np.empty(n, np.int64)
    phi[array[0]] = -1
    phi[array[1:]] = array[:-1]
    reducible = np.zeros(n, bool)
    reducible[1:] = (phi[1:] > 0) & (phi[:-1] == phi[1:] - 1) & (text[phi[1:] - 1] == text[:-1])
    open_ = np.flatnonzero(~reducible & (phi >= 0))
    values = np.zeros(n, np.int64)
    # letters are compared several at a time where they fit; the only 0, at the end, ends every comparison
    several = 4 if text.max() < 1 << 16 else 1
    words = text
    if several > 1:
        words = np.ndarray(n, "<u8", np.append(text, [0] * several).astype("<u2"), strides=(2,)).copy()
    at, other = open_, phi[open_]
    depth = 0
    while len(at):
        differ = words[at + depth] ^ words[other + depth]
        equal = differ == 0
        if several > 1:
            lowest = differ[~equal]
            lowest &= ~lowest + np.uint64(1)
            values[at[~equal]] = depth + sum((lowest >> np.uint64(bits) > 0).astype(np.int64) for bits in (16, 32, 48))
        else:
            values[at[~equal]] = depth
        at, other = at[equal], other[equal]
        depth += several
    place = np.arange(n)
    anchor = np.maximum.accumulate(np.where(~reducible, place, 0))
    return np.maximum(values[anchor] - (place - anchor), 0)

"""Greedy string tiling: how much of a sequence common tiles with another cover, longest tiles first.

Every round builds the suffix array of what no tile covers yet, finds the longest common stretch, and lays all tiles of that length at
once. The lengths fall from round to round, so n tokens take at most about the root of 2 n rounds of n log n steps, also where a
text repeats itself; no list of pairs of places is ever made.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _sorted(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes, and the common length of each suffix with the one before it in that order."""
    n = len(tokens)
    ranks = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
    step = 1
    while int(ranks[-1].max()) < n - 1:
        second = np.zeros(n, np.int64)
        second[: max(0, n - step)] = ranks[-1][step:] + 1
        ranks.append(np.unique(ranks[-1] * (n + 1) + second, return_inverse=True)[1].astype(np.int64))
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b, common = order[1:].copy(), order[:-1].copy(), np.zeros(n, np.int64)
    for k in range(len(ranks) - 1, -1, -1):  # ranks[k] compares 2^k tokens; the ends differ, so no match runs over them
        same = np.flatnonzero((a < n) & (b < n) & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)]))
        common[1:][same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, common


def tiling(a: Sequence, b: Sequence, least: int = 2) -> int:
    """Tokens of ``a`` covered by tiles of ``least`` or more common tokens with ``b``; each token of either side is used once."""
    n, m = len(a), len(b)
    if min(n, m) < least:
        return 0
    numbers: dict = {}
    tokens = np.array([numbers.setdefault(x, len(numbers)) for x in (*a, None, *b, None)], np.int64)
    other = len(numbers)
    used = np.zeros(n + m + 2, bool)
    used[[n, n + m + 1]] = True
    covered = 0
    while True:
        # What is covered matches nothing: each such place has a number of its own.
        now = np.where(used, other + np.arange(len(tokens)), tokens)
        order, common = _sorted(now)
        left = order < n
        across = left[1:] != left[:-1]
        length = int(common[1:][across].max()) if across.any() else 0
        if length < least:
            return covered
        group = np.cumsum(common < length)
        both = np.flatnonzero((np.bincount(group, left) > 0) & (np.bincount(group, ~left) > 0))
        keep = np.isin(group, both)
        place, group = order[keep], group[keep]
        by = np.lexsort((place, group))
        place, group = place[by], group[by]
        for part in np.split(place, np.flatnonzero(np.diff(group)) + 1):
            mine, theirs = part[part < n].tolist(), iter(part[part > n].tolist())
            for i in mine:
                if used[i] or used[i + length - 1]:
                    continue
                j = next((j for j in theirs if not used[j] and not used[j + length - 1]), None)
                if j is None:
                    break
                used[i : i + length] = used[j : j + length] = True
                covered += length

"""Problem 8: passages of evaluation items inside documents.

Method: training suffix arrays. Every shard of documents is turned into integer tokens and its whole suffix array is built by
prefix doubling; every suffix of every test item is binary-searched in it, down to its longest verbatim match, which gives all
places that share SEED tokens or more with it, each with the length of its match. Matches on near diagonals (document position
minus item position) are chained across changed words, and a document leaks an item if a chain spans PASSAGE of the item.

Items reach every task; documents never leave their partition: the plan has no shuffle but the last distinct. Test items are
asked against all documents, in shards; many items go in sets of bounded size.

Defined results: tokens are words, numbers and single Han characters without regard to case, width, punctuation or blanks. Null or
empty texts match nothing; items of fewer than SEED tokens must stand there whole. Documents with a repeated id, and items with
one, give each pair once. Documents are read whole.
"""

from __future__ import annotations

import math
import re
import unicodedata as ud

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import map_columns, spread, table

#: Least verbatim match in tokens; least share of an item that a passage spans and that it matches word for word.
SEED, PASSAGE, MATCHED = 6, 0.395, 0.37
#: Most tokens between two matches of a chain, and most shift of its diagonal: a few changed, added or dropped words.
GAP, DRIFT = 8, 4
#: Characters of the test items that a task gets at a time (about 8 bytes each there); matches that are written out at a time.
MOST_CHARS, MOST_MATCHES = 20_000_000, 2_000_000
#: Documents of a shard.
SHARD_ROWS = 2000
TOKEN = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")


def words(text: str) -> list[str]:
    if not text.isascii():
        text = ud.normalize("NFKC", text)
    return TOKEN.findall(text.lower())


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Places of ``tokens`` in the order of the suffixes there, by prefix doubling; each round sorts only what is still tied."""
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if n else order
    rank = np.empty(n, np.int64)  # of a suffix: where its group of ties begins
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    tied, step = np.arange(n), 1
    while True:
        ranks = rank[order[tied]]
        same = ranks[1:] == ranks[:-1]
        keep = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(tied) else same
        tied, ranks = tied[keep], ranks[keep]
        if not len(tied):
            return order
        members = order[tied]
        after = members + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        sorted_ = np.lexsort((second, ranks))
        members, ranks, second = members[sorted_], ranks[sorted_], second[sorted_]
        order[tied] = members
        new = np.concatenate(([True], (ranks[1:] != ranks[:-1]) | (second[1:] != second[:-1])))
        rank[members] = np.repeat(tied[new], np.diff(np.append(np.flatnonzero(new), len(tied))))
        step *= 2


class Items:
    """Test items as one token stream with their own vocabulary."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        ids, stream, item, place, length = [], [], [], [], []
        for item_id, text in rows:
            toks = words(text)
            if not toks:
                continue
            ids.append(item_id)
            length.append(len(toks))
            for p, w in enumerate(toks):
                stream.append(self.vocabulary.setdefault(w, len(self.vocabulary) + 1))
                item.append(len(ids) - 1)
                place.append(p)
        self.ids, self.item, self.place = np.array(ids, np.int64), np.array(item, np.int64), np.array(place, np.int64)
        self.stream, self.length = np.array(stream, np.int64), np.array(length, np.int64)


def narrow(tokens: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray, right: bool) -> np.ndarray:
    """Binary search in each interval for the first suffix whose token at ``depth`` is not below (or is above) ``want``."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        at = np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, len(tokens) - 1)
        seen = tokens[at]
        go = open_ & ((seen <= want) if right else (seen < want))
        lo = np.where(go, mid + 1, lo)
        hi = np.where(open_ & ~go, mid, hi)


def expand(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the intervals, and the number of the interval that each lies in."""
    sizes = end - start
    which = np.repeat(np.arange(len(start)), sizes)
    return np.arange(len(which)) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes), which


def matches(tokens: np.ndarray, items: Items, ask: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(place in the shard, index in the item stream, length) of all maximal verbatim matches of the suffixes ``ask``.

    Two binary searches a token narrow a suffix' interval of places until it is empty, at its longest match. The places that drop
    out at a token match just so far. Intervals are kept as runs of places with the same token before them; a run whose
    token is the suffix' own goes on to the left and isn't maximal, so repetitive text costs no more than any. Gives
    None, before any place is written out, if there would be more than ``most``.
    """
    if not len(tokens):
        return (tokens,) * 3
    order = suffix_array(tokens)
    before = np.where(order > 0, tokens[order - 1], -1)
    run_start = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
    run_end = np.append(run_start[1:], len(order))
    run_of = np.repeat(np.arange(len(run_start)), run_end - run_start)
    least = np.minimum(SEED, items.length[items.item])
    ask = ask[(items.place + least <= items.length[items.item])[ask]]
    own = np.where(items.place > 0, np.concatenate(([-2], items.stream[:-1])), -2)
    lo, hi = np.zeros(len(ask), np.int64), np.full(len(ask), len(order), np.int64)
    found, total, depth = [], 0, 0
    while len(ask):
        end, start = lo.copy(), lo.copy()
        more = np.flatnonzero(items.place[ask] + depth < items.length[items.item[ask]])
        want = items.stream[ask[more] + depth]
        start[more] = narrow(tokens, order, lo[more], hi[more], depth, want, False)
        end[more] = narrow(tokens, order, start[more], hi[more], depth, want, True)
        long = np.flatnonzero(least[ask] <= depth)
        a, b, who = np.concatenate((lo[long], end[long])), np.concatenate((start[long], hi[long])), np.concatenate((ask[long], ask[long]))
        some = a < b
        a, b, who = a[some], b[some], who[some]
        first, last = run_of[a], run_of[b - 1] + 1
        if most is not None and total + int((last - first).sum()) > most:
            return None
        run, which = expand(first, last)
        stop = before[run_start[run]] != own[who[which]]
        run, which = run[stop], which[stop]
        a, b, who = np.maximum(a[which], run_start[run]), np.minimum(b[which], run_end[run]), who[which]
        total += int((b - a).sum())
        if most is not None and total > most:
            return None
        at, which = expand(a, b)
        found.append((order[at], who[which], np.full(len(at), depth)))
        keep = start < end
        ask, lo, hi = ask[keep], start[keep], end[keep]
        depth += 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (order[:0],) * 3


def chain(runs: list[tuple[int, int, int]]) -> tuple[int, int]:
    """(matched tokens, spanned tokens) of the best chain of matches, given as (first token in the item, last + 1, diagonal)."""
    # Ends on one diagonal rise with their starts, so those within GAP are the last few of each diagonal within DRIFT.
    ends: dict[int, list[tuple[int, int, int, int]]] = {}  # by diagonal: end, number of the run, start, matched
    best = (0, 0)
    for i, (start, end, diagonal) in enumerate(sorted(runs)):
        new, order = (start, end - start), -1
        for g in range(diagonal - DRIFT, diagonal + DRIFT + 1):
            for e, k, s, m in reversed(ends.get(g, ())):
                if start - e > GAP:
                    break
                gain = m + min(end - start, end - e)
                if end > e and (gain > new[1] or (gain == new[1] and order >= 0 and k > order)):
                    new, order = (s, gain), k
        ends.setdefault(diagonal, []).append((end, i, new[0], new[1]))
        best = max(best, (new[1], end - new[0]))
    return best


def search(parts: list[tuple[int, np.ndarray]], items: Items, which: np.ndarray, most: int | None) -> set[tuple[int, int]] | None:
    """(document, item's index) of every leak of the items ``which`` in (document, tokens); None beyond ``most`` matches."""
    tokens = np.concatenate([t for _, t in parts])
    owner = np.repeat(np.array([i for i, _ in parts]), np.array([len(t) for _, t in parts]))
    got = matches(tokens, items, np.flatnonzero(np.isin(items.item, which)), most)
    if got is None:
        return None
    place, index, length = got
    item, at, doc = items.item[index], items.place[index], owner[place]
    pair = doc * len(items.ids) + item
    order = np.lexsort((at, pair))
    pair, at, end, diagonal, item, doc = pair[order], at[order], (at + length)[order], (place - at)[order], item[order], doc[order]
    if not len(pair):
        return set()
    # Tokens of the item that its matches in the document cover at all: no chain can match more.
    group = np.cumsum(np.concatenate(([False], pair[1:] != pair[:-1])))
    wide = int(items.length.max()) + 1
    reach = np.maximum.accumulate(group * wide + end) - group * wide
    before = np.concatenate(([0], np.where(group[1:] == group[:-1], reach[:-1], 0)))
    covered = np.bincount(group, np.maximum(0, end - np.maximum(at, before)))
    hot = np.flatnonzero(covered[group] >= MATCHED * items.length[item])
    out = set()
    for part in np.split(hot, np.flatnonzero(np.diff(group[hot])) + 1) if len(hot) else []:
        n = int(items.length[item[part[0]]])
        matched, spanned = chain(list(zip(at[part].tolist(), end[part].tolist(), diagonal[part].tolist(), strict=True)))
        if spanned >= PASSAGE * n and matched >= MATCHED * n:
            out.add((int(doc[part[0]]), int(item[part[0]])))
    return out


def leaked(docs: list[str | None], items: Items, most: int = MOST_MATCHES) -> list[tuple[int, int]]:
    """(document's index, item's index) of every leak in one shard.

    A shard with more than ``most`` matches is searched in halves, a single document in windows that overlap by more than any
    chain can extend, and a short one item by item: memory is bounded, and nothing is left out.
    """
    known, parts, other = items.vocabulary, [], len(items.vocabulary) + 1
    for i, text in enumerate(docs):
        toks = np.array([known.get(w, 0) for w in words(text)] if text else [], np.int64)
        if toks.any():
            toks = np.append(toks, 0)
            # Tokens that no item has, and the ends of documents, are all different, above the vocabulary: they match nothing.
            strange = np.flatnonzero(toks == 0)
            toks[strange] = other + np.arange(len(strange))
            other += len(strange)
            parts.append((i, toks))
    found: set[tuple[int, int]] = set()
    work = [(parts, np.arange(len(items.ids)))] if parts and len(items.ids) else []
    while work:
        parts, which = work.pop()
        longest = int(items.length[which].max())
        reach = (1 + DRIFT) * longest  # a chain has at most as many links as the item has tokens
        whole = len(parts) == 1 and len(parts[0][1]) <= 3 * reach
        got = search(parts, items, which, None if whole and len(which) == 1 else most)
        if got is not None:
            found |= got
        elif len(parts) > 1:
            work += [(parts[: len(parts) // 2], which), (parts[len(parts) // 2 :], which)]
        elif not whole:
            i, toks = parts[0]
            work += [([(i, np.append(toks[k : k + 3 * reach], other))], which) for k in range(0, len(toks) - reach, 2 * reach)]
        else:
            work += [(parts, which[: len(which) // 2]), (parts, which[len(which) // 2 :])]
    return sorted(found)


def leaks(docs: DataFrame, tests: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """(doc_id, item_id) of every document that contains a passage of an item.

    Test items beyond ``most_chars`` characters are asked for in sets of about that size, each in a pass of its own.
    """
    tests = tests.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    sets = math.ceil(chars / most_chars) or 1
    rows, found = spread(docs.select("doc_id", "text").where("doc_id is not null")), None
    for k in range(sets):
        items = Items(sorted((r.item_id, r.text) for r in tests.where(F.pmod(F.xxhash64("item_id"), F.lit(sets)) == k).collect()))
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(doc_id: list, text: list, shared=shared) -> dict[str, list]:  # noqa: ANN001
            items = shared.value
            got = leaked(text, items)
            return {"doc_id": [doc_id[d] for d, _ in got], "item_id": [int(items.ids[i]) for _, i in got]}

        one = map_columns(rows, run, "doc_id bigint, item_id bigint", SHARD_ROWS)
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that remain when those that leak are removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id is not null")
    return docs.join(p8_found(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_anti")


QUERIES = {"p8_found": p8_found, "p8_clean": p8_clean}

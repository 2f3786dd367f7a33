"""Runs of words: stretches that repeat in a short period, by an enhanced suffix array.

Texts of a batch are searched together. A suffix array over all of them (words of
different texts never compare equal) comes from sorting by ranks of doubling length; the
lengths of common prefixes come from the same ranks. Each interval of equal prefixes of
`depth` words is visited once, from the array of those lengths alone. For every suffix i
of its smaller children the test is whether i + depth or i - depth lies in the interval
too, in another child: then a square of that period stands there which cannot be rotated
to the right. Rotating it to the left gives the whole run; squares of one run all rotate
from the same one, and a root that is itself a repetition is merged into its run.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import OWN

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def suffix_order(codes):
    """(suffix array, its inverse, common prefixes with the suffix before) of an integer
    array. Ranks by the first 1, 2, 4 … items are kept until all differ: where two
    neighbours agree on the ranks of a power, they share that many items more."""
    n = len(codes)
    ranks = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while True:
        rank = ranks[-1]
        second = np.zeros(n, np.int64)
        if width < n:
            second[:n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        step = np.ones(n, np.int64)
        step[0] = 0
        step[1:] = key[order[1:]] != key[order[:-1]]
        fresh[order] = np.cumsum(step)
        if fresh[order[-1]] == n - 1:
            break
        ranks.append(fresh)
        width *= 2
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    shared = np.zeros(n, np.int64)
    a, b = order[1:].copy(), order[:-1].copy()
    for level in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
        step = same.astype(np.int64) << level
        shared[1:] += step
        a += step
        b += step
    return order, inverse, shared


def squares(order, inverse, shared):
    """(start, period) of every square that cannot be rotated to the right. Intervals
    live on a stack while the common prefixes are read once; each knows only the places
    at which its children begin."""
    n = len(order)
    order, inverse, shared = order.tolist(), inverse.tolist(), shared.tolist()
    out = []

    def visit(depth, bounds):
        low, high = bounds[0], bounds[-1]
        wide = max(range(len(bounds) - 1), key=lambda c: bounds[c + 1] - bounds[c])
        wide_from, wide_to = bounds[wide], bounds[wide + 1]
        for child in range(len(bounds) - 1):
            if child == wide:
                continue
            begin, end = bounds[child], bounds[child + 1]
            for i in order[begin:end]:
                j = i + depth
                if j < n and low <= inverse[j] < high and not begin <= inverse[j] < end:
                    out.append((i, depth))
                # Two small children meet from the left member, above.
                j = i - depth
                if j >= 0 and wide_from <= inverse[j] < wide_to:
                    out.append((j, depth))

    stack = []
    for place in range(1, n + 1):
        depth = shared[place] if place < n else 0
        begin = place - 1
        while stack and stack[-1][0] > depth:
            closed, bounds = stack.pop()
            bounds.append(place)
            visit(closed, bounds)
            begin = bounds[0]
        if stack and stack[-1][0] == depth:
            stack[-1][1].append(place)
        elif depth:
            stack.append((depth, [begin, place]))
    return out


def runs_of(codes, least=12):
    """Sorted (start, length, smallest period) of all runs of an integer array that are
    of at least `least` items and two periods."""
    if len(codes) < 2:
        return []
    values = codes.tolist()
    ending, found = {}, []
    # By end, then period: a square whose root repeats comes after the run it lies in.
    for start, period in sorted(squares(*suffix_order(codes)),
                                key=lambda s: (s[0] + 2 * s[1], s[1])):
        end = start + 2 * period
        here = ending.setdefault(end, [])
        if any(period % p == 0 and s <= start for s, p in here):
            continue
        while start and values[start - 1] == values[start - 1 + period]:
            start -= 1
        here.append((start, period))
        if end - start >= least:
            found.append((start, end - start, period))
    return sorted(found)


def may_repeat(words, gram):
    """False only where no stretch of `gram` words stands twice. Equal words have equal
    hashes, so a collision can cost time but no run."""
    n = len(words) - gram + 1
    if n < 2:
        return False
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(gram):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + n]
    total.sort()
    return bool((total[1:] == total[:-1]).any())


def runs_of_texts(word_lists, least=12):
    """`runs_of` for each list of words, one suffix array for all. A run of `least` items
    and two periods holds a stretch of half of `least` that stands twice; lists without
    one have no run and stay out of the array."""
    out = [[] for _ in word_lists]
    searched = [k for k, words in enumerate(word_lists) if may_repeat(words, (least + 1) // 2)]
    codes, bases, base = [], [], 0
    for k in searched:
        known = {}
        shift = len(codes)
        codes += [base + known.setdefault(w, len(known)) for w in word_lists[k]]
        base += len(known)
        bases.append(shift)
    for start, length, period in runs_of(np.array(codes, np.int64), least):
        at = np.searchsorted(bases, start, side="right") - 1
        out[searched[at]].append((start - int(bases[at]), length, period))
    return out


def collapsed(words, runs):
    """The words left when each run keeps its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()),
                            ("period", pa.int64())]))


def _searched(least, block_words):
    def run(batches):
        for batch in batches:
            texts = batch.column(0)
            begin, block, size = 0, [], 0
            for k in range(batch.num_rows):
                block.append(WORD.findall(texts[k].as_py() or ""))
                size += len(block[-1])
                if size < block_words and k + 1 < batch.num_rows:
                    continue
                found = runs_of_texts(block, least)
                part = batch.slice(begin, k + 1 - begin)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array([len(w) for w in block], pa.int64()),
                     pa.array([[dict(zip(("start", "length", "period"), r, strict=True))
                                for r in runs] for runs in found], _RUNS),
                     pa.array([" ".join(collapsed(w, r))
                               for w, r in zip(block, found, strict=True)], pa.string())],
                    [*batch.schema.names[1:], "n_words", "runs", "collapsed"])
                begin, block, size = k + 1, [], 0
    return run


def runs(docs, text="text", least=12, block_words=300_000):
    """All columns of `docs` with `n_words`, `runs` (structs start, length, period in
    words, sorted by start, then period) and `collapsed` (the words left, joined by one
    space, when each run keeps its first period only).

    A run is a stretch of at least `least` words and two of its smallest periods that
    cannot be made longer with that period. NULL, empty and wordless texts have no words,
    no runs and an empty rest. Every text is searched whole: about `block_words` words
    share a suffix array, a longer text has one of its own. Each row is judged by itself,
    so repeated rows give repeated results and an empty table an empty one. Columns named
    like a result are replaced.
    """
    others = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    taken = docs.select(F.col(f"`{text}`").alias(OWN + "text"), *[f"`{c}`" for c in others])
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema[1:])
    return taken.mapInArrow(
        _searched(least, block_words), f"{given + ', ' if given else ''}n_words long, "
        "runs array<struct<start: long, length: long, period: long>>, collapsed string")

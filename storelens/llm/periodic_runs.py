"""Periodic runs of words: an enhanced suffix array's branching-tandem test.

The words of many documents are numbered so that no two documents share a number
and laid side by side: no repeat then crosses a document.  Prefix doubling ranks
all stretches of 1, 2, 4, ... words, which gives the suffix array, its inverse
ISA and exact common extensions in either direction, with no hashing.

Each LCP interval of depth D is a set of suffixes that share their first D words.
Leaving out the interval's largest child, every other suffix i is asked whether
i + D or i - D lies in the same interval (one ISA lookup each) and the next words
differ: then a square of period D stands there that cannot move right.  Every
word leaves all but log n of the intervals that hold it as part of the largest
child, so there are O(n log n) lookups, made as array operations over all
intervals at once; the intervals come from range minima, with no tree nodes.

Such a square is the last of its run.  Moving it left as far as the words stay
equal gives the run's start; squares whose period is a multiple of the smallest
one end up with the same start and end and are merged into it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import WORD_RE, release

MIN_LENGTH = 12
#: Text that one pass of the array operations takes (whole documents: a longer one goes alone).
PASS_BYTES = 2 << 20

_WORDS = re.compile(WORD_RE)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + size), one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Stretches:
    """Ranks of all stretches of 2**k words: equal ranks are equal stretches.

    ``ranks[k][i]`` is the number of suffixes below those that begin with the 2**k
    words at i; the last one ranks whole suffixes and is the inverse suffix array.
    """

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        _, codes, counts = np.unique(symbols, return_inverse=True, return_counts=True)
        first = np.cumsum(counts) - counts
        rank = first[codes].astype(np.int64)
        self.ranks = [rank]
        open_ = np.flatnonzero(counts[codes] > 1)
        width = 1
        while len(open_):
            then = open_ + width
            second = np.where(then < n, rank[np.minimum(then, n - 1)] + 1, 0)
            order = np.lexsort((second, rank[open_])) if n >= 1 << 31 else np.argsort(rank[open_] * (n + 1) + second, kind="stable")
            at, group, second = open_[order], rank[open_][order], second[order]
            place = np.arange(len(at))
            new_group = np.append(True, group[1:] != group[:-1])
            new_pair = new_group | np.append(True, second[1:] != second[:-1])
            group_first = np.maximum.accumulate(np.where(new_group, place, 0))
            pair_first = np.maximum.accumulate(np.where(new_pair, place, 0))
            rank = rank.copy()
            rank[at] = group + pair_first - group_first
            self.ranks.append(rank)
            alone = new_pair & np.append(new_pair[1:], True)
            open_ = np.sort(at[~alone])
            width *= 2
        self.isa = rank
        self.sa = np.empty(n, dtype=np.int64)
        self.sa[rank] = np.arange(n)

    def common_right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and b on are equal (a and b differ)."""
        far = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a + far, b + far
            inside = np.maximum(x, y) < self.n
            rank = self.ranks[k]
            same = inside & (rank[np.where(inside, x, 0)] == rank[np.where(inside, y, 0)])
            far += same << k
        return far

    def common_left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words that end at a and b (both included) are equal, a < b."""
        far = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a - far - (1 << k) + 1, b - far - (1 << k) + 1
            inside = x >= 0
            rank = self.ranks[k]
            same = inside & (rank[np.where(inside, x, 0)] == rank[np.where(inside, y, 0)])
            far += same << k
        return far


def _nearest_smaller(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place t of ``at`` the nearest places on both sides with h below h[t].

    ``h`` holds a smaller value at both ends.  Range minima over 1, 2, 4, ... places,
    as many as the longest stretch without a zero asks for.
    """
    zeros = np.flatnonzero(h <= 0)
    longest = int(np.diff(zeros).max())
    minima = [h]
    while (1 << len(minima)) <= longest:
        last, step = minima[-1], 1 << (len(minima) - 1)
        minima.append(np.minimum(last, np.append(last[step:], np.full(step, -1))))
    left, right, depth = at.copy(), at + 1, h[at]
    for k in range(len(minima) - 1, -1, -1):
        low, step = minima[k], 1 << k
        x = left - step
        left = np.where((x >= 0) & (low[np.maximum(x, 0)] >= depth), x, left)
        inside = right < len(h)
        right = np.where(inside & (low[np.where(inside, right, 0)] >= depth), right + step, right)
    return left - 1, right


def _squares(s: Stretches, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every square that the next word does not continue."""
    n = s.n
    h = np.zeros(n + 1, dtype=np.int64)  # h[t]: common words of suffixes t - 1 and t in order
    h[0] = h[n] = -1
    pairs = np.flatnonzero(s.ranks[0][s.sa[1:]] == s.ranks[0][s.sa[:-1]]) + 1
    if not len(pairs):
        return pairs, pairs
    h[pairs] = s.common_right(s.sa[pairs - 1], s.sa[pairs])
    low, high = _nearest_smaller(h, pairs)  # the interval's suffixes: low <= place < high
    order = np.lexsort((pairs, h[pairs], low))
    cut, low, high = pairs[order], low[order], high[order]
    depth = h[cut]
    first = np.append(True, (low[1:] != low[:-1]) | (depth[1:] != depth[:-1]))
    group = np.cumsum(first) - 1
    last = np.append(first[1:], True)
    # an interval's children lie between its cuts; the last child follows its last cut
    starts = np.concatenate([np.where(first, low, np.append(0, cut[:-1])), cut[last]])
    ends = np.concatenate([cut, high[last]])
    owner = np.concatenate([group, np.arange(group[-1] + 1)])
    sizes = ends - starts
    by_size = np.lexsort((starts, -sizes, owner))
    largest = by_size[np.append(True, owner[by_size][1:] != owner[by_size][:-1])]
    small = np.ones(len(sizes), dtype=bool)
    small[largest] = False
    starts, sizes, owner = starts[small], sizes[small], owner[small]
    i = s.sa[_ranges(starts, sizes)]
    owner = np.repeat(owner, sizes)
    depth, low, high = depth[last][owner], low[last][owner], high[last][owner]

    padded = np.append(symbols, -1)
    found = []
    for a, b in ((i, i + depth), (i - depth, i)):
        other = b if a is i else a
        inside = (other >= 0) & (other < n)
        place = s.isa[np.where(inside, other, 0)]
        inside &= (place >= low) & (place < high)
        a, b, d = a[inside], b[inside], depth[inside]
        ends_here = padded[b] != padded[np.minimum(b + d, n)]
        found.append((a[ends_here], d[ends_here]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def find_runs(symbols: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least ``min_length`` symbols, by start, then period.

    ``symbols`` are numbers of 0 or more.  A run is a stretch with a smallest period q,
    at least 2 * q long, that no neighbour extends.
    """
    if len(symbols) < 2:
        return np.empty((0, 3), dtype=np.int64)
    s = Stretches(symbols)
    at, period = _squares(s, symbols)
    if not len(at):
        return np.empty((0, 3), dtype=np.int64)
    end = at + 2 * period
    left = np.where(at > 0, s.common_left(at - 1, at - 1 + period), 0)
    start = at - left
    long = end - start >= min_length
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[:len(start)]
    runs = np.stack([start, end - start, period], axis=1)[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of_texts(texts: list[str | None], min_length: int = MIN_LENGTH) -> list[tuple[int, np.ndarray, str]]:
    """Number of words, runs and collapsed text of each text, in one pass over all of them."""
    words = [_WORDS.findall(t or "") for t in texts]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    begins = np.cumsum(lengths) - lengths
    flat = [w for some in words for w in some]
    codes, distinct = pd.factorize(np.array(flat, dtype=object)) if flat else (np.empty(0, dtype=np.int64), ())
    document = np.repeat(np.arange(len(words)), lengths)
    symbols = document * (len(distinct) + 1) + codes
    runs = find_runs(symbols, min_length)
    edges = np.searchsorted(runs[:, 0], np.append(begins, len(flat)))
    out = []
    for k, some in enumerate(words):
        mine = runs[edges[k]:edges[k + 1]] - [begins[k], 0, 0]
        if len(mine):
            covers = np.zeros(len(some) + 1, dtype=np.int64)
            np.add.at(covers, mine[:, 0] + mine[:, 2], 1)
            np.add.at(covers, mine[:, 0] + mine[:, 1], -1)
            kept = np.flatnonzero(np.cumsum(covers)[:-1] == 0)
            some = [some[x] for x in kept]
        out.append((int(lengths[k]), mine, " ".join(some)))
    return out


def _passes(b: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about ``most`` bytes of text."""
    offsets = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < b.num_rows:
        done = offsets[a - 1] if a else 0
        z = max(a + 1, int(np.searchsorted(offsets, done + most, side="right")))
        yield b.slice(a, z - a)
        a = z


def periodic_runs(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, min_length: int = MIN_LENGTH) -> DataFrame:
    """All periodic runs of every text's words, and the text with each run cut to its first period.

    One row per row of ``docs``: ``carried`` (a struct of the columns in ``carry``),
    ``n_words`` long, ``runs`` (array of start, length, period in words, by start, then
    period) and ``collapsed`` (the kept words joined by one space: a word goes if any run
    holds it after that run's first ``period`` words).  A run has a smallest period q, at
    least max(``min_length``, 2 * q) words, and no neighbouring word continues it.

    Documents are worked through where they are read, with no shuffle.  Null and empty
    texts have no words and no runs; repeated rows are treated one by one; an empty table
    gives an empty result; columns that are not carried are not read.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c != text_col]
    rows = docs.select(F.struct(*[F.col(c) for c in carry]).alias("carried") if carry else F.struct(F.lit(0).alias("none")).alias("carried"),
                       F.col(text_col).cast("string").alias("text"))

    def work(batches):
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for b in batches:
            for some in _passes(b, PASS_BYTES):
                found = runs_of_texts(some.column("text").to_pylist(), min_length)
                edges = np.cumsum([0] + [len(f[1]) for f in found])
                flat = np.concatenate([f[1] for f in found])
                runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(flat[:, x]) for x in range(3)], fields=list(run)))
                yield pa.RecordBatch.from_arrays(
                    [some.column("carried"), pa.array([f[0] for f in found], pa.int64()), runs, pa.array([f[2] for f in found], pa.string())],
                    ["carried", "n_words", "runs", "collapsed"])
        release()

    shape = rows.schema["carried"].dataType.simpleString()
    return rows.mapInArrow(work, f"carried {shape}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")

"""External induced sorting of the suffixes of one shard, with common-prefix values.

Suffixes are S-type or L-type by comparison with their right neighbour; S* suffixes are
S-type with an L-type to their left. The S* suffixes are ordered first (their substrings
are named, and the string of names is ordered recursively); then a left-to-right scan
induces the L-type suffixes from them, and a right-to-left scan the S-type ones.

The scans are driven by a monotone priority queue: suffix tuples (position, common prefix
with the tuple before) wait in the bucket of their first character, in order of arrival,
which is the order of the suffixes behind them. Everything of one character that is known
is taken at once, so the work is done by whole arrays; buckets beyond a memory budget are
kept in one scratch file. Common prefixes are carried along: two neighbours of a bucket
share one character more than the smallest common prefix met between the suffixes that
induced them.

Only the first ``depth`` characters matter to the caller, so common prefixes saturate there.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

_BYTES = np.array([1 << (8 * i) for i in range(1, 8)], np.uint64)
BASE = 1 << 23            # names that are ordered in memory; longer strings of names recurse


class BucketQueue:
    """Monotone priority queue of suffix tuples by first character, spilled to a scratch file."""

    def __init__(self, budget: int) -> None:
        self.budget, self.held = budget, 0
        self.buckets: dict[int, list] = {}
        self.file = None

    def push(self, chars: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Tuples grouped by character; within a character in order of arrival."""
        if not len(chars):
            return
        edge = np.concatenate([[0], np.flatnonzero(chars[1:] != chars[:-1]) + 1, [len(chars)]])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            self.buckets.setdefault(int(chars[a]), []).append((pos[a:b], lcp[a:b]))
        self.held += pos.nbytes + lcp.nbytes
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="induce-")
        for segments in self.buckets.values():
            for k, s in enumerate(segments):
                if len(s) == 2:
                    at = self.file.seek(0, 2)
                    self.file.write(s[0].tobytes())
                    self.file.write(s[1].tobytes())
                    segments[k] = (at, len(s[0]), s[0].dtype, s[1].dtype)
        self.held = 0

    def pop(self, char: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All waiting tuples of a character, in order; None if there are none."""
        segments = self.buckets.pop(char, None)
        if not segments:
            return None
        parts = []
        for s in segments:
            if len(s) == 2:
                self.held -= s[0].nbytes + s[1].nbytes
                parts.append(s)
            else:
                at, n, kind, small = s
                self.file.seek(at)
                parts.append((np.frombuffer(self.file.read(n * kind.itemsize), kind),
                              np.frombuffer(self.file.read(n * small.itemsize), small)))
        self.held = max(self.held, 0)
        if len(parts) == 1:
            return parts[0]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def s_types(t: np.ndarray) -> np.ndarray:
    """True for S-type suffixes; the empty suffix after the end is the smallest."""
    n = len(t)
    up = np.zeros(n, np.int8)
    up[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1].astype(np.int64))
    up[-1] = -1
    at = np.where(up != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    return up[nxt] > 0


def dense(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Ranks from a sorting order and flags of where a new value begins."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank


class Shard:
    """The suffixes of a string of bytes (or, in the recursion, of names), all at least 1: 0 stands for its end."""

    def __init__(self, t: np.ndarray, depth: int, budget: int = 256 << 20, base: int = BASE) -> None:
        self.t, self.depth, self.budget, self.base = t, depth, budget, base
        self.pos = np.int32 if len(t) < 1 << 31 else np.int64
        s = s_types(t)
        self.star = np.flatnonzero(s[1:] & ~s[:-1]) + 1
        self.bytes = t.dtype == np.uint8
        if self.bytes:
            # 8 characters from each position as one number, for wide comparisons
            self.padded = np.concatenate([t, np.zeros(depth + 16, np.uint8)])
        else:
            self.ended = np.append(t, 0)

    # -- order of the S* suffixes ---------------------------------------------------------
    def words(self, at: np.ndarray) -> np.ndarray:
        """The 8 bytes at each position as a big-endian number."""
        w = np.ndarray((len(self.padded) - 7,), "<u8", self.padded.data, strides=(1,))
        return w[at].byteswap()

    def names(self) -> np.ndarray:
        """Ranks of the S* substrings (each to the next S* character inclusive, at most ``depth`` long). Where
        one is a prefix of another the longer is smaller: the character the shorter ends with is S-type
        in the shorter only. So a substring is compared as if infinity followed it."""
        star, end = self.star, len(self.t)
        size = np.minimum(np.append(star[1:], end) + 1 - star, self.depth)
        rank, live, off = np.zeros(len(star), np.int64), np.arange(len(star)), 0
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        while len(live):
            left = size[live] - off
            if self.bytes:
                key = self.words(np.minimum(star[live] + off, end))
                short = left < 8
                cover = np.maximum(left[short], 0).astype(np.uint64) * np.uint64(8)
                key[short] |= ones >> cover
                off += 8
            else:
                key = np.where(left > 0, self.ended[np.minimum(star[live] + off, end)], np.iinfo(np.int64).max)
                off += 1
            rank, live = self._refine(rank, live, key)
            if len(live):                        # groups whose members all end here stay as they are
                by = live[np.argsort(rank[live], kind="stable")]
                edge = np.flatnonzero(np.concatenate([[True], rank[by][1:] != rank[by][:-1]]))
                longest = np.maximum.reduceat(size[by], edge)
                live = np.sort(by[np.repeat(longest > off, np.diff(np.append(edge, len(by))))])
        tied = np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)
        return self._refine(rank, tied, -size[tied])[0]

    @staticmethod
    def _refine(rank: np.ndarray, live: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Split the groups of equal rank by a key of their ``live`` members (whole groups). Ranks are the
        index of a group's first member in the order; returns them and the members still tied."""
        if not len(live):
            return rank, live
        if (rank[live] == rank[live[0]]).all():
            order = np.argsort(key)
        elif key.dtype == np.int64 and len(rank) < 1 << 31 and -(1 << 31) <= key.min() and key.max() < 1 << 31:
            order = np.argsort(rank[live] << 32 | key + (1 << 31))      # both fit in one number
        else:
            order = np.lexsort((key, rank[live]))
        k, r = key[order], rank[live][order]
        first = np.concatenate([[True], r[1:] != r[:-1]])
        new = first | np.concatenate([[True], k[1:] != k[:-1]])
        n = np.arange(len(order))
        group_at = np.maximum.accumulate(np.where(first, n, 0))
        new_at = np.maximum.accumulate(np.where(new, n, 0))
        rank = rank.copy()
        rank[live[order]] = r + (new_at - group_at)
        tied = ~(new & np.concatenate([new[1:], [True]]))
        return rank, np.sort(live[order][tied])

    def star_order(self) -> np.ndarray:
        """The S* suffixes in order."""
        rank = self.names()
        m = len(rank)
        if m <= self.base:
            return self.star[np.argsort(self._double(rank), kind="stable")]
        if len(np.unique(rank)) == m:
            return self.star[np.argsort(rank)]
        inner = Shard(rank + 1, self.depth, self.budget, self.base)
        return self.star[inner.order()]

    def _double(self, rank: np.ndarray) -> np.ndarray:
        """Order a string of names in memory: the rank of 2k names from two ranks of k names. A name covers
        two characters at least, so the doubling ends at ``depth`` characters; groups that are single stay."""
        m, k = len(rank), 1
        count = np.bincount(rank, minlength=m)
        live = np.flatnonzero(count[rank] > 1)
        while len(live) and 2 * k < self.depth:
            nxt = np.where(live + k < m, rank[np.minimum(live + k, m - 1)], -1)
            rank, live = self._refine(rank, live, nxt)
            k *= 2
        return rank

    # -- common prefixes -------------------------------------------------------------------
    def direct_lcp(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of suffixes, up to ``depth``, by 8-byte comparisons."""
        out = np.zeros(len(a), np.int64)
        live, off = np.arange(len(a)), 0
        limit = np.minimum(len(self.t) - np.maximum(a, b), self.depth)
        while len(live):
            x = self.words(a[live] + off) ^ self.words(b[live] + off)
            # leading equal bytes of the two numbers
            same = 7 - np.searchsorted(_BYTES, x, side="right")
            same[x == 0] = 8
            out[live] += same
            off += 8
            live = live[(same == 8) & (out[live] < limit[live])]
        return np.minimum(out, limit)

    # -- induction -------------------------------------------------------------------------
    def order(self) -> np.ndarray:
        """All suffixes in order."""
        parts = [pos for pos, _ in self.stretches()]
        return np.concatenate(parts[::-1]) if parts else np.zeros(0, np.int64)

    def stretches(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Consecutive stretches of the suffix order, the last one first: positions in order, and the common
        prefix of each with the suffix before it (0 for the first of a character)."""
        t, n = self.t, len(self.t)
        if not n:
            return
        star = self.star_order().astype(self.pos)
        star_lcp = np.zeros(len(star), np.uint8)
        if len(star) > 1 and self.bytes:
            star_lcp[1:] = self.direct_lcp(star[:-1].astype(np.int64), star[1:].astype(np.int64))
        chars = np.unique(t).tolist()
        star_char = t[star]
        star_edge = dict(zip(*(x.tolist() for x in np.unique(star_char, return_index=True)))) if len(star) else {}
        star_n = dict(zip(*(x.tolist() for x in np.unique(star_char, return_counts=True)))) if len(star) else {}

        # left to right: L-type suffixes
        left = _Scan(self, up=True)
        left.queue.push(t[n - 1:], np.array([n - 1], self.pos), np.zeros(1, np.uint8))
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for c in chars:
            got = []
            while (batch := left.queue.pop(c)) is not None:
                if not got:
                    batch = (batch[0], _zero_first(batch[1]))
                got.append(batch)
                left.scan(c, *batch, equal=True)
            if got:
                found[c] = (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
            if c in star_n:
                a = star_edge[c]
                pos, lcp = star[a:a + star_n[c]], _zero_first(star_lcp[a:a + star_n[c]])
                if got:
                    lcp[0] = self._boundary(found[c][0][-1], pos[0])
                left.scan(c, pos, lcp, equal=False)
        left.queue.close()
        del star, star_lcp

        # right to left: S-type suffixes
        right = _Scan(self, up=False)
        for c in reversed(chars):
            got = []
            while (batch := right.queue.pop(c)) is not None:
                if not got:
                    batch = (batch[0], _zero_first(batch[1]))
                got.append(batch)
                right.scan(c, *batch, equal=True)
            large = None
            if got:
                # descending positions; turned around, each keeps the prefix it shares with the one before
                pos = np.concatenate([g[0] for g in got])[::-1]
                lcp = np.concatenate([g[1] for g in got])[::-1]
                large = (pos, np.concatenate([[0], lcp[:-1]]).astype(np.uint8))
            small = found.pop(c, None)
            if small is not None:
                pos, lcp = small
                down = np.concatenate([[0], lcp[1:][::-1]]).astype(np.uint8)
                if large is not None:
                    down[0] = self._boundary(pos[-1], large[0][0])
                    large[1][0] = down[0]
                right.scan(c, pos[::-1], down, equal=False)
            if large is not None:
                yield large
            if small is not None:
                yield small
        right.queue.close()

    def _boundary(self, a, b) -> int:
        if not self.bytes:
            return 0
        return int(self.direct_lcp(np.array([a], np.int64), np.array([b], np.int64))[0])


def _zero_first(lcp: np.ndarray) -> np.ndarray:
    out = lcp.copy()
    out[0] = 0
    return out


class _Scan:
    """One scan over the suffixes in order: takes batches, induces the suffixes one to the left."""

    def __init__(self, shard: Shard, up: bool) -> None:
        self.shard, self.up = shard, up
        self.queue = BucketQueue(shard.budget)
        #: smallest common prefix met since the last tuple of a character
        self.since = np.full(256, 255, np.uint8) if shard.bytes else None

    def scan(self, c: int, pos: np.ndarray, lcp: np.ndarray, equal: bool) -> None:
        """``equal``: the batch may induce suffixes of its own character."""
        t = self.shard.t
        before = pos - 1
        ch = t[before]                        # position -1 wraps; masked out below
        ok = (ch > c) if self.up else (ch < c)
        if equal:
            ok |= ch == c
        ok &= before >= 0
        at = np.flatnonzero(ok)
        key = ch[at]
        turn = np.argsort(key, kind="stable")
        at, key = at[turn], key[turn]
        if self.since is None:
            self.queue.push(key, before[at], np.zeros(len(at), np.uint8))
            return
        table = _minima(lcp)
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        start = np.empty(len(at), np.int64)
        start[1:] = at[:-1] + 1
        start[new] = 0
        low = _range_min(table, start, at)
        head = key[new]
        low[new] = np.minimum(low[new], self.since[head])
        # what the next tuple of each character starts from
        rest = np.minimum(self.since, lcp.min())
        last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] if len(at) else at
        tail = np.full(len(last), 255, np.uint8)
        more = last + 1 < len(lcp)
        tail[more] = _range_min(table, last[more] + 1, np.full(int(more.sum()), len(lcp) - 1))
        rest[head] = tail
        self.since = rest
        self.queue.push(key, before[at], np.minimum(low.astype(np.int64) + 1, self.shard.depth).astype(np.uint8))


def _minima(a: np.ndarray) -> list[np.ndarray]:
    """Minima of all stretches of 1, 2, 4, ... elements."""
    out, step = [a], 1
    while 2 * step <= len(a):
        p = out[-1]
        out.append(np.minimum(p[:-step], p[step:]))
        step *= 2
    return out


def _range_min(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of a[lo..hi] (inclusive) of each pair."""
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.uint8)
    for k in range(len(table)):
        m = np.flatnonzero(level == k)
        if len(m):
            out[m] = np.minimum(table[k][lo[m]], table[k][hi[m] - (1 << k) + 1])
    return out


def repeated_positions(t: np.ndarray, depth: int, budget: int = 256 << 20, base: int = BASE) -> np.ndarray:
    """True where the ``depth`` (at most 254) characters from a position of a byte string also start at another."""
    out = np.zeros(len(t), bool)
    joins_next = False
    for pos, lcp in Shard(t, depth, budget, base).stretches():
        hit = lcp >= depth
        out[pos[hit]] = True
        out[pos[:-1][hit[1:]]] = True
        if joins_next:
            out[pos[-1]] = True
        joins_next = bool(hit[0])
    return out

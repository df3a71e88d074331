"""Removal of repeated byte strings with a sparse suffix array, built by a distributed merge sort that knows prefixes.

Every byte covered by a string of `length` bytes that also starts elsewhere goes. A window of that many bytes is named
by its anchor, the place of the smallest hash of 16 bytes in it, and by the anchor's offset; equal windows have equal
anchors at equal offsets. So only suffixes at anchors are sorted (about one per 190 bytes of ordinary text): those that
run to the right of an anchor, and those that run to the left. Where both neighbourhoods agree far enough, the windows
between are equal.

1. Texts are gathered into blocks of some megabytes, written once and read by the later steps.
2. A window reaches half its length to the left or to the right of its anchor. Hashes of those halves are exchanged;
   an anchor whose halves occur nowhere else takes no further part.
3. Each block sorts the suffixes of its other anchors, drops equal ones and sends sorted runs, front-coded (shared
   prefix length and rest), to buckets by the anchor's 16 bytes.
4. Each bucket merges its runs with a loser tree. Every contender carries the length of the prefix it shares with the
   last output; unequal lengths decide at once, and equal ones are compared from there on only. The merged order and
   its prefix lengths give the classes of suffixes equal to any depth, as a tree. A pair of a right and a left class
   that holds two anchors marks equal windows.
5. Marked windows go back to their blocks, which cut the texts.

Runs of a short period would have an anchor in each period. There a window equals its neighbour one period on, which
the block sees by itself; the windows of the first period stand for the run.

Input: any columns, text among them (null: empty). Rows are independent but for what they share; repeated rows remove
each other. An empty table gives no rows. Output: row (the other columns as a struct), n_bytes, n_removed, starts and
ends of removed spans, kept (bytes), text (kept, but with characters whole that were removed in part).
"""

from __future__ import annotations

import marshal
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path
from .common import hold

GRAM = 16
BLOCK_BYTES = 4 << 20
SEGMENT = 1 << 20
DENSE = 64
BUCKETS_PER_PARTITION = 4


# --- anchors ------------------------------------------------------------------------------------
def _gram_hashes(a: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from each place on."""
    x = a.astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[:-shift] | x[shift:] << np.uint64(8 * shift)
    x = x[:-8] * np.uint64(0x9E3779B97F4A7C15) + (x[8:] ^ x[8:] >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def _window_anchors(a: np.ndarray, length: int) -> np.ndarray:
    """Anchor of each window of `length` bytes in a; the leftmost of equal hashes."""
    width = length - GRAM + 1
    low = np.uint64((1 << 24) - 1)
    m = _gram_hashes(a) & ~low | np.arange(len(a) - GRAM + 1, dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[:span - width], m[width - span:])
    return (m & low).astype(np.int64)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of True."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _periodic(a: np.ndarray, anchors: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(first, last window, period) of runs in which a window equals the one a period later, for periods that show as
    gaps between anchors."""
    gaps = np.diff(anchors)
    period, n = np.unique(gaps[gaps <= DENSE], return_counts=True)
    out = []
    for p in period[n >= 8].tolist():
        first, last = _runs(a[p:] == a[:-p])
        long = last - first + 1 >= length
        out += [(f, g - length + 1, p) for f, g in zip(first[long].tolist(), last[long].tolist())]
    return out


def anchors_of(a: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """a: the bytes of a block's texts, ends: where each text ends. Returns anchors, rows of (place, smallest offset,
    largest offset, begin and end of the text), and the windows that equal a neighbour, rows of (first, last)."""
    rows, local = [], []
    begins = np.concatenate(([0], ends[:-1]))
    valid = np.zeros(len(a) + 1, np.int8)
    big = ends - begins >= length
    np.add.at(valid, begins[big], 1)
    np.add.at(valid, ends[big] - length + 1, -1)
    valid = np.cumsum(valid).astype(bool)
    for at in range(0, max(0, len(a) - length + 1), SEGMENT):
        part = a[at:at + SEGMENT + length - 1]
        ok = valid[at:at + len(part) - length + 1].copy()
        if not ok.any():
            continue
        anchor = _window_anchors(part, length)
        change = np.flatnonzero(np.diff(anchor[ok])) + 1
        if len(change) > ok.sum() / DENSE:
            for first, last, p in _periodic(part, anchor[ok][np.concatenate(([0], change))], length):
                # both windows must lie in one text: cut the run at windows that do not
                both = ok[first:last + 1] & ok[first + p:last + p + 1]
                for f, g in zip(*_runs(both)):
                    whole = np.flatnonzero(np.isin(begins, np.arange(first + f + 1 + at, first + g + p + 1 + at)))
                    if len(whole):
                        continue
                    local.append((at + first + f, at + first + g + p))
                    ok[first + f + p:first + g + p + 1] = False
        s = np.flatnonzero(ok)
        if not len(s):
            continue
        w = anchor[s]
        cut = np.flatnonzero((np.diff(w) != 0) | (np.diff(s) != 1)) + 1
        first, last = s[np.concatenate(([0], cut))], s[np.concatenate((cut - 1, [len(s) - 1]))]
        p = w[np.concatenate(([0], cut))]
        text = np.searchsorted(ends, at + p, side="right")
        rows.append(np.stack((at + p, p - last, p - first, begins[text], ends[text]), axis=1))
    rows = np.concatenate(rows) if rows else np.zeros((0, 5), np.int64)
    if len(rows):  # an anchor's windows may have come in several parts
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        first = np.flatnonzero(np.concatenate(([True], np.diff(rows[:, 0]) > 0)))
        rows = np.stack((rows[first, 0], np.minimum.reduceat(rows[:, 1], first), np.maximum.reduceat(rows[:, 2], first),
                         rows[first, 3], rows[first, 4]), axis=1)
    return rows, np.array(local, np.int64).reshape(-1, 2)


def half_hashes(raw: bytes, anchors: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the half window right and left of each anchor, and which of them matter."""
    half = length // 2
    view, h = memoryview(raw), xxhash.xxh3_64_intdigest
    p, lo, hi, begin, end = anchors.T
    right = (lo <= half) & (p + half <= end)
    left = (hi >= half) & (p - half >= begin)
    keys = np.zeros((2, len(p)), np.uint64)
    keys[0, right] = [h(view[i:i + half], 1) for i in p[right].tolist()]
    keys[1, left] = [h(view[i - half:i], 2) for i in p[left].tolist()]
    return keys.view(np.int64), right, left


# --- passages by words --------------------------------------------------------------------------
_table = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
WORD_GRAM = 4


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))), dtype=np.uint64)


class Passages:
    """Windows of `words` words in the texts of a block: first and end (bytes), key, and of each the half that lies on
    the longer side of its anchor, the word where the smallest hash of four words begins. Equal windows have equal
    halves, and there is one anchor for about half a window of words, so halves are few."""

    def __init__(self, a: np.ndarray, ends: np.ndarray, words: int):
        space = _SPACE[a]
        cut = np.zeros(len(a) + 1, bool)
        cut[np.concatenate(([0], ends))] = True
        self.start = np.flatnonzero(~space & (np.concatenate(([True], space[:-1])) | cut[:-1]))
        self.stop = np.flatnonzero(~space & (np.concatenate((space[1:], [True])) | cut[1:])) + 1
        text = np.searchsorted(ends, self.start, side="right")
        n = len(self.start) - words + 1
        i = np.flatnonzero(text[:n] == text[words - 1:]) if n > 0 else np.zeros(0, np.int64)
        self.first, self.end = self.start[i], self.stop[i + words - 1]
        self.key, self.half_of, self.half_key = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(i):
            return
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_table[a] * _powers(_BASE, len(a))[:-1], dtype=np.uint64)))
        self.back = _powers(pow(_BASE, -1, 1 << 64), len(a))
        m = np.arange(len(self.start) - WORD_GRAM + 1)
        low = np.uint64((1 << len(m).bit_length()) - 1)
        m = self._hash(m, m + WORD_GRAM - 1, 1) & ~low | m.astype(np.uint64)
        width, span = words - WORD_GRAM + 1, 1
        while 2 * span <= width:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < width:
            m = np.minimum(m[:span - width], m[width - span:])
        p = (m & low).astype(np.int64)[i]
        half = words // 2
        right = p - i <= words - 1 - half
        code, self.half_of = np.unique(2 * p + right, return_inverse=True)
        p, right = code >> 1, code & 1
        u, v = np.where(right, p, p + WORD_GRAM - 1 - half), np.where(right, p + half, p + WORD_GRAM - 1)
        self.half_key = np.where(right, self._hash(u, v, 2), self._hash(u, v, 3)).view(np.int64)
        self.key = self._hash(i, i + words - 1, 4).view(np.int64)
        del self.sums, self.back

    def _hash(self, i: np.ndarray, j: np.ndarray, seed: int) -> np.ndarray:
        """Of the bytes from word i to the end of word j."""
        x = (self.sums[self.stop[j]] - self.sums[self.start[i]]) * self.back[self.start[i]] + np.uint64(seed)
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xC2B2AE3D27D4EB4F)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
        return x ^ x >> np.uint64(32)

    def candidates(self, known: np.ndarray) -> np.ndarray:
        """Indices of windows whose half occurs again, here or in other blocks."""
        return np.flatnonzero(_again(self.half_key, known)[self.half_of]) if len(self.half_of) else self.half_of


def _again(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys occur twice or are known."""
    _, of, n = np.unique(keys, return_inverse=True, return_counts=True)
    return (n > 1)[of] | np.isin(keys, known)


# --- sorted runs --------------------------------------------------------------------------------
def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first `known` bytes are not looked at."""
    n = min(len(a), len(b)) - known
    if n <= 0:
        return known + n
    x = int.from_bytes(a[known:known + n], "big") ^ int.from_bytes(b[known:known + n], "big")
    return known + n - (x.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Sorted strings as prefix lengths, lengths and rests."""
    lcp = [0] + [shared(x, y) for x, y in zip(strings, strings[1:])]
    return (np.array(lcp, np.uint16).tobytes(), np.array([len(x) for x in strings], np.uint16).tobytes(),
            b"".join([x[n:] for x, n in zip(strings, lcp)]))


def front_decode(lcp: bytes, lengths: bytes, rest: bytes) -> tuple[list[int], list[bytes]]:
    prefix, out, last, at = np.frombuffer(lcp, np.uint16).tolist(), [], b"", 0
    for n, total in zip(prefix, np.frombuffer(lengths, np.uint16).tolist()):
        last = last[:n] + rest[at:at + total - n]
        at += total - n
        out.append(last)
    return prefix, out


class LoserTree:
    """Merges sorted streams of (prefix lengths, strings). At each inner node waits the loser of the match there, with
    the length of the prefix it shares with the winner."""

    def __init__(self, streams: list[tuple[list[int], list[bytes]]]):
        self.size = 1
        while self.size < len(streams):
            self.size *= 2
        self.lcp = [s[0] for s in streams]
        self.strings = [s[1] for s in streams]
        self.at = [0] * len(streams)
        self.loser = [(-1, -1)] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> tuple[int, int]:
        if node >= self.size:
            k = node - self.size
            return (k, 0) if k < len(self.strings) and self.strings[k] else (-1, -1)
        left, right = self._build(2 * node), self._build(2 * node + 1)
        win, self.loser[node] = self._match(left, right)
        return win

    def _match(self, x: tuple[int, int], y: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """Winner and loser; both carry the prefix shared with the last output. An ended stream carries -1."""
        if x[1] != y[1]:
            return (x, y) if x[1] > y[1] else (y, x)
        if x[0] < 0:
            return x, y
        a, b = self.strings[x[0]][self.at[x[0]]], self.strings[y[0]][self.at[y[0]]]
        n = shared(a, b, x[1])
        if n == len(a) or n < len(b) and a[n] < b[n]:
            return x, (y[0], n)
        return y, (x[0], n)

    def merged(self) -> Iterator[tuple[int, int, int]]:
        """(stream, index, prefix shared with the output before), in order."""
        while self.winner[0] >= 0:
            k, n = self.winner
            i = self.at[k]
            yield k, i, n
            self.at[k] = i = i + 1
            now = (k, self.lcp[k][i]) if i < len(self.strings[k]) else (-1, -1)
            node = (k + self.size) // 2
            loser = self.loser
            while node:
                other = loser[node]
                if now[1] < other[1]:
                    loser[node], now = now, other
                elif now[1] == other[1]:
                    now, loser[node] = self._match(now, other)
                node //= 2
            self.winner = now


class Classes:
    """Tree of the classes of strings that agree to some depth. leaf[stream][index] is a string's own node."""

    def __init__(self, streams: list[tuple[list[int], list[bytes]]], weights: list[list[int]]):
        self.depth, self.parent, self.weight = [0], [0], [0]
        self.leaf = [[0] * len(s[1]) for s in streams]
        stack = [0]
        for k, i, n in LoserTree(streams).merged():
            length, popped = len(streams[k][1][i]), -1
            while self.depth[stack[-1]] > n:
                popped = stack.pop()
            if popped >= 0 and self.depth[stack[-1]] < n:
                self._add(n, stack[-1])
                self.parent[popped] = len(self.depth) - 1
                stack.append(len(self.depth) - 1)
            if self.depth[stack[-1]] < length:
                self._add(length, stack[-1])
                stack.append(len(self.depth) - 1)
            self.leaf[k][i] = stack[-1]
            self.weight[stack[-1]] += weights[k][i]
        for node in sorted(range(1, len(self.depth)), key=lambda x: -self.depth[x]):
            self.weight[self.parent[node]] += self.weight[node]

    def _add(self, depth: int, parent: int) -> None:
        self.depth.append(depth)
        self.parent.append(parent)
        self.weight.append(0)


def common_windows(right: Classes, left: Classes, pairs: Counter, length: int) -> dict[tuple, list[tuple[int, int]]]:
    """pairs: (right leaf, left leaf, smallest offset, largest offset) -> anchors. Returns for each the ranges of
    offsets whose windows another anchor has too."""
    pieces: dict[tuple, list[tuple[int, int, tuple[int, int]]]] = {}
    held: Counter = Counter()
    rd, rp, rw, ld, lp, lw = right.depth, right.parent, right.weight, left.depth, left.parent, left.weight
    for key, n in pairs.items():
        r, leaf, lo, hi = key
        chain = [leaf]
        while ld[lp[chain[-1]]] >= lo + GRAM:
            chain.append(lp[chain[-1]])
        mine, o = [], lo
        while o <= hi:
            while rd[rp[r]] >= length - o:
                r = rp[r]
            while ld[chain[-1]] < o + GRAM:
                chain.pop()
            x = chain[-1]
            # the right class holds down to one past its parent's depth, the left one to its own depth
            to = min(hi, length - rd[rp[r]] - 1, ld[x] - GRAM)
            if rw[r] > 1 and lw[x] > 1:
                mine.append((o, to, (r, x)))
                held[r, x] += n
            o = to + 1
        if mine:
            pieces[key] = mine
    out = {}
    for key, mine in pieces.items():
        spans = []
        for lo, hi, rx in mine:
            if held[rx] > 1:
                if spans and spans[-1][1] + 1 == lo:
                    spans[-1] = (spans[-1][0], hi)
                else:
                    spans.append((lo, hi))
        if spans:
            out[key] = spans
    return out


def _pack(x) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(marshal.dumps(x))


def _unpack(x: bytes):
    return marshal.loads(zstandard.ZstdDecompressor().decompress(x))


def _ints(x) -> bytes:
    return np.ascontiguousarray(x, np.int64).tobytes()


def runs_of_block(raw: bytes, ends: np.ndarray, known: np.ndarray, length: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """known: sorted half hashes that other blocks have too. Yields (bucket, run) and, as bucket -1, the block's own
    list of anchors with their bucket and pair."""
    a = np.frombuffer(raw, np.uint8)
    anchors, local = anchors_of(a, ends, length)
    alive = np.zeros(len(anchors), bool)
    if len(anchors):
        keys, right, left = half_hashes(raw, anchors, length)
        for side, on in ((0, right), (1, left)):
            k = keys[side]
            values, n = np.unique(k[on], return_counts=True)
            here = values[n > 1]
            for wanted in (here, known):
                if len(wanted):
                    at = np.minimum(np.searchsorted(wanted, k), len(wanted) - 1)
                    alive |= on & (wanted[at] == k)
    anchors = anchors[alive]
    rows: dict[int, list[tuple[bytes, bytes, int, int, int]]] = {}
    for i, (p, lo, hi, begin, end) in enumerate(anchors.tolist()):
        bucket = xxhash.xxh3_64_intdigest(raw[p:p + GRAM]) % buckets
        rows.setdefault(bucket, []).append((raw[p:min(p + length, end)], raw[max(begin, p + GRAM - length):p + GRAM][::-1], lo, hi, i))
    bucket_of, pair_of = np.zeros(len(anchors), np.int64), np.zeros(len(anchors), np.int64)
    for bucket, own in rows.items():
        rights, lefts = sorted({x[0] for x in own}), sorted({x[1] for x in own})
        rn, ln = {x: i for i, x in enumerate(rights)}, {x: i for i, x in enumerate(lefts)}
        pairs: dict[tuple[int, int], list[int]] = {}
        for r, x, lo, hi, i in own:
            pair = pairs.setdefault((rn[r], ln[x]), [len(pairs), lo, hi, 0])
            pair[1], pair[2], pair[3] = min(pair[1], lo), max(pair[2], hi), pair[3] + 1
            bucket_of[i], pair_of[i] = bucket, pair[0]
        yield bucket, _pack((front_code(rights), front_code(lefts), _ints([(*k, *v[1:]) for k, v in pairs.items()])))
    yield -1, _pack((_ints(anchors[:, 0]), _ints(bucket_of), _ints(pair_of), _ints(local)))


def merge_bucket(runs: list[bytes], length: int) -> list[bytes]:
    """The answer for each run: rows of (pair, first offset, last offset)."""
    parts = [_unpack(r) for r in runs]
    table = [np.frombuffer(p[2], np.int64).reshape(-1, 5) for p in parts]
    sides = []
    for side in (0, 1):
        streams = [front_decode(*p[side]) for p in parts]
        weights = [np.bincount(t[:, side], weights=t[:, 4], minlength=len(s[1])).astype(int).tolist() for t, s in zip(table, streams)]
        sides.append(Classes(streams, weights))
    right, left = sides
    named = [[(right.leaf[k][r], left.leaf[k][x], lo, hi) for r, x, lo, hi, _ in t.tolist()] for k, t in enumerate(table)]
    pairs: Counter = Counter()
    for names, t in zip(named, table):
        for name, n in zip(names, t[:, 4].tolist()):
            pairs[name] += n
    found = common_windows(right, left, pairs, length)
    return [_ints([(i, *span) for i, name in enumerate(names) for span in found.get(name, ())]) for names in named]


def cut_block(raw: bytes, ends: np.ndarray, own: bytes, answers: list[tuple[int, bytes]], length: int) -> np.ndarray:
    """Which bytes of the block go."""
    p, bucket_of, pair_of, local = (np.frombuffer(x, np.int64) for x in _unpack(own))
    edge = np.zeros(len(raw) + 1, np.int32)

    def mark(first, last):  # windows first..last
        np.add.at(edge, first, 1)
        np.add.at(edge, last + length, -1)

    local = local.reshape(-1, 2)
    mark(local[:, 0], local[:, 1])
    order = np.lexsort((pair_of, bucket_of))
    names = np.stack((bucket_of[order], pair_of[order]), axis=1)
    for bucket, answer in answers:
        rows = np.frombuffer(answer, np.int64).reshape(-1, 3)
        lo, hi = np.searchsorted(names[:, 0], [bucket, bucket + 1])
        first = lo + np.searchsorted(names[lo:hi, 1], rows[:, 0])
        last = lo + np.searchsorted(names[lo:hi, 1], rows[:, 0], side="right")
        n = last - first
        which = np.repeat(np.arange(len(rows)), n)
        at = p[order[np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]] if n.sum() else np.zeros(0, np.int64)
        mark(at - rows[which, 2], at - rows[which, 1])
    return np.cumsum(edge, dtype=np.int32)[:-1] > 0


def cut_passages(raw: bytes, ends: np.ndarray, known: np.ndarray, words: int) -> np.ndarray:
    """Which bytes of the block go because a passage of so many words occurs again."""
    p = Passages(np.frombuffer(raw, np.uint8), ends, words)
    on = _again(p.key, known) if len(p.key) else np.zeros(0, bool)
    edge = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edge, p.first[on], 1)
    np.add.at(edge, p.end[on], -1)
    return np.cumsum(edge, dtype=np.int32)[:-1] > 0


# --- the job ------------------------------------------------------------------------------------
def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    rest = [docs[c] for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("suffixes")
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        texts, rows, size = [], [], 0

        def out():
            nonlocal texts, rows, size, number
            raw = b"".join(texts)
            sink = pa.BufferOutputStream()
            whole = pa.Table.from_batches(rows)
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(whole)
            batch = pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([zstandard.ZstdCompressor(level=3).compress(raw)], pa.binary()),
                 pa.array([_ints(np.cumsum([len(t) for t in texts]))], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                ["block", "raw", "ends", "rest"])
            texts, rows, size, number = [], [], 0, number + 1
            return batch

        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                t = (t or "").encode("utf-8", "replace")
                if size and size + len(t) > block_bytes:
                    yield out()
                texts.append(t)
                rows.append(b.select([0]).slice(i, 1))
                size += len(t)
        if texts:
            yield out()

    return docs.select(F.struct(*rest).alias("row"), docs["text"].cast("string").alias("text")).mapInArrow(
        run, "block long, raw binary, ends binary, rest binary")


def _open(raw, ends) -> tuple[bytes, np.ndarray]:
    return zstandard.ZstdDecompressor().decompress(raw), np.frombuffer(ends, np.int64)


def _known(keys: DataFrame) -> DataFrame:
    """keys: key, block (each pair once). Returns of, known: the keys that a block shares with others, one row per
    block."""

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            key, block = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key, kind="stable")
            key, block = key[order], block[order]
            same = key[1:] == key[:-1]
            on = np.concatenate((same, [False])) | np.concatenate(([False], same))
            yield pa.RecordBatch.from_arrays([pa.array(key[on]), pa.array(block[on])], ["key", "block"])

    return (keys.repartition("key").mapInArrow(common, "key long, block long")
            .groupBy(F.col("block").alias("of")).agg(F.sort_array(F.collect_list("key")).alias("known")))


def _shared_keys(blocks: DataFrame, length: int, words: int | None) -> DataFrame:
    """of, known: the half hashes that the block shares with others, one row per block."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("suffixes")
        for b in batches:
            for block, raw, ends in zip(*(c.to_pylist() for c in b.columns)):
                raw, ends = _open(raw, ends)
                a = np.frombuffer(raw, np.uint8)
                anchors, _ = anchors_of(a, ends, length)
                keys = [Passages(a, ends, words).half_key] if words else []
                if len(anchors):
                    k, right, left = half_hashes(raw, anchors, length)
                    keys += [k[0, right], k[1, left]]
                one = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]))
                if len(one):
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(np.full(len(one), block))], ["key", "block"])

    return _known(blocks.select("block", "raw", "ends").mapInArrow(hashes, "key long, block long"))


def remove_repeats(docs: DataFrame, length: int = 400, block_bytes: int = BLOCK_BYTES, words: int | None = None) -> DataFrame:
    """words: passages of so many words (runs of other bytes than ASCII white space) that occur again go too, however
    few bytes they have."""
    spark = docs.sparkSession
    if length < 4 * GRAM:
        raise ValueError(f"length must be {4 * GRAM} or more")
    if words is not None and words < 4 * WORD_GRAM:
        raise ValueError(f"words must be {4 * WORD_GRAM} or more")
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    here = fresh_path(spark, "suffixes")
    made = _blocks(docs, block_bytes)
    made.write.option("compression", "none").parquet(f"{here}/blocks")
    blocks = spark.read.schema(made.schema).parquet(f"{here}/blocks")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("suffixes")
        for b in batches:
            for block, raw, ends, known in zip(*(c.to_pylist() for c in b.columns)):
                raw, ends = _open(raw, ends)
                known = np.array(known or [], np.int64)
                made = list(runs_of_block(raw, ends, known, length, buckets))
                if words:
                    p = Passages(np.frombuffer(raw, np.uint8), ends, words)
                    made.append((-2, _ints(np.unique(p.key[p.candidates(known)]))))
                for bucket, data in made:
                    yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([block]), pa.array([data], pa.binary())], ["bucket", "block", "data"])

    keyed = blocks.join(_shared_keys(blocks, length, words), F.col("block") == F.col("of"), "left").select("block", "raw", "ends", "known")
    sent = keyed.mapInArrow(runs, "bucket long, block long, data binary")
    sent.write.option("compression", "none").parquet(f"{here}/runs")
    sent = spark.read.schema(sent.schema).parquet(f"{here}/runs")

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        answers = merge_bucket(rows["data"].tolist(), length)
        return pd.DataFrame({"block": rows["block"], "bucket": key[0], "answer": answers})

    answers = sent.filter("bucket >= 0").groupBy("bucket").applyInPandas(merge, "block long, bucket long, answer binary")
    answers = answers.filter(F.length("answer") > 0).groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))
    own = sent.filter("bucket = -1").select(F.col("block").alias("own_of"), F.col("data").alias("own"))
    ready = blocks.join(own, F.col("block") == F.col("own_of")).join(answers, F.col("block") == F.col("of"), "left")
    if words:
        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block, data in zip(*(c.to_pylist() for c in b.columns)):
                    keys = np.frombuffer(data, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), block))], ["key", "block"])

        passages = _known(sent.filter("bucket = -2").select("block", "data").mapInArrow(listed, "key long, block long"))
        ready = ready.join(passages.select(F.col("of").alias("passages_of"), F.col("known").alias("passages")),
                           F.col("block") == F.col("passages_of"), "left")
    else:
        ready = ready.withColumn("passages", F.array().cast("array<long>"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, ends, rest, own, answers, passages in zip(*(c.to_pylist() for c in b.columns)):
                raw, ends = _open(raw, ends)
                gone = cut_block(raw, ends, own, [(x["bucket"], x["answer"]) for x in answers or []], length)
                if words:
                    gone |= cut_passages(raw, ends, np.array(passages or [], np.int64), words)
                yield from _texts(raw, ends, rest, gone)

    schema = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row")).withColumns(
        {"n_bytes": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "starts": F.array().cast("array<long>"),
         "ends": F.array().cast("array<long>"), "kept": F.lit(b""), "text": F.lit("")}).schema
    return ready.select("raw", "ends", "rest", "own", "answers", "passages").mapInArrow(cut, schema)


def _texts(raw: bytes, ends: np.ndarray, rest: bytes, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
    table = pa.ipc.open_stream(rest).read_all().combine_chunks()
    a, begin, cols = np.frombuffer(raw, np.uint8), 0, [[] for _ in range(6)]
    for i, end in enumerate(ends.tolist()):
        mine, out = a[begin:end], gone[begin:end]
        first, last = _runs(out) if out.any() else (np.zeros(0, int),) * 2
        kept = mine[~out].tobytes() if len(first) else raw[begin:end]
        text = kept
        if len(first):
            char = np.cumsum((mine & 0xC0) != 0x80) - 1
            char = np.maximum(char, 0)
            text = mine[(np.bincount(char, weights=~out) > 0)[char]].tobytes()
        for col, v in zip(cols, (end - begin, int(out.sum()), first.tolist(), (last + 1).tolist(), kept, text.decode("utf-8", "replace"))):
            col.append(v)
        begin = end
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.string()]
    rows = table.column(0).chunk(0) if table.column(0).num_chunks else pa.array([], table.schema.field(0).type)
    for at in range(0, len(rows), 512):
        yield pa.RecordBatch.from_arrays([rows.slice(at, 512), *(pa.array(c[at:at + 512], k) for c, k in zip(cols, kinds))],
                                         ["row", "n_bytes", "n_removed", "starts", "ends", "kept", "text"])

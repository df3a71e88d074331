"""Hierarchical multi-length packing of token ids into sequences.

Each document's ids, ended by an end id, give whole windows of the longest size first. What is left is routed to the
shortest context size that holds it, and each tier packs windows of its own, in turn: a window starts with a piece of its
tier, takes more of these while they fit, then up to MAX_FILL longest pieces of shorter tiers that fit its gap, and at last
a piece cut to measure, whose rest is routed again. So windows are full; only the last few ids of a task (fewer than the
shortest size) form a padded one. Windows of all sizes join step groups of equal token counts. Each task packs its own
documents, so nothing is shuffled, and the state of a task is a bounded pool.

Input: doc_id, text (null: empty, one end id). Repeated rows are packed again; a null doc_id is kept. An empty table
gives no rows. Output: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id,
offset, window (its size; padded up to the longest), step_group. Ids of sequences and groups hold the task's number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .chunks import KEPT_CHUNKS
from .common import hold, id_and_text
from .tokens import library_encoder

TIERS = (256, 512, 1024, 2048)
GROUP_TOKENS = 16 * 2048
# Ids held back so that the pools keep a mix of lengths
POOL_TOKENS = 1 << 18
# Pieces of shorter tiers in the gap of one window, so that long windows do not use these up
MAX_FILL = 4

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
          "window long, step_group long")


class StepGroups:
    """A window joins the open group that it leaves with the least room, else a new one; full groups close. Sizes are
    powers of two, so groups end equal, but for the last few of a task."""

    def __init__(self, first: int, tokens: int = GROUP_TOKENS):
        self.next, self.tokens = first, tokens
        self.open: dict[int, int] = {}

    def place(self, size: int) -> int:
        fit = [(room, g) for g, room in self.open.items() if room >= size]
        if not fit:
            fit = [(self.tokens, self.next)]
            self.next += 1
        room, g = min(fit)
        self.open[g] = room - size
        if room == size:
            del self.open[g]
        return g


class Packer:
    """A piece is [doc_id, start, ids, doc_tokens]. add() and finish() fill `out`, a list of rows."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS, group_tokens: int = GROUP_TOKENS):
        self.tiers = tiers
        self.pools: dict[int, list[list]] = {t: [] for t in tiers}
        self.tokens = 0
        self.sequence = task << 32
        self.groups = StepGroups(task << 32, group_tokens)
        self.out: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n, top, at = len(ids) // 4, self.tiers[-1], 0
        while n - at >= top:
            self._emit([[doc_id, at, ids[4 * at:4 * (at + top)], n]], top)
            at += top
        if at < n:
            self._route([doc_id, at, ids[4 * at:], n])

    def pack(self, keep: int) -> None:
        """Windows of each tier in turn, longest first, until no more than `keep` ids are left."""
        while self.tokens > keep:
            before = self.tokens
            for size in reversed(self.tiers):
                if self.pools[size] and self.tokens >= size:
                    self._window(size)
            if self.tokens == before:
                return

    def finish(self) -> None:
        self.pack(0)
        while self.tokens:  # fewer ids than the tier of the longest piece has room for: it is cut
            self._window(max((t for t in self.tiers if t <= self.tokens), default=self.tokens))

    def _tier(self, n: int) -> int:
        return next(t for t in self.tiers if n <= t)

    def _route(self, piece: list) -> None:
        n = len(piece[2]) // 4
        self.pools[self._tier(n)].append(piece)
        self.tokens += n

    def _fitting(self, room: int, size: int) -> list | None:
        """The next piece of at most `room` ids, of the longest tier that has one at hand, up to that of `size`."""
        for t in reversed(self.tiers):
            pool = self.pools[t]
            if t <= size and pool and len(pool[-1][2]) // 4 <= room:
                self.tokens -= len(pool[-1][2]) // 4
                return pool.pop()
        return None

    def _cut(self, room: int) -> list:
        """`room` ids off a piece of the shortest tier that holds more; its rest is routed again."""
        pool = next(p for p in self.pools.values() if p and len(p[-1][2]) // 4 >= room)
        doc_id, start, ids, n = pool.pop()
        self.tokens -= len(ids) // 4
        if len(ids) // 4 > room:
            self._route([doc_id, start + room, ids[4 * room:], n])
        return [doc_id, start, ids[:4 * room], n]

    def _window(self, size: int) -> None:
        pieces, room, filled = [], size, 0
        while room:
            piece = self._fitting(room, max(size, self.tiers[0]))
            if piece is not None and filled >= MAX_FILL and any(len(p[-1][2]) // 4 >= room for p in self.pools.values() if p):
                back, piece = piece, self._cut(room)
                self._route(back)
            elif piece is None:
                piece = self._cut(room)
            n = len(piece[2]) // 4
            filled += self._tier(n) < size
            room -= n
            pieces.append(piece)
        self._emit(pieces, size if size in self.tiers else self.tiers[-1])

    def _emit(self, pieces: list[list], size: int) -> None:
        group, at = self.groups.place(size), 0
        for doc_id, start, ids, n in pieces:
            length = len(ids) // 4
            self.out.append((doc_id, start, length, ids, n, self.sequence, at, size, group))
            at += length
        self.sequence += 1


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS,
         group_tokens: int = GROUP_TOKENS, kept_chunks: int = KEPT_CHUNKS) -> DataFrame:
    """The pieces of all sequences. tiers: powers of two, ascending; group_tokens: a multiple of the longest; kept_chunks:
    how many chunks a worker keeps the ids of, which costs memory and spares time."""
    tail = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("tokens", library_encoder.cache_clear)
        encoder = library_encoder(tokenizer_path, kept_chunks)
        context = TaskContext.get()
        packer = Packer(context.partitionId() if context else 0, tiers, group_tokens)

        def rows():
            done, packer.out = packer.out, []
            cols = list(zip(*done))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()] + [pa.int64()] * 5
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist())):
                packer.add(doc_id, ids + tail)
            packer.pack(POOL_TOKENS)
            if packer.out:
                yield rows()
        packer.finish()
        if packer.out:
            yield rows()

    return id_and_text(docs).mapInArrow(run, SCHEMA)

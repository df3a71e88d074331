"""Texts cut where a byte-level tokenizer always cuts: before a single space between two other characters.

The pattern of byte-level BPE never joins a character to a space on its right, and a single space goes with the
characters after it, so such a chunk (the space and all up to the next one) has the same ids wherever it stands.
Ids of chunks are kept as bytes (little-endian unsigned 32-bit) in a bounded table of the worker; a text is then one
join. Texts that hold a space beside other white space are given whole to the encoder.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator, Sequence

# Unicode's White_Space, which is what the pattern's \s stands for
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BESIDE = re.compile(f" [{WHITE}]|[{WHITE}] ")
RARE = re.compile(f"[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def space_beside_white(text: str) -> bool:
    return "  " in text or " \n" in text or "\n " in text or bool(RARE.search(text) and BESIDE.search(text))


# Chunks kept by a worker: a full table is set aside, and what is used again moves to the new one
KEPT_CHUNKS = 600_000
# Longer chunks are encoded but not kept
KEPT_CHARS = 64


def _unknown(ids: list[bytes | None]) -> Iterator[int]:
    """Places of None, which are few. The list may be filled on the way."""
    k, n = -1, ids.count(None)
    for _ in range(n):
        k = ids.index(None, k + 1)
        yield k


class ChunkEncoder:
    """encode(texts) gives the ids of each text as bytes. `encode_all` encodes a list of strings to such bytes."""

    def __init__(self, encode_all: Callable[[list[str]], list[bytes]], kept: int = KEPT_CHUNKS):
        self.encode_all, self.kept = encode_all, kept
        self.after: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()  # what is made here is kept or has no cycles; going through it again and again finds nothing
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: Sequence[str | None]) -> list[bytes]:
        if len(self.after) > self.kept:
            self.before, self.after = self.after, {}
        get, older = self.after.get, self.before.get
        out: list[bytes] = []
        late: list[tuple[int, str, list[tuple[int, str]], list[bytes | None]]] = []
        new: dict[str, bytes] = {}
        whole: dict[str, bytes] = {}
        for i, text in enumerate(texts):
            if not text:
                out.append(b"")
            elif space_beside_white(text):
                whole[text] = b""
                late.append((i, text, [], []))
                out.append(b"")
            else:
                head, *parts = text.split(" ")
                ids = list(map(get, parts))
                if head:
                    whole[head] = b""
                gaps = []
                for k in _unknown(ids):
                    p = parts[k]
                    x = ids[k] = older(p)
                    if x is None:
                        new[p] = b""
                        gaps.append(k)
                    else:
                        self.after[p] = x
                late.append((i, head, [(k, parts[k]) for k in gaps], ids))
                out.append(b"")
        got = self.encode_all([" " + p for p in new] + list(whole))
        new = dict(zip(new, got))
        whole = dict(zip(whole, got[len(new):]))
        self.after.update((k, v) for k, v in new.items() if len(k) <= KEPT_CHARS)
        for i, head, gaps, ids in late:
            for k, p in gaps:
                ids[k] = new[p]
            out[i] = whole.get(head, b"") + b"".join(ids)
        return out

"""Token ids by the tokenizers library, for new chunks only.

Most chunks are letters, digits, ASCII punctuation and single line ends. Where the pattern of byte-level BPE cuts such a
chunk is plain, so its pieces go to the library's model at once and each piece is looked up before. All others go
through the library's own pattern, in batches.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from .chunks import KEPT_CHARS, KEPT_CHUNKS, WHITE, ChunkEncoder

INNER = re.compile(f" [^{WHITE}]+")
LINES_AT_ONCE = 1024
# Letters of the Latin blocks up to U+024F: letters in every version of Unicode
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
# ASCII punctuation without the apostrophe, which may begin a contraction
MARKS = "!-&(-/:-@\\[-`{-~"
PLAIN = re.compile(f"(?: (?!\\n))?(?:[{LATIN}0-9{MARKS}]|\n(?!\n))+")
PIECES = re.compile(f" ?[{LATIN}]+| ?[0-9]+| ?[{MARKS}]+|\n")
KEPT_PIECES = 200_000
PROBE = "Ab12.,x\nÀé(;<|y|>"


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes: visible ones for themselves, the others counted on from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def piecewise(t) -> object:
    """Ids of one piece by the model of a tokenizer, or None if more than the usual pattern cuts its texts."""
    from tokenizers import models, pre_tokenizers

    letters, tokenize = byte_letters(), t.model.tokenize

    def encode(piece: str) -> bytes:
        tokens = tokenize(piece.encode("utf-8").decode("latin-1").translate(letters))
        return b"".join([x.id.to_bytes(4, "little") for x in tokens])

    if (not isinstance(t.model, models.BPE) or not isinstance(t.pre_tokenizer, pre_tokenizers.ByteLevel) or t.normalizer
            or not all(x.special for x in t.get_added_tokens_decoder().values())):
        return None
    for probe in (PROBE, " " + PROBE):
        ids = np.array(t.encode(probe, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if b"".join(map(encode, PIECES.findall(probe))) != ids:
            return None
    return encode


@lru_cache(maxsize=4)
def library_encoder(path: str, kept: int = KEPT_CHUNKS) -> ChunkEncoder:
    """One per worker process and file, with a table of `kept` chunks. Strings of special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    encode_piece = piecewise(t)
    known: dict[str, bytes] = {}

    def of_pieces(text: str) -> bytes:
        out = []
        for p in PIECES.findall(text):
            ids = known.get(p)
            if ids is None:
                ids = encode_piece(p)
                if len(p) <= KEPT_CHARS:
                    known[p] = ids
            out.append(ids)
        return b"".join(out)

    def encode_all(texts: list[str]) -> list[bytes]:
        if len(known) > min(KEPT_PIECES, kept):
            known.clear()
        if encode_piece is None:
            return by_library(texts)
        plain = PLAIN.fullmatch
        out = [of_pieces(x) if plain(x) else None for x in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, by_library([texts[i] for i in rest])):
            out[i] = ids
        return out

    def by_library(texts: list[str]) -> list[bytes]:
        """Short chunks without white space but their first space go to the library as lines of one text: the line
        end is a piece of its own, and its id tells where a chunk ends."""
        lines = [i for i, x in enumerate(texts) if x[:1] == " " and len(x) <= KEPT_CHARS and INNER.fullmatch(x)]
        out: list[bytes | None] = [None] * len(texts)
        for at in range(0, len(lines), LINES_AT_ONCE):
            part = lines[at:at + LINES_AT_ONCE]
            ids = t.encode_batch_fast(["\n".join([texts[i] for i in part])], add_special_tokens=False)[0].ids
            ids = np.array(ids, dtype="<u4")
            ends = np.flatnonzero(ids == line_end).tolist() + [len(ids)]
            if len(ends) != len(part):
                raise ValueError("a line end is no piece of its own in this tokenizer")
            raw, begin = ids.tobytes(), 0
            for i, end in zip(part, ends):
                out[i] = raw[4 * begin:4 * end]
                begin = end + 1
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            for i, e in zip(rest, t.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
                out[i] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    line_end = t.encode("\n", add_special_tokens=False).ids
    if len(line_end) != 1:
        raise ValueError("the tokenizer splits a line end")
    line_end = line_end[0]
    return ChunkEncoder(encode_all, kept)

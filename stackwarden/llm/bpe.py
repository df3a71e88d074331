"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by an incremental UTF-8 state machine.

Encoding. Ids of a prefix end in one last token; two tokens may stand side by side exactly if the merges, applied to
both alone, leave them. So the last token after a byte is the longest token ending there that agrees with the last
token before it. A state holds what later bytes can still need: the pending bytes (the longest suffix that starts some
token), and the last tokens at places where a token may yet start. Tokens that all those places share are emitted at
once, so the lookahead is bounded by the longest token. States and moves are kept in a bounded table and made when met
a second time: where a short piece leaves the moves there are, its last tokens are noted byte by byte instead, since most
ends of rare words come once. A piece that is itself a token is that token, as in the published encoder.

Decoding. A state machine over byte classes reads the bytes of one token after another and emits whole characters; its
state is the bytes of a character begun. Moves of whole tokens are made when first met and kept in a bounded table. Bytes
that are no UTF-8 are carried through as lone surrogates, so the emitted characters give back the exact bytes; in texts
each maximal part of no character becomes U+FFFD. `bytes` holds what the machine emitted.

Input: doc_id, text (null: empty). Output of encode: doc_id, ids (binary, little-endian unsigned 32-bit) and n_tokens;
of decode: doc_id, text, bytes. Rows are independent: repeated rows and null ids come back as they are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import KEPT_CHARS, WHITE, ChunkEncoder
from .common import hold, id_and_text, over_batches

KEPT_STATES = 150_000
KEPT_CHUNKS = 400_000
KEPT_PIECES = 150_000
KEPT_MOVES = 100_000
# Bytes of a piece whose last tokens are noted at once; longer pieces take moves all the way
NOTED_BYTES = 256
BLOCK_TOKENS = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class State:
    __slots__ = ("pending", "places", "moves", "final")

    def __init__(self, pending: bytes, places: tuple, final: bytes):
        # places: (bytes back from here, last token there or -1), oldest first; the first is the root
        self.pending, self.places, self.final = pending, places, final
        # None: met once, not made yet
        self.moves: dict[int, tuple[bytes, State] | None] = {}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], kept: int = KEPT_STATES):
        self.ranks, self.kept = ranks, kept
        self.token = {v: k for k, v in ranks.items()}
        self.starts = {t[:i] for t in ranks for i in range(1, len(t))}
        self.agrees: dict[int, bool] = {}  # by first token * many + second
        self.many = 1 + max(ranks.values())
        self.stable: dict[int, bool] = {}
        self.packed = {v: v.to_bytes(4, "little") for v in ranks.values()}
        self._reset()

    def _reset(self) -> None:
        self.start = State(b"", ((0, -1),), b"")
        self.reads: dict[bytes, dict[int, tuple[list, bytes, list, dict]]] = {b"": {}}
        self.states = {(self.start.pending, self.start.places): self.start}

    def merge(self, piece: bytes) -> list[int]:
        """The merges carried out literally; used for pairs of tokens only."""
        get, none = self.ranks.get, 1 << 40
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pairs = [get(piece[i:i + 2], none) for i in range(len(piece) - 1)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            at = pairs.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def agree(self, a: int, b: int) -> bool:
        key = a * self.many + b
        known = self.agrees.get(key)
        if known is None:
            if len(self.agrees) > 4 * self.kept:
                self.agrees.clear()
            known = self.agrees[key] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return known

    def lasting(self, t: int) -> bool:
        known = self.stable.get(t)
        if known is None:
            known = self.stable[t] = self.merge(self.token[t]) == [t]
        return known

    def _read(self, pending: bytes, byte: int) -> tuple[list, bytes, list, dict]:
        """Of a byte after pending bytes: tokens that end with it (longest first), what is pending now, how far back a
        token may have begun that still goes on, and what is known to be read after."""
        known = self.reads.setdefault(pending, {}).get(byte)
        if known is None:
            if len(self.reads) > self.kept:
                self.reads = {b"": {}}
            read = pending + bytes((byte,))
            tails = [read[i:] for i in range(len(read))]
            ends = [(self.ranks[x], len(x)) for x in tails if x in self.ranks and self.lasting(self.ranks[x])]
            alive = [len(x) for x in tails if x in self.starts]
            after = read[len(read) - alive[0]:] if alive else b""
            known = ends, after, alive, self.reads.setdefault(after, {})
            self.reads.setdefault(pending, {})[byte] = known
        return known

    def _move(self, state: State, byte: int) -> tuple[bytes, State]:
        last = {back + 1: t for back, t in state.places}
        root = state.places[0][0] + 1
        ends, pending, alive, _ = self._read(state.pending, byte)
        agrees, many = self.agrees, self.many
        for t, back in ends:
            before = last.get(back)
            if before is not None:
                if before < 0:
                    break
                known = agrees.get(before * many + t)
                if known or known is None and self.agree(before, t):
                    break
        else:
            raise ValueError("the ranks lack a single byte")
        last[0] = t
        token = self.token
        # places where a token that is still to come may start, and all that lie on the way to them
        shared: list[int] | None = None
        keep = {0}
        for n in [0] + [n for n in alive if n in last]:
            way = []
            while n != root:
                way.append(n)
                n += len(token[last[n]])
            way.reverse()
            keep.update(way)
            if shared is None:
                here = shared = way
            else:
                i = 0
                for x, y in zip(shared, way):
                    if x != y:
                        break
                    i += 1
                if i < len(shared):
                    shared = shared[:i]
        packed = self.packed
        emitted = b"".join([packed[last[n]] for n in shared])
        top = shared[-1] if shared else root
        places = ((top, last[top] if top in alive or top == root and last[root] < 0 else -2),
                  *[(n, last[n]) for n in sorted(keep, reverse=True) if n < top])
        key = (pending, places)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = State(pending, places, b"".join([packed[last[n]] for n in here[len(shared):]]))
        move = state.moves[byte] = emitted, to
        return move

    def _noted(self, piece: bytes) -> bytes:
        """The ids by the last token after every byte, without states."""
        agrees, many, pending, reads = self.agrees.get, self.many, b"", self.reads[b""]
        last, size = [-1], [0]
        for n, byte in enumerate(piece, 1):
            ends, pending, _, reads = reads.get(byte) or self._read(pending, byte)
            for t, back in ends:
                before = last[n - back]
                if before < 0:
                    break
                known = agrees(before * many + t)
                if known or known is None and self.agree(before, t):
                    break
            else:
                raise ValueError("the ranks lack a single byte")
            last.append(t)
            size.append(back)
        out, n, packed = [], len(piece), self.packed
        while n:
            out.append(packed[last[n]])
            n -= size[n]
        out.reverse()
        return b"".join(out)

    def encode(self, piece: bytes) -> bytes:
        whole = self.ranks.get(piece)
        if whole is not None:
            return self.packed[whole]
        if len(self.states) > self.kept:
            self._reset()
        state, out = self.start, []
        short = len(piece) <= NOTED_BYTES
        for byte in piece:
            move = state.moves.get(byte)
            if move is None:
                if short and byte not in state.moves:
                    state.moves[byte] = None
                    return self._noted(piece)
                move = self._move(state, byte)
            emitted, state = move
            if emitted:
                out.append(emitted)
        out.append(state.final)
        return b"".join(out)


# Well-formed UTF-8. The first byte of each class of bytes, and the moves between states by class. State 0
# lies between characters, 1 to 3 await as many more bytes of any kind, the others a second byte of a limited range.
CLASS_FIRST = (0x00, 0x80, 0x90, 0xA0, 0xC0, 0xC2, 0xE0, 0xE1, 0xED, 0xEE, 0xF0, 0xF1, 0xF4, 0xF5)
MOVES = (
    {0x00: 0, 0xC2: 1, 0xE0: 4, 0xE1: 2, 0xED: 5, 0xEE: 2, 0xF0: 6, 0xF1: 3, 0xF4: 7},
    {0x80: 0, 0x90: 0, 0xA0: 0},
    {0x80: 1, 0x90: 1, 0xA0: 1},
    {0x80: 2, 0x90: 2, 0xA0: 2},
    {0xA0: 1},
    {0x80: 1, 0x90: 1},
    {0x90: 2, 0xA0: 2},
    {0x80: 2},
)
BYTE_CLASS = [max(c for c in CLASS_FIRST if c <= b) for b in range(256)]


def character(parts: bytes) -> str:
    point = parts[0] if len(parts) == 1 else parts[0] & (0x7F >> len(parts))
    for b in parts[1:]:
        point = point << 6 | b & 0x3F
    return chr(point)


def read_bytes(begun: bytes, data: bytes) -> tuple[str, str, bytes]:
    """From a state and bytes: the characters with wrong bytes as lone surrogates (U+DC00 + byte), the characters with
    U+FFFD for these, and the new state."""
    state = 0
    for b in begun:
        state = MOVES[state][BYTE_CLASS[b]]
    exact, shown = [], []
    for b in data:
        to = MOVES[state].get(BYTE_CLASS[b])
        if to is None and begun:
            exact += [chr(0xDC00 + x) for x in begun]
            shown.append("\ufffd")
            begun = b""
            to = MOVES[0].get(BYTE_CLASS[b])
        if to is None:
            exact.append(chr(0xDC00 + b))
            shown.append("\ufffd")
            state = 0
            continue
        begun, state = begun + bytes((b,)), to
        if not state:
            exact.append(character(begun))
            shown.append(exact[-1])
            begun = b""
    return "".join(exact), "".join(shown), begun


class Utf8Stream:
    """Feeds of bytes or of tokens become characters; a character begun waits for the next feed."""

    def __init__(self, tokens: TokenMoves | None = None):
        self.begun, self.tokens = b"", tokens

    def feed(self, data: bytes) -> tuple[str, str]:
        exact, shown, self.begun = read_bytes(self.begun, data)
        return exact, shown

    def feed_tokens(self, ids: list[int]) -> tuple[str, str]:
        move = self.tokens.move
        plain = list(map(self.tokens.plain.get, ids))
        if not self.begun and None not in plain:
            text = "".join(plain)
            return text, text
        exact, shown, begun = [], [], self.begun
        for t, text in zip(ids, plain):
            if begun or text is None:
                a, b, begun = move(begun, t)
                exact.append(a)
                shown.append(b)
            else:
                exact.append(text)
                shown.append(text)
        self.begun = begun
        return "".join(exact), "".join(shown)

    def end(self) -> tuple[str, str]:
        rest, self.begun = self.begun, b""
        return "".join([chr(0xDC00 + x) for x in rest]), "\ufffd" if rest else ""


class TokenMoves:
    """Moves of the state machine by whole tokens. `plain` has the characters of tokens that begin and end between
    characters."""

    def __init__(self, token: dict[int, bytes], kept: int = KEPT_MOVES):
        self.token, self.kept = token, kept
        self.plain: dict[int, str] = {}
        self.known: dict[tuple[bytes, int], tuple[str, str, bytes]] = {}

    def move(self, begun: bytes, t: int) -> tuple[str, str, bytes]:
        known = self.known.get((begun, t))
        if known is None:
            if len(self.known) > self.kept:
                self.known.clear()
            known = self.known[begun, t] = read_bytes(begun, self.token[t])
            if not begun and not known[2] and known[0] == known[1]:
                self.plain[t] = known[0]
        return known


def decode_stream(ids: memoryview, tokens: TokenMoves) -> Iterator[tuple[str, str]]:
    """Blocks of exact and of shown characters."""
    stream = Utf8Stream(tokens)
    for at in range(0, len(ids), BLOCK_TOKENS):
        yield stream.feed_tokens(ids[at:at + BLOCK_TOKENS].tolist())
    if stream.begun:
        yield stream.end()


def explicit_white(pattern: str) -> str:
    """The pattern with white space spelt out, since libraries differ on what it holds."""
    return pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"(?!\S)", f"(?=[{WHITE}]|$)").replace(r"\s+", f"[{WHITE}]+")


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ChunkEncoder:
    import regex

    machine, pieces = Transducer(read_ranks(path)), regex.compile(explicit_white(pattern).replace("$)", r"\Z)")).findall
    known: dict[str, bytes] = {}
    older: dict[str, bytes] = {}

    def encode_piece(p: str) -> bytes:
        ids = known.get(p)
        if ids is None:
            ids = older.get(p)
            if ids is None:
                ids = machine.encode(p.encode("utf-8", "surrogatepass"))
            if len(p) <= KEPT_CHARS:
                known[p] = ids
        return ids

    def encode_all(texts: Iterable[str]) -> list[bytes]:
        nonlocal known, older
        if len(known) > KEPT_PIECES:  # what is used again moves to the new table
            known, older = {}, known
        return [b"".join(map(encode_piece, pieces(t))) for t in texts]

    return ChunkEncoder(encode_all, KEPT_CHUNKS)


@lru_cache(maxsize=2)
def token_moves(path: str) -> TokenMoves:
    return TokenMoves({v: k for k, v in read_ranks(path).items()})


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    def make():
        hold("bpe", encoder.cache_clear)
        own = encoder(ranks_path, pattern)

        def apply(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = own.encode(b.column(1).to_pylist())
            return pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())],
                ["doc_id", "ids", "n_tokens"])

        return apply

    return over_batches(id_and_text(docs), make, "doc_id long, ids binary, n_tokens long")


def decode(encoded: DataFrame, ranks_path: str, with_text: bool = True) -> DataFrame:
    """Adds text, if wanted, and bytes to doc_id, ids, n_tokens."""

    def make():
        tokens = token_moves(ranks_path)

        def apply(b: pa.RecordBatch) -> pa.RecordBatch:
            texts, raw = [], []
            for ids in b.column(1).to_pylist():
                blocks = list(decode_stream(memoryview(ids or b"").cast("I"), tokens))
                raw.append("".join([x for x, _ in blocks]).encode("utf-8", "surrogateescape"))
                if with_text:
                    texts.append("".join([x for _, x in blocks]))
            made = {"text": pa.array(texts, pa.string())} if with_text else {}
            made["bytes"] = pa.array(raw, pa.binary())
            return pa.RecordBatch.from_arrays([*b.columns[:3], *made.values()], ["doc_id", "ids", "n_tokens", *made])

        return apply

    return over_batches(encoded.select("doc_id", "ids", "n_tokens"), make,
                        f"doc_id long, ids binary, n_tokens long, {'text string, ' if with_text else ''}bytes binary")

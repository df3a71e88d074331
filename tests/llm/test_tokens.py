"""Encoders, packing and token files against the published libraries."""

import array
import hashlib
import random
import zlib
from collections import defaultdict

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from stackwarden.llm import bpe, packing, tokenfiles, tokens  # noqa: E402
from stackwarden.llm.chunks import ChunkEncoder  # noqa: E402
from stackwarden.llm.queries import op3_bpe, op9_packing, op10_token_files  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "aaabbcd  e\n\t's't'll're 12é ñü漢字🙂　\x85\x1c\xa0-_.,#\r\x00th the in ing"


def odd_texts(n=1500):
    rnd = random.Random(7)
    out = ["", " ", "  ", "\n", " a", "a ", "a  b", "a \nb", "a\n b", "x" * 5000, "ab " * 3000, "<|endoftext|> a<|endoftext|>"]
    out += ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return out + ["".join(chr(rnd.randint(1, 0x2FFF)) for _ in range(rnd.randint(0, 30))) for _ in range(300)]


@pytest.fixture(scope="module")
def published():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


def test_transducer_equals_the_published_encoder(published):
    own = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    texts = odd_texts()
    assert own.encode(texts) == [array.array("I", published.encode_ordinary(t)).tobytes() for t in texts]
    assert own.encode([None, ""]) == [b"", b""]


def test_small_tables_of_states_and_chunks_change_nothing(published):
    machine = bpe.Transducer(bpe.read_ranks(RANKS), kept=50)
    small = ChunkEncoder(lambda xs: [array.array("I", published.encode_ordinary(x)).tobytes() for x in xs], kept=3)
    for t in odd_texts(200):
        piece = t.replace(" ", "x").encode()[:80]
        assert machine.encode(piece) == array.array("I", published._core_bpe.encode_single_piece(piece)).tobytes() if piece else True
        assert small.encode([t])[0] == array.array("I", published.encode_ordinary(t)).tobytes()


def fed(raws):
    stream = bpe.Utf8Stream()
    out = [stream.feed(x) for x in raws] + [stream.end()]
    return "".join(a for a, _ in out).encode("utf-8", "surrogateescape"), "".join(b for _, b in out)


def test_decoding_in_feeds_of_any_size():
    raw = ("aé漢🙂\u07ff\u0800\ud7ff\ue000\uffff\U0010ffff" * 20).encode()
    for size in range(1, 9):
        assert fed(raw[i:i + size] for i in range(0, len(raw), size)) == (raw, raw.decode())


def test_decoding_wrong_bytes_equals_plain_decoding_at_every_cut():
    rnd = random.Random(2)
    bounds = [0, 0x41, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC1, 0xC2, 0xDF, 0xE0, 0xE1, 0xEC, 0xED, 0xEE, 0xEF, 0xF0, 0xF1,
              0xF3, 0xF4, 0xF5, 0xFF]
    raws = [bytes(rnd.choice(bounds) for _ in range(rnd.randint(1, 12))) for _ in range(3000)]
    raws += [bytes((a, b, c)) for a in bounds for b in bounds for c in bounds]
    for raw in raws:
        for cut in range(len(raw)):
            assert fed((raw[:cut], raw[cut:])) == (raw, raw.decode("utf-8", "replace")), raw


def test_decoding_by_tokens_that_cut_characters(spark):
    rnd = random.Random(4)
    ranks = bpe.read_ranks(RANKS)
    high = [t for k, t in ranks.items() if max(k) > 0x7F and len(k) < 4]
    bytes_of = {t: k for k, t in ranks.items()}
    rows = [[ranks[bytes((b,))] for b in "漢🙂é".encode()] * 1400, []]  # more than a block
    rows += [[rnd.choice(high) if rnd.random() < 0.7 else rnd.randrange(len(ranks)) for _ in range(rnd.randint(1, 30))] for _ in range(500)]
    df = spark.createDataFrame([(i, bytearray(array.array("I", x).tobytes()), len(x)) for i, x in enumerate(rows)],
                               "doc_id long, ids binary, n_tokens long")
    got = bpe.decode(df, RANKS).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = b"".join(bytes_of[t] for t in rows[r.doc_id])
        assert (bytes(r.bytes), r.text) == (raw, raw.decode("utf-8", "replace"))


def test_library_chunks_equal_whole_texts(library):
    texts = odd_texts()
    assert tokens.library_encoder(JSON).encode(texts) == [
        array.array("I", e.ids).tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def write(spark, tmp_path, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def some_rows():
    rnd = random.Random(3)
    texts = odd_texts(150) + [None, "same text", "same text", " ".join(rnd.choice(["the", "of", "xyzzy"]) for _ in range(9000))]
    return [(i * 3, t, "en", "s", 0) for i, t in enumerate(texts)]


def test_op3(spark, tmp_path, published):
    rows = some_rows()
    got = {r.doc_id: r for r in op3_bpe(spark, write(spark, tmp_path, rows)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        ids = published.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_op9_covers_each_id_once_and_fills_windows(spark, tmp_path, library):
    rows = some_rows() * 3
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = op9_packing(spark, write(spark, tmp_path, rows)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == {r[0] for r in rows}
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(array.array("I", ids[at:at + r.length]).tobytes())
            at += r.length
        assert at == len(ids)
    padded = 0
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        at = 0
        for r in s:
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padded += at & (at - 1) > 0
    assert padded <= 8


@pytest.mark.parametrize("tokenizer", [JSON])
def test_plain_chunks_are_cut_as_the_library_cuts(tokenizer, library):
    rnd = random.Random(1)
    letters = "ab Zé'sÉ12.,\n\n(<|>_`~^\\[]{}\"-ßĀɏɐ×÷ª\xa0\t"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25))) for _ in range(5000)]
    assert tokens.piecewise(library) is not None
    assert tokens.library_encoder(tokenizer).encode(texts) == [
        array.array("I", e.ids).tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def packed(sizes, keep=1 << 15):
    p = packing.Packer(0)
    for i, n in enumerate(sizes):
        p.add(i, bytes(4 * n))
        if i % 64 == 0:
            p.pack(keep)
    p.finish()
    return p.out


def test_each_tier_packs_windows_of_its_own():
    rnd = random.Random(5)
    sizes = [min(20000, int(rnd.lognormvariate(6, 1.2)) + 1) for _ in range(4000)]
    out = packed(sizes)
    length, window, pieces = defaultdict(int), {}, defaultdict(list)
    for doc, start, n, ids, _, seq, at, size, group in out:
        assert n == len(ids) // 4 and at == length[seq]
        length[seq] += n
        window[seq] = (size, group)
        pieces[doc].append((start, n))
    for doc, n in enumerate(sizes):
        at = 0
        for start, k in sorted(pieces[doc]):
            assert start == at
            at += k
        assert at == n
    share = defaultdict(int)
    for size, _ in window.values():
        share[size] += 1
    assert all(share[t] > len(window) / 50 for t in packing.TIERS)
    assert sum(s - length[q] for q, (s, _) in window.items()) < 0.001 * sum(sizes) + 2048
    load = defaultdict(set)
    for size, group in window.values():
        load[group].add(size)
    assert sum(len(x) > 1 for x in load.values()) > len(load) / 2


def test_few_ids_give_one_padded_window_at_most():
    rnd = random.Random(5)
    mixed = [[rnd.choice([1, 3, 20, rnd.randint(1, 300), rnd.randint(1, 3000)]) for _ in range(rnd.randint(1, 60))] for _ in range(300)]
    for sizes in (*mixed, [1], [255], [256], [10] * 10, [257], [1500], [2047], [2048], [2049], [300, 300, 5], [1] * 700, [2000] * 3):
        length, window = defaultdict(int), {}
        for _, _, n, _, _, seq, _, size, _ in packed(sizes):
            length[seq] += n
            window[seq] = size
        assert sum(length.values()) == sum(sizes)
        assert sum(length[q] < s for q, s in window.items()) <= 1


def test_step_groups_are_equal():
    g = packing.StepGroups(0, 4096)
    rnd = random.Random(1)
    load = defaultdict(int)
    for _ in range(3000):
        size = rnd.choice(packing.TIERS)
        load[g.place(size)] += size
    assert max(load.values()) <= 4096
    assert sum(v == 4096 for v in load.values()) >= len(load) - 8


def test_op10(spark, tmp_path, library):
    rows = some_rows()
    got = sorted(op10_token_files(spark, write(spark, tmp_path, rows)).collect())
    assert len(got) == len(rows)
    start = 0
    for r, (i, t, *_) in zip(got, sorted(rows, key=lambda r: r[0])):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(array.array("I", ids).tobytes()))
        start += len(ids)


def test_clashing_columns_ties_nulls_and_no_rows(spark, tmp_path):
    schema = "doc_id long, text string, ids string, start long, file string, row long, n_tokens long"
    rows = [(5, "a b", "x", 1, "f", 2, 3), (5, "a b", "x", 1, "f", 2, 3), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    assert packing.pack(df, JSON).count() == 3
    assert bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS).count() == 3
    path = tokenfiles.write_token_files(df, str(tmp_path / "t"), JSON)
    back = tokenfiles.with_starts(tokenfiles.with_checksums(tokenfiles.read_token_files(spark, path)), spark, path)
    assert sorted(r.start for r in back.collect()) == [0, 1, 4]
    empty = spark.createDataFrame([], schema)
    assert packing.pack(empty, JSON).count() == 0
    path = tokenfiles.write_token_files(empty, str(tmp_path / "e"), JSON)
    assert tokenfiles.with_starts(tokenfiles.with_checksums(tokenfiles.read_token_files(spark, path)), spark, path).count() == 0


def test_a_small_table_of_chunks_gives_the_same_ids():
    small, large = tokens.library_encoder(JSON, 40), tokens.library_encoder(JSON)
    for k in range(30):
        texts = [" ".join(f"word{(i * 7 + k) % 90}," for i in range(60)), "two  blanks", None, "", f"head{k} tail word{k},"]
        assert small.encode(texts) == large.encode(texts)
        assert len(small.before) <= 40 + 62 and len(small.after) <= 40 + 62


def test_the_pipeline_packs_with_a_bounded_table(monkeypatch):
    import corpus_pipeline

    seen = {}
    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda docs, path, **kw: seen.update(kw))
    corpus_pipeline.pack_sequences.__wrapped__(None, None, "")
    assert seen["kept_chunks"] <= 100_000


def test_only_unknown_chunks_are_gone_through():
    from stackwarden.llm.chunks import _unknown

    ids = [b"a", None, None, b"b", None]
    places = []
    for k in _unknown(ids):
        places.append(k)
        ids[k] = None if k == 2 else b"x"
    assert places == [1, 2, 4] and list(_unknown([b"a"])) == [] and list(_unknown([])) == []


def test_rare_ends_of_words_make_no_states():
    import random

    import public_tokenizers

    machine = bpe.Transducer(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    rnd = random.Random(3)
    words = ["".join(rnd.choice("aeinrst\u00e9\u00df") for _ in range(rnd.randint(9, 30))).encode() for _ in range(400)]
    for w in words + words[:50] * 3:  # new, met again, and by moves made
        want = machine.ranks.get(w)
        assert list(memoryview(machine.encode(w)).cast("I")) == ([want] if want is not None else machine.merge(w))
    assert len(machine.states) < 1000


def test_decoding_bytes_alone(spark):
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(1, "na\u00efve \U0001f600 caf\u00e9"), (2, None)], "doc_id long, text string")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    got = bpe.decode(encoded, ranks, with_text=False)
    assert got.columns == ["doc_id", "ids", "n_tokens", "bytes"]
    assert {r.doc_id: bytes(r["bytes"]) for r in got.collect()} == {1: "na\u00efve \U0001f600 caf\u00e9".encode(), 2: b""}

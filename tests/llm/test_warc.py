"""WARC archives: round trip, dictionary and revisits."""

import glob
import hashlib
import random

from stackwarden.llm import warc


def rows():
    rnd = random.Random(6)
    words = [f"<p>word{i}</p>" for i in range(80)]
    bodies = ["".join(rnd.choice(words) for _ in range(rnd.randint(1, 400))) for _ in range(80)] + ["é" * 499, "é" * 500, "x" * 999, "y" * 1000, "", None, "z" * 200_000]
    out = [(i, f"http://h/{i}", b, "k") for i, b in enumerate(bodies)]
    out += [(500 + i, None, b, "k") for i, b in enumerate(bodies[60:])] + [(900 + i, "u\r\nv", bodies[80], "k") for i in range(3)]
    return out + [(None, "n", bodies[-1], "k"), (586, None, bodies[-1], "k")]


def test_round_trip(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, "page_id long, url string, html string, digest string").repartition(3)
    path = warc.write(df, str(tmp_path / "w"))
    got = warc.read(spark, path).collect()
    assert len(got) == len(data)
    body = {(i, u): (b or "").encode() for i, u, b, _ in data}
    largest = {}
    for i, _, b, _ in data:
        b = (b or "").encode()
        if i is not None:
            largest[b] = max(largest.get(b, -1), i)
    text = {i: b for (i, _), b in body.items()}
    for r in got:
        b = text[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
        revisit = len(b) >= 1000 and r.page_id != largest[b]
        assert (r.record_type, r.refers_to) == (("revisit", largest[b]) if revisit else ("response", None))
        assert r.payload == (None if revisit else b)


def test_archives_are_plain_zstandard_after_the_dictionary(spark, tmp_path):
    import zstandard

    df = spark.createDataFrame(rows(), "page_id long, url string, html string, digest string").coalesce(1)
    path = warc.write(df, str(tmp_path / "w"))
    (raw,) = [x for x in (open(f, "rb").read() for f in glob.glob(path + "/part-*")) if x]
    assert raw[:4] == b"\x5d\x2a\x4d\x18"
    n = int.from_bytes(raw[4:8], "little")
    d = zstandard.ZstdCompressionDict(raw[8:8 + n])
    assert d.dict_id() > 0
    with zstandard.ZstdDecompressor(dict_data=d).stream_reader(raw[8 + n:], read_across_frames=True) as z:
        whole = z.read()
    assert whole == b"".join(warc.records_of(raw)) and whole.count(b"WARC/1.1\r\n") == len(rows())


def test_few_records_no_rows_and_extra_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a", "x", 1)], "page_id long, url string, html string, payload string, k int")
    assert warc.read(spark, warc.write(df, str(tmp_path / "a"))).count() == 1
    assert warc.read(spark, warc.write(df.limit(0), str(tmp_path / "b"))).count() == 0

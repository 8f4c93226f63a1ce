import hashlib
import zlib

import numpy as np

from quarry.llm import avi as A


def test_rows_round_trip():
    x = np.random.default_rng(0).integers(0, 256, (500, 64)).astype(np.uint8)
    x[0], x[1, ::2], x[1, 1::2] = 255, 0, 255
    assert (A.decode_rows(A.encode_rows(x)) == x).all()


def test_payloads(spark):
    texts = [None, "", "hi", "hi", "é日本" * 5000, "a" * 512 * 24 + "\x7f" * 512 * 24]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    media = A.encode_media(df)
    for r in A.media_features(media).collect():
        p = A.pad(texts[r.doc_id])
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    c = [r for r in A.clips(media).orderBy("doc_id", "clip").collect() if r.doc_id == 5]
    assert [(r.start_s, r.end_s) for r in c] == [(0.0, 0.96), (0.96, 1.92)]
    assert A.media_features(A.encode_media(df.limit(0))).count() == 0


def test_shots():
    rnd = np.random.default_rng(4)
    text = lambda lo, hi, n: bytes(rnd.integers(lo, hi, n).astype(np.uint8))
    p = text(97, 123, 512 * 9) + text(48, 58, 512 * 5) + text(97, 123, 512 * 6 + 100)
    (frames, size), = A.decode_many(A.encode_many([p.ljust(-(-len(p) // 64) * 64, b"\0")]))
    assert [(a, b) for a, b, _ in A.shots(frames, size)] == [(0, 9), (9, 14), (14, 21)]
    # a short last frame and padding open no shot
    p = text(97, 123, 512 * 4) + b"0" * 70
    (frames, size), = A.decode_many(A.encode_many([p.ljust(-(-len(p) // 64) * 64, b"\0")]))
    assert [(a, b) for a, b, _ in A.shots(frames, size)] == [(0, 5)]


def test_media_from_elsewhere(spark, tmp_path):
    """Written and read again; what is unreadable has a defined row."""
    good = A.encode_many([A.pad("hello " * 300)])[0]
    bad = [None, b"", b"RIFF", b"RIFF\4\0\0\0WAVE", good[:200], good[:-16], good.replace(b"\xff\xc3", b"\xff\xc0"), b"RIFF\x0c\0\0\0AVI LIST\xff\xff\xff\xff"]
    df = spark.createDataFrame([(i, 0, m) for i, m in enumerate([good, *bad])], "doc_id long, n_bytes long, media binary")
    df.write.parquet(f"{tmp_path}/media")
    r = A.media_features(spark.read.parquet(f"{tmp_path}/media")).orderBy("doc_id").collect()
    assert r[0].payload_bytes == 1856 and r[0].payload_sha256 == hashlib.sha256(A.pad("hello " * 300)).hexdigest()
    assert all(x.feature == "unreadable" and x.payload_bytes is None for x in r[1:])
    assert {x.doc_id for x in A.clips(df).collect()} == {0}

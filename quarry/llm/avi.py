"""AVI motion-JPEG columns (op2): bytes as 8-bit grey samples of lossless intra frames.

A payload is laid out in rows of 64 samples and frames of at most 8 rows; each frame is
a JPEG of the lossless process (SOF3, left predictor) with one restart interval per row,
so that rows decode side by side. The frames sit in a RIFF AVI with an idx1 index, read
back through that index. Shots are found where the histogram difference of neighbouring
frames exceeds an adaptive threshold (mean and spread of the last frames' differences, and
FLOOR at least); padding is in no histogram, and a last frame of less than half its samples
opens no shot. The feature lists every shot: start and end in seconds and its histogram,
16 levels as hexadecimal digits of their share (f: a half or more).

Media are columns: `encode_media` gives a table of AVI files that may be written and read
anywhere, `media_features` and `clips` read such a table. The query joins both in one job.

Defined cases: null and empty texts give 64 zero bytes and one clip; equal texts give
equal media; repeated rows are encoded again; media that are null, no AVI, cut off or
coded otherwise than above (another JPEG process, size or layout) give a row with null
payload columns and the feature `unreadable`, and no clips; other columns are ignored; an
empty table gives no rows.
"""
import hashlib
import json
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import by_size, documents

W, HEIGHT, FPS, BINS, LOOKBACK, SPREAD, FLOOR = 64, 8, 25, 16, 12, 3.0, 0.12
ROW_BYTES = W * 12 // 8 + 4
RST = re.compile(b"\xff[\xd0-\xd7]")


def encode_rows(x: np.ndarray) -> list[bytes]:
    """Entropy-coded bytes of each row: 4-bit category, then its amplitude bits."""
    n = len(x)
    d = np.diff(x.astype(np.int32), axis=1, prepend=np.full((n, 1), 128, np.int32))
    cat = np.ceil(np.log2(np.abs(d) + 1)).astype(np.int32)
    amp = np.where(d < 0, d + (1 << cat) - 1, d)
    code, size = cat << cat | amp, cat + 4
    ends = np.cumsum(size, 1)
    buf = np.zeros((n, ROW_BYTES), np.uint8)
    rows = np.arange(n)
    for j in range(W):
        p = ends[:, j] - size[:, j]
        v = code[:, j] << (24 - size[:, j] - (p & 7))
        b = p >> 3
        buf[rows, b] |= (v >> 16).astype(np.uint8)
        buf[rows, b + 1] |= ((v >> 8) & 255).astype(np.uint8)
        buf[rows, b + 2] |= (v & 255).astype(np.uint8)
    last = ends[:, -1]
    nb, pad = (last + 7) // 8, (-last) % 8
    buf[rows, nb - 1] |= ((1 << pad) - 1).astype(np.uint8)
    raw, step = buf.tobytes(), ROW_BYTES
    return [raw[i * step:i * step + k].replace(b"\xff", b"\xff\0") for i, k in enumerate(nb.tolist())]


def decode_rows(rows: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(r.replace(b"\xff\0", b"\xff").ljust(ROW_BYTES, b"\0") for r in rows), np.uint8).reshape(-1, ROW_BYTES).astype(np.int32)
    n, at = len(data), np.arange(len(data))
    p, prev, out = np.zeros(n, np.int32), np.full(n, 128, np.int32), np.empty((n, W), np.uint8)
    for j in range(W):
        b = p >> 3
        v = (data[at, b] << 16 | data[at, b + 1] << 8 | data[at, b + 2]) << (p & 7) & 0xFFFFFF
        cat = v >> 20
        a = (v >> (20 - cat)) & ((1 << cat) - 1)
        prev = prev + np.where((cat > 0) & (a < (1 << np.maximum(cat - 1, 0))), a - (1 << cat) + 1, a)
        out[:, j] = prev
        p += cat + 4
    return out


def jpeg(rows: list[bytes]) -> bytes:
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    head = b"\xff\xd8" + seg(0xC4, b"\0" + bytes([0, 0, 0, 9] + [0] * 12) + bytes(range(9)))
    head += seg(0xC3, struct.pack(">BHHB", 8, len(rows), W, 1) + b"\1\x11\0") + seg(0xDD, struct.pack(">H", W)) + seg(0xDA, b"\1\1\0\1\0\0")
    return head + b"".join(x for i, r in enumerate(rows) for x in ((bytes([0xFF, 0xD0 + (i - 1) % 8]), r) if i else (r,))) + b"\xff\xd9"


def jpeg_rows(frame: bytes) -> list[bytes]:
    """Walk the markers to the scan and split it at its restart markers."""
    p, shape = 2, None
    while True:
        marker, size = frame[p + 1], struct.unpack_from(">H", frame, p + 2)[0]
        if marker == 0xC3:
            shape = struct.unpack_from(">BHHB", frame, p + 4)
        p += 2 + size
        if marker == 0xDA:
            break
    rows = RST.split(frame[p:frame.rindex(b"\xff\xd9")])
    if shape != (8, len(rows), W, 1) or max(map(len, rows)) > 2 * ROW_BYTES:
        raise ValueError("frame is not of this layout")
    return rows


def chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(frames: list[bytes], height: int, payload: int) -> bytes:
    big = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, big * FPS, 0, 0x10, len(frames), 0, 1, big, W, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, len(frames), big, 0xFFFFFFFF, 0, 0, 0, W, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, W, height, 1, 8, b"MJPG", W * height, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", str(payload).encode()))
    movi, index, at = [], [], 4
    for f in frames:
        c = chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    return chunk(b"RIFF", b"AVI " + hdrl + info + chunk(b"LIST", b"movi" + b"".join(movi)) + chunk(b"idx1", b"".join(index)))


def parse(media: bytes) -> tuple[list[bytes], int]:
    """Frames by the idx1 index, and the payload's length."""
    if media is None or media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("no AVI")
    p, movi, index, payload = 12, None, None, None
    while p + 8 <= len(media):
        tag, size = media[p:p + 4], struct.unpack_from("<I", media, p + 4)[0]
        kind = media[p + 8:p + 12] if tag == b"LIST" else b""
        if kind == b"movi":
            movi = p + 8
        elif kind == b"INFO":
            payload = int(media[p + 20:p + 20 + struct.unpack_from("<I", media, p + 16)[0]])
        elif tag == b"idx1":
            index = media[p + 8:p + 8 + size]
        p += 8 + size + size % 2
    if movi is None or not index or len(index) % 16 or payload is None:
        raise ValueError("no index, frames or payload length")
    return [media[movi + at + 8:movi + at + 8 + n] for _, _, at, n in struct.iter_unpack("<4sIII", index)], payload


def pad(text: str | None) -> bytes:
    b = (text or "").encode()
    return b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")


def encode_many(payloads: list[bytes]) -> list[bytes]:
    heights = [min(HEIGHT, len(p) // W) for p in payloads]
    padded = [p.ljust(-(-len(p) // (W * h)) * W * h, b"\0") for p, h in zip(payloads, heights)]
    rows = encode_rows(np.frombuffer(b"".join(padded), np.uint8).reshape(-1, W))
    out, at = [], 0
    for p, q, h in zip(payloads, padded, heights):
        n = len(q) // W
        out.append(avi([jpeg(rows[i:i + h]) for i in range(at, at + n, h)], h, len(p)))
        at += n
    return out


def decode_many(media: list[bytes]) -> list[tuple[np.ndarray, int] | None]:
    """(frames x height x 64 samples, payload length) of each; None of what is unreadable."""
    split = []
    for m in media:
        try:
            frames, size = parse(m)
            rows = [jpeg_rows(f) for f in frames]
            if len({len(r) for r in rows}) > 1 or not 0 < size <= sum(len(r) for r in rows) * W:
                raise ValueError("frames differ or do not hold the payload")
            split.append((rows, size))
        except (ValueError, IndexError, struct.error):
            split.append(None)
    flat = decode_rows([r for x in split if x for f in x[0] for r in f])
    out, at = [], 0
    for x in split:
        if x is None:
            out.append(None)
            continue
        n, h = len(x[0]), len(x[0][0])
        out.append((flat[at:at + n * h].reshape(n, h, W), x[1]))
        at += n * h
    return out


def histograms(frames: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the levels per frame, and its number of samples before the payload's padding."""
    n, area = len(frames), frames[0].size
    flat = frames.reshape(-1)
    end = size
    while end > max(0, size - W) and flat[end - 1] == 0:
        end -= 1
    used = np.clip(end - area * np.arange(n), 0, area)
    bins = np.bincount((flat[:end] >> 4) + BINS * (np.arange(end) // area), minlength=n * BINS).reshape(n, BINS)
    return bins / np.maximum(used, 1)[:, None], used


def shots(frames: np.ndarray, size: int) -> list[tuple[int, int, str]]:
    """[first, end) frames and histogram of each shot."""
    h, used = histograms(frames, size)
    n, area = len(frames), frames[0].size
    d = np.abs(np.diff(h, axis=0)).sum(1) / 2
    cuts, since = [0], 0
    for i in range(len(d) - (used[-1] < area / 2)):
        if d[i] <= FLOOR:
            continue
        past = d[max(since, i - LOOKBACK):i]
        if not len(past) or d[i] > past.mean() + SPREAD * past.std():
            cuts.append(i + 1)
            since = i + 1
    out = []
    for a, b in zip(cuts, [*cuts[1:], n]):
        share = (h[a:b] * used[a:b, None]).sum(0) / max(1, used[a:b].sum())
        out.append((a, b, "".join("%x" % x for x in np.minimum(15, np.rint(share * 30)).astype(int))))
    return out


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media binary."""
    def run(batches):
        for big in batches:
            for pdf in by_size(big, rows=256):
                yield pd.DataFrame({"doc_id": pdf.doc_id, "n_bytes": [len((t or "").encode()) for t in pdf.text], "media": encode_many([pad(t) for t in pdf.text])})
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_bytes long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows: doc_id, clip, start_s, end_s, levels."""
    def run(batches):
        for pdf in batches:
            read = ((d, decode_many([m])[0]) for d, m in zip(pdf.doc_id, pdf.media))
            rows = [(d, k, a / FPS, b / FPS, h) for d, x in read if x for k, (a, b, h) in enumerate(shots(*x))]
            yield pd.DataFrame(rows, columns=["doc_id", "clip", "start_s", "end_s", "levels"])
    return media.select("doc_id", "media").mapInPandas(run, "doc_id long, clip int, start_s double, end_s double, levels string")


def media_features(media: DataFrame) -> DataFrame:
    """The columns of op2_avi from a table (doc_id, n_bytes, media)."""
    def one(m, read):
        if read is None:
            return None, None, None, None if m is None else len(m), None if m is None else hashlib.sha256(m).hexdigest(), "unreadable"
        p = read[0].tobytes()[:read[1]]
        feature = json.dumps([[a / FPS, b / FPS, h] for a, b, h in shots(*read)])
        return read[1], hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature

    def run(batches):
        for big in batches:
            for pdf in by_size(big, "media", rows=256):
                rows = [one(m, x) for m, x in zip(pdf.media, decode_many(list(pdf.media)))]
                out = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], dtype=object)
                yield pd.concat([pdf[["doc_id", "n_bytes"]].reset_index(drop=True), out], axis=1)
    return media.mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_avi(spark, sf_dir):
    return media_features(encode_media(documents(spark, sf_dir)))

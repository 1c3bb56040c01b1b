"""Media columns: texts as PNG images in a binary column, read back with all checks, and image hashes.

Each row, also one without an id or with another's, has its own result; an empty table gives none.
Nulls count as empty texts; an empty payload is one row of zero samples, so every row has an image.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 16


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _filtered(rows: np.ndarray, kind: int) -> np.ndarray:
    """Residuals of PNG filter 0 to 4 at one byte a pixel."""
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], up[1:] = rows[:, :-1], rows[:-1]
    if kind == 0:
        return rows
    if kind == 1:
        return rows - left
    if kind == 2:
        return rows - up
    if kind == 3:
        return rows - ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    corner = np.zeros_like(rows)
    corner[1:, 1:] = rows[:-1, :-1]
    return rows - _paeth(left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16)).astype(np.uint8)


def _paeth(a, b, c):
    p = a + b - c
    pa_, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def encode_png(payload: bytes, width: int = WIDTH, filters: tuple[int, ...] = (0, 1, 2), level: int = 6) -> bytes:
    """An 8-bit greyscale PNG whose samples are the payload.

    Each row gets the filter of least absolute sum; where filter 0 throughout packs smaller, it is taken instead.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    best = kinds = cost = None
    for kind in filters:
        res = _filtered(rows, kind)
        now = np.minimum(res, 0 - res).sum(axis=1, dtype=np.int64)
        if best is None:
            best, kinds, cost = res.copy(), np.full(len(rows), kind, np.uint8), now
        else:
            less = now < cost
            best[less], kinds[less], cost[less] = res[less], kind, now[less]
    data = zlib.compress(np.concatenate([kinds[:, None], best], axis=1).tobytes(), level)
    if 0 in filters and kinds.any():
        plain = zlib.compress(np.concatenate([np.zeros_like(kinds)[:, None], rows], axis=1).tobytes(), level)
        data = min(data, plain, key=len)
    body = [_chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES)]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *body, _chunk(b"IEND", b"")])


def unfilter(kinds: np.ndarray, res: np.ndarray) -> np.ndarray:
    """Samples of filtered rows. Runs of None, Sub or Up rows are done at once; Average and Paeth by the pixel."""
    out = np.empty_like(res)
    cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for a, b in zip(cuts, cuts[1:]):
        kind = kinds[a] if a < b else 0
        if kind == 0:
            out[a:b] = res[a:b]
        elif kind == 1:
            np.cumsum(res[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            np.cumsum(res[a:b], axis=0, dtype=np.uint8, out=out[a:b])
            if a:
                out[a:b] += out[a - 1]
        else:
            for y in range(a, b):
                up = out[y - 1].tolist() if y else [0] * res.shape[1]
                line, left, corner = [], 0, 0
                for r, above in zip(res[y].tolist(), up):
                    if kind == 3:
                        left = (r + ((left + above) >> 1)) & 255
                    else:
                        p = left + above - corner
                        da, db, dc = abs(p - left), abs(p - above), abs(p - corner)
                        left = (r + (left if da <= db and da <= dc else above if db <= dc else corner)) & 255
                    corner = above
                    line.append(left)
                out[y] = line
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit greyscale PNG without interlace. Raises ValueError at any damage."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, body, ended = 8, None, [], False
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("cut chunk")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if len(part) != n or at + 12 + n > len(data):
            raise ValueError("cut chunk")
        if zlib.crc32(part, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 0x20:
            raise ValueError(f"unknown critical chunk {kind!r}")
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale image without interlace")
    width, height = head[:2]
    packed = zlib.decompressobj()
    raw = packed.decompress(b"".join(body), height * (width + 1) + 1)  # no more than the header allows
    if len(raw) != height * (width + 1) or not packed.eof:
        raise ValueError("wrong number of samples")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    if rows[:, 0].max(initial=0) > 4:
        raise ValueError("unknown filter")
    return unfilter(rows[:, 0], rows[:, 1:])


@lru_cache(None)
def _cosines(n: int, k: int) -> np.ndarray:
    """Rows 0..k-1 of the cosine transform over n points, in integers: equal on every machine."""
    u, x = np.arange(k)[:, None], np.arange(n)[None, :]
    return np.rint(np.cos(np.pi * u * (2 * x + 1) / (2 * n)) * 4096).astype(np.int64)


def _bounds(n: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(side)
    lo = np.minimum(i * n // side, n - 1)
    return lo, np.maximum(lo + 1, (i + 1) * n // side)


def cosine_hash(image: np.ndarray, side: int = 32, low: int = 8) -> bytes:
    """64 bits: which of the low-frequency cosine coefficients of the averaged image exceed their median."""
    h, w = image.shape
    total = np.zeros((h + 1, w + 1), np.int64)
    total[1:, 1:] = image.cumsum(0, dtype=np.int64).cumsum(1)
    (y0, y1), (x0, x1) = _bounds(h, side), _bounds(w, side)
    sums = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    cells = sums * 16 // ((y1 - y0)[:, None] * (x1 - x0)[None, :])
    coef = (_cosines(side, low) @ cells @ _cosines(side, low).T).ravel()
    rest = np.sort(coef[1:])
    return np.packbits(coef > rest[len(rest) // 2]).tobytes()


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def write_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 6) -> DataFrame:
    """(id, n_bytes, media binary): each whole text as a lossless image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            ids, sizes, media = b.column(0).to_pylist(), [], []
            for t in b.column(1):
                n, payload = payload_of(t.as_py() or "")
                sizes.append(n)
                media.append(encode_png(payload, level=level))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    got = df.select(df[id_col].cast("long"), df[text_col]).mapInArrow(run, "id long, n_bytes long, media binary")
    return got.withColumnRenamed("id", id_col)


def read_media(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the stored images hold: payload digests and the hash column, from the bytes read back.

    A null image gives null digests; a damaged one raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 2):
            rows = []
            for i, n, m in zip(*(b.column(k).to_pylist() for k in range(3))):
                if m is None:
                    rows.append((i, n, None, None, None, None, None, None))
                    continue
                image = decode_png(m)
                payload = image.tobytes()
                rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), cosine_hash(image)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash"])

    got = df.select(id_col, "n_bytes", "media").mapInArrow(run, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary")
    return got.withColumnRenamed("id", id_col)

"""Media columns: payloads stored as PNG, read back with checksum tests, hashed by their low frequencies.

``store_png`` writes each payload as an 8-bit grey image, 64 samples a row, in
zlib-compressed IDAT chunks.  ``read_png`` walks the chunks of each stored image,
tests every CRC, inflates, removes the row filters with numpy (any colour type and
depth of the format, without interlace) and returns the samples' digests and a hash of
their brightness: a 32 x 32 area mean, its two-dimensional cosine
transform in fixed-point integers (equal on every machine), and one bit for each
of the 8 x 8 lowest frequencies, set where it exceeds their median.

Defined cases: null text is an empty payload, stored as one row of zeros; equal
texts give equal values; broken media (bad signature, CRC, length or filter)
read as valid = false with null digests and never stop a job; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, CHUNK = 64, 1 << 16
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format
#: Images above this many samples are refused on reading, so that a forged header cannot ask for memory.
MOST_SAMPLES = 1 << 31
#: Rows that are unfiltered together.
BAND = 1024
#: Channels and depths of the format's colour types; fixed values.
COLOURS = {0: (1, (1, 2, 4, 8, 16)), 2: (3, (8, 16)), 3: (1, (1, 2, 4, 8)), 4: (2, (8, 16)), 6: (4, (8, 16))}
_SIDE, _LOW = 32, 8
_COS = np.round(np.cos(np.pi * (2 * np.arange(_SIDE)[None, :] + 1) * np.arange(_LOW)[:, None] / (2 * _SIDE)) * (1 << 14)).astype(np.int64)


def pad(payload: bytes) -> bytes:
    """Zeros up to a positive multiple of the row width."""
    return payload + bytes(-len(payload) % WIDTH or (0 if payload else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _residuals(rows: np.ndarray, kind: int) -> np.ndarray:
    out = rows.copy()
    if kind == 1:
        out[:, 1:] -= rows[:, :-1]
    elif kind == 2:
        out[1:] -= rows[:-1]
    return out


def encode(samples: bytes, level: int = 1) -> bytes:
    """PNG of grey samples, by the one of the filters none, left and up whose residuals are smallest."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    kind = min((0, 1, 2), key=lambda k: int(np.abs(_residuals(rows, k).view(np.int8).astype(np.int16)).sum()))
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, _residuals(rows, kind)
    packed = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)), _chunk(b"IEND", b"")])


def _unfilter(kinds: np.ndarray, rows: np.ndarray, bpp: int = 1) -> np.ndarray:
    """Bytes of filtered rows, with bpp bytes a pixel; BAND rows at a time.

    Where no row looks both left and up, runs of rows of one kind are sums.  Else all
    pixels of an anti-diagonal are done together, as each needs the left, upper and
    upper left one, whatever the kinds of the rows.
    """
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown filter")
    out = np.empty_like(rows).reshape(len(rows), -1, bpp)
    table = rows.reshape(out.shape)
    above = np.zeros(out.shape[1:], np.uint8)
    for at in range(0, len(rows), BAND):
        own, kind = table[at : at + BAND], kinds[at : at + BAND]
        if kind.max() > 2:
            out[at : at + BAND] = _wavefront(kind, own, above)
        else:
            cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]
            for s, e in zip(cuts, cuts[1:]):
                before = out[at + s - 1] if s else above
                if kind[s] == 1:
                    done = np.cumsum(own[s:e], axis=1, dtype=np.uint8)
                elif kind[s] == 2:
                    done = np.cumsum(np.concatenate([before[None], own[s:e]]), axis=0, dtype=np.uint8)[1:]
                else:
                    done = own[s:e]
                out[at + s : at + e] = done
        above = out[min(at + BAND, len(rows)) - 1]
    return out.reshape(rows.shape)


def _wavefront(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Pixels of some rows (rows x pixels x bytes) of any filters, one anti-diagonal after the other."""
    n, width, bpp = rows.shape
    done = np.zeros((n + 1, width + 1, bpp), np.int16)
    done[0, 1:] = above
    for d in range(n + width - 1):
        y = np.arange(max(0, d - width + 1), min(n, d + 1))
        x = d - y
        left, up, corner = done[y + 1, x], done[y, x + 1], done[y, x]
        kind = kinds[y][:, None]
        by_left, by_up, by_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))
        guess = np.where(kind == 4, nearest, np.where(kind == 3, (left + up) // 2, np.where(kind == 2, up, np.where(kind == 1, left, 0))))
        done[y + 1, x + 1] = (rows[y, x] + guess) & 255
    return done[1:, 1:].astype(np.uint8)


def decode(stored: bytes) -> np.ndarray:
    """Samples of a PNG without interlace: height x width where it is grey, else height x width x channels; ValueError if anything in it is wrong.

    Palettes are looked up; samples of less than 8 bits are one byte each, as stored.
    """
    if stored[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, head, data, palette, ended = 8, None, [], None, False
    while at + 12 <= len(stored) and not ended:
        size, kind = struct.unpack_from(">I4s", stored, at)
        body = stored[at + 8 : at + 8 + size]
        if len(stored) < at + 12 + size or zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", stored, at + 8 + size)[0]:
            raise ValueError("bad chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not head or not ended or head[4:] != (0, 0, 0):
        raise ValueError("not an image without interlace")
    width, height, depth, colour = head[:4]
    channels, depths = COLOURS.get(colour, (0, ()))
    if depth not in depths or not 0 < width * height * channels <= MOST_SAMPLES:
        raise ValueError("unknown form or size")
    line, bpp = -(-width * channels * depth // 8), max(1, channels * depth // 8)
    unpack = zlib.decompressobj()
    try:
        lines = unpack.decompress(b"".join(data), height * (line + 1) + 1)
    except zlib.error as e:
        raise ValueError("bad stream") from e
    if len(lines) != height * (line + 1) or not unpack.eof:
        raise ValueError("bad length")
    table = np.frombuffer(lines, np.uint8).reshape(height, line + 1)
    raw = _unfilter(table[:, 0].astype(np.int64), np.ascontiguousarray(table[:, 1:]), bpp)
    if depth == 16:
        samples = raw.view(">u2")
    elif depth < 8:
        bits = np.unpackbits(raw, axis=1).reshape(height, -1, depth)
        samples = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)[:, : width * channels]
    else:
        samples = raw
    if colour == 3:
        if not palette or len(palette) % 3 or int(samples.max()) >= len(palette) // 3:
            raise ValueError("bad palette")
        return np.frombuffer(palette, np.uint8).reshape(-1, 3)[samples]
    return samples if channels == 1 else samples.reshape(height, width, channels)


def brightness(samples: np.ndarray) -> np.ndarray:
    """Height x width numbers of one byte: grey as it is, colours weighted, transparency left out."""
    if samples.dtype.itemsize == 2:
        samples = (samples >> 8).astype(np.uint8)
    if samples.ndim == 2:
        return samples
    if samples.shape[2] < 3:
        return samples[:, :, 0]
    return ((samples[:, :, :3].astype(np.int64) * np.array([299, 587, 114])).sum(axis=2) // 1000).astype(np.uint8)


def _bins(n: int) -> tuple[np.ndarray, np.ndarray]:
    start = np.arange(_SIDE) * n // _SIDE
    return start, np.maximum(np.arange(1, _SIDE + 1) * n // _SIDE, start + 1)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits of the lowest frequencies."""
    sums = np.zeros((samples.shape[0] + 1, samples.shape[1]), np.int64)
    np.cumsum(samples, axis=0, out=sums[1:], dtype=np.int64)
    (a, b), (c, d) = _bins(samples.shape[0]), _bins(samples.shape[1])
    across = np.zeros((_SIDE, samples.shape[1] + 1), np.int64)
    np.cumsum(sums[b] - sums[a], axis=1, out=across[:, 1:])
    mean = ((across[:, d] - across[:, c]) << 8) // ((b - a)[:, None] * (d - c)[None, :])
    low = (_COS @ mean @ _COS.T).ravel()
    return np.packbits(low > np.sort(low[1:])[31]).tobytes()


def store_png(df: DataFrame, text_column: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns and: n_bytes of the text, media (PNG bytes)."""
    df = df.select(*keys, F.encode(F.coalesce(F.col(text_column), F.lit("")), "UTF-8").alias("_payload"))

    def write(batches):
        for batch in batches:
            payloads = batch.column("_payload").to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([len(p) for p in payloads], pa.int64()), pa.array([encode(pad(p)) for p in payloads], pa.binary())], [*keys, "n_bytes", "media"])

    kinds = ", ".join(f"`{k}` {t}" for k, t in df.dtypes if k != "_payload")
    return df.mapInArrow(write, f"{kinds}, n_bytes long, media binary")


def read_png(df: DataFrame, media_column: str = "media", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns and: valid, width, height, payload_sha256, tail_crc32, media_bytes, media_sha256, phash (8 bytes)."""
    df = df.select(*keys, F.col(media_column).alias("_media"))
    names = ["valid", "width", "height", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "phash"]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (False, *[None] * 7)
        known = (len(media), hashlib.sha256(media).hexdigest())
        try:
            samples = decode(media)
        except (ValueError, struct.error):
            return False, None, None, None, None, *known, None
        back = samples.tobytes()
        return True, samples.shape[1], samples.shape[0], hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), *known, cosine_hash(brightness(samples))

    def read(batches):
        for batch in batches:
            rows = [one(m) for m in batch.column("_media").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], [*keys, *names])

    own = ", ".join(f"`{k}` {t}" for k, t in df.dtypes if k != "_media")
    return df.mapInArrow(read, f"{own}, valid boolean, width long, height long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, phash binary")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("doc_id", "n_bytes")
    found = read_png(store_png(spark.read.parquet(f"{sf_dir}/documents.parquet")), keys=keys)
    return found.select(*keys, (F.col("width") * F.col("height")).alias("payload_bytes"), "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("phash")).alias("feature"))

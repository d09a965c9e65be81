"""8-bit PNG images as arrays and back, for functions that run in Python workers."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..functions.frames import over_white

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type; fixed values of the format.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def encode(rgb: np.ndarray) -> bytes:
    """The file of a height x width x 3 array; equal arrays give equal bytes."""
    height, width = rgb.shape[:2]
    rows = np.zeros((height, 1 + 3 * width), np.uint8)
    rows[:, 1:] = rgb.reshape(height, -1)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def _chunks(data: bytes) -> dict[bytes, bytes]:
    """Bodies by name, those of one name joined."""
    if not data.startswith(SIGNATURE):
        raise ValueError("no PNG")
    found: dict[bytes, list[bytes]] = {}
    at = len(SIGNATURE)
    while b"IEND" not in found:
        if at + 12 > len(data):
            raise ValueError("the file ends early")
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body, check = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(check) < 4 or struct.unpack(">I", check)[0] != zlib.crc32(name + body):
            raise ValueError("a chunk is broken")
        found.setdefault(name, []).append(body)
        at += 12 + n
    return {name: b"".join(bodies) for name, bodies in found.items()}


def _unfilter(kinds: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Samples (height x width x samples) of filtered rows.

    A sample needs those left, above and left above, so all rows go on together, each a
    step behind the one above: what a row needs are the two steps before.
    """
    height, width, samples = raw.shape
    out = np.zeros(raw.shape, np.uint8)
    before, earlier = (np.zeros((height + 1, samples), np.int16) for _ in range(2))
    spare = np.zeros_like(before)
    for step in range(width + height - 1):
        rows = np.arange(max(0, step - width + 1), min(height, step + 1))
        left, above, corner, kind = before[rows + 1], before[rows], earlier[rows], kinds[rows, None]
        to_left, to_above, to_corner = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
        nearest = np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, above, (left + above) >> 1, nearest], 0)
        value = (raw[rows, step - rows] + guess) & 255
        out[rows, step - rows] = value
        spare[rows + 1] = value
        earlier, before, spare = before, spare, earlier
    return out


def decode(data: bytes) -> np.ndarray:
    """Colours (height x width x 3, int16) of a file, alpha on white; ValueError for what is broken, interlaced or not of 8 bits."""
    parts = _chunks(bytes(data))
    if len(parts.get(b"IHDR", b"")) != 13:
        raise ValueError("no header")
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if depth != 8 or interlaced or kind not in SAMPLES or not width or not height:
        raise ValueError("not of 8 bits, or interlaced")
    line = 1 + width * SAMPLES[kind]
    try:
        stream = zlib.decompressobj().decompress(parts.get(b"IDAT", b""), height * line)  # never more than the header says
    except zlib.error as e:
        raise ValueError("the data is broken") from e
    if len(stream) != height * line:
        raise ValueError("too little data")
    rows = np.frombuffer(stream, np.uint8).reshape(height, line)
    if rows[:, 0].max() > 4:
        raise ValueError("an unknown filter")
    raw = rows[:, 1:].reshape(height, width, SAMPLES[kind]).astype(np.int16)
    pixels = _unfilter(rows[:, 0], raw) if rows[:, 0].any() else raw.astype(np.uint8)
    if kind == 3:
        colours = np.frombuffer(parts.get(b"PLTE", b""), np.uint8)
        colours = colours[: len(colours) // 3 * 3].reshape(-1, 3)
        if pixels.max() >= len(colours):
            raise ValueError("a colour is missing")
        alpha = np.full(len(colours), 255, np.uint8)
        given = np.frombuffer(parts.get(b"tRNS", b""), np.uint8)[: len(colours)]
        alpha[: len(given)] = given
        pixels = np.concatenate([colours, alpha[:, None]], axis=1)[pixels[:, :, 0]]
    elif kind in (0, 4):
        pixels = np.concatenate([np.repeat(pixels[:, :, :1], 3, axis=2), pixels[:, :, 1:]], axis=2)
    return over_white(pixels)

"""Page images as bytes: PNG by itself, other formats where an image library is installed."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class UnreadableImage(ValueError):
    """Bytes that are no image, or one in a format that can't be read here."""


def encode(rgb: np.ndarray) -> bytes:
    """PNG bytes of an RGB array (h, w, 3)."""
    h, w, _ = rgb.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rgb, np.uint8).reshape(h, w * 3)], axis=1).tobytes()

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return _SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def _unfilter(raw: bytes, h: int, stride: int, step: int) -> np.ndarray:
    """Undo the line filters; the first two and the third are done a line at a time, the others a pixel at a time."""
    out = np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(h):
        at = y * (stride + 1)
        kind, line = raw[at], np.frombuffer(raw, np.uint8, stride, at + 1)
        if kind == 0:
            cur = line
        elif kind == 1:
            cur = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            cur = line + above
        elif kind in (3, 4):
            cur = np.zeros(stride, np.uint8)
            for x in range(0, stride, step):
                left = cur[x - step : x].astype(int) if x else np.zeros(step, int)
                up = above[x : x + step].astype(int)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    corner = above[x - step : x].astype(int) if x else np.zeros(step, int)
                    base = left + up - corner
                    near = np.stack([abs(base - left), abs(base - up), abs(base - corner)])
                    guess = np.choose(near.argmin(axis=0), [left, up, corner])
                cur[x : x + step] = (line[x : x + step] + guess) & 255
        else:
            raise UnreadableImage(f"unknown line filter {kind}")
        out[y] = above = cur
    return out


def _png(data: bytes) -> np.ndarray:
    at, head, body, palette = 8, None, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
    if head is None or head[2] != 8 or head[6] or head[3] not in _CHANNELS:
        raise UnreadableImage("only plain PNG files of 8 bits a channel can be read without an image library")
    w, h, color, n = head[0], head[1], head[3], _CHANNELS[head[3]]
    px = _unfilter(zlib.decompress(b"".join(body)), h, w * n, n).reshape(h, w, n)
    if color == 3:
        return palette[px[:, :, 0]]
    return np.repeat(px[:, :, :1], 3, axis=2) if n < 3 else px[:, :, :3].copy()


def decode(data: bytes) -> np.ndarray:
    """RGB array (h, w, 3) of image bytes; transparency is dropped. What can't be read raises UnreadableImage."""
    try:
        if data.startswith(_SIGNATURE):
            try:
                return _png(data)
            except UnreadableImage:
                pass
        try:
            from PIL import Image
        except ImportError as e:
            raise UnreadableImage("this format needs an image library") from e
        return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))
    except UnreadableImage:
        raise
    except Exception as e:  # truncated or damaged bytes, whatever the decoder makes of them
        raise UnreadableImage(str(e)) from e

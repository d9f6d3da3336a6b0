"""Small picture files written from raw bytes, and a decoder for exactly these files."""

import struct
import zlib

import numpy as np


def textured(seed, height=96, width=128):
    """Smooth colour picture whose structure depends on the seed."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width] / max(height, width)
    layers = []
    for _ in range(3):
        layer = np.zeros((height, width))
        for _ in range(6):
            fx, fy, phase, weight = rng.uniform(0, 6), rng.uniform(0, 6), rng.uniform(0, 7), rng.uniform(0.2, 1)
            layer += weight * np.cos(2 * np.pi * (fx * x + fy * y) + phase)
        layers.append(layer)
    stacked = np.stack(layers, axis=2)
    low, high = stacked.min(), stacked.max()
    return np.round(255 * (stacked - low) / (high - low)).astype(np.uint8)


def flat(color, side=16):
    return np.full((side, side, 3), color, dtype=np.uint8)


def png(pixels):
    """PNG bytes of a (h, w), (h, w, 3) or (h, w, 4) picture."""
    if pixels.ndim == 2:
        pixels = pixels[:, :, None]
    height, width, channels = pixels.shape
    kind = {1: 0, 3: 2, 4: 6}[channels]
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)

    def chunk(name, data):
        body = name + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    header = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    )


def tiff(pixels):
    """Uncompressed little-endian TIFF bytes of a (h, w, 3) picture."""
    height, width, _ = pixels.shape
    data = pixels.tobytes()
    entries = [
        (256, 3, 1, width), (257, 3, 1, height), (258, 3, 3, 8 + len(data)), (259, 3, 1, 1), (262, 3, 1, 2),
        (273, 4, 1, 8), (277, 3, 1, 3), (278, 3, 1, height), (279, 4, 1, len(data)),
    ]
    bits = struct.pack("<HHH", 8, 8, 8)
    table = struct.pack("<H", len(entries))
    for tag, kind, count, value in entries:
        table += struct.pack("<HHI", tag, kind, count)
        table += struct.pack("<HH", value, 0) if kind == 3 and count == 1 else struct.pack("<I", value)
    return b"II*\0" + struct.pack("<I", 8 + len(data) + len(bits)) + data + bits + table + struct.pack("<I", 0)


def decode_png(data):
    """Gray picture of what ``png`` writes; anything else is an error, as with a real decoder."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    place, body, shape = 8, b"", None
    while place < len(data):
        size, name = struct.unpack(">I4s", data[place : place + 8])
        part = data[place + 8 : place + 8 + size]
        if len(part) < size:
            raise ValueError("truncated file")
        if name == b"IHDR":
            width, height, _, kind = struct.unpack(">IIBB", part[:10])
            shape = (height, width, {0: 1, 2: 3, 6: 4}[kind])
        elif name == b"IDAT":
            body += part
        place += 12 + size
    rows = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(shape[0], 1 + shape[1] * shape[2])
    pixels = rows[:, 1:].reshape(shape).astype(np.float64)
    if shape[2] == 1:
        return pixels[:, :, 0]
    return pixels[:, :, 0] * 0.299 + pixels[:, :, 1] * 0.587 + pixels[:, :, 2] * 0.114


def mean_color_encoder():
    """Encoder for tests: eight numbers from the gray picture."""

    def encode(payloads):
        def one(data):
            gray = decode_png(bytes(data))
            return np.array([np.mean(part) + 1 for part in np.array_split(gray.ravel(), 8)], dtype=np.float32)

        return np.stack([one(d) for d in payloads])

    return encode

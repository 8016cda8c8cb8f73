"""Writers of test images."""

import struct
import zlib

import numpy as np

from rasterloom.sources.png import ADAM7, CHANNELS, SIGNATURE


def chunk(name: bytes, body: bytes, bad_crc: bool = False) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body) ^ bad_crc)


def _line_bytes(samples: np.ndarray, depth: int) -> np.ndarray:
    """(h, w, channels) samples as packed bytes of each line."""
    h = len(samples)
    flat = samples.reshape(h, -1)
    if depth == 16:
        return flat.astype(">u2").view(np.uint8).reshape(h, -1)
    if depth == 8:
        return flat.astype(np.uint8)
    bits = (flat[..., None] >> np.arange(depth - 1, -1, -1) & 1).reshape(h, -1).astype(np.uint8)
    return np.packbits(bits, axis=1)


def _filtered(lines: np.ndarray, bpp: int, kinds) -> bytes:
    out, above = bytearray(), np.zeros(lines.shape[1], np.int32)
    for y, line in enumerate(lines.astype(np.int32)):
        kind = kinds[y % len(kinds)]
        left = np.concatenate((np.zeros(bpp, np.int32), line))[: len(line)]
        corner = np.concatenate((np.zeros(bpp, np.int32), above))[: len(line)]
        p = left + above - corner
        pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
        guess = {0: 0, 1: left, 2: above, 3: (left + above) // 2, 4: paeth}.get(kind, 0)
        out += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    return bytes(out)


def png(samples: np.ndarray, depth: int, colour: int, filters=(0,), interlace: bool = False, palette: bytes | None = None, extra: bytes = b"", idats: int = 1, tail: bytes = b"") -> bytes:
    """A PNG of (h, w, channels) samples."""
    h, w = samples.shape[:2]
    samples = samples.reshape(h, w, -1)
    bpp = max(1, depth * CHANNELS[colour] // 8)
    parts = [samples[y0::dy, x0::dx] for y0, dy, x0, dx in ADAM7] if interlace else [samples]
    raw = b"".join(_filtered(_line_bytes(p, depth), bpp, filters) for p in parts if p.size)
    data = zlib.compress(raw + tail)
    size = -(-len(data) // idats)
    out = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(interlace))) + extra
    if palette is not None:
        out += chunk(b"PLTE", palette)
    return out + b"".join(chunk(b"IDAT", data[i * size : (i + 1) * size]) for i in range(idats)) + chunk(b"IEND", b"")


def pgm(gray: np.ndarray, most: int = 255) -> bytes:
    return b"P5\n%d %d\n%d\n" % (gray.shape[1], gray.shape[0], most) + gray.tobytes()


def pbm(bits: np.ndarray) -> bytes:
    return b"P4\n%d %d\n" % (bits.shape[1], bits.shape[0]) + np.packbits(bits, axis=1).tobytes()

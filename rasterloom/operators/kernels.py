"""Per-pixel operators over whole rasters in numpy; the fast twins of ``pixels``.

A bilevel raster is a uint8 array of 0 and 1, 1 being black; a gray one holds 0 to 255;
a colour one has a third axis of r, g, b.
"""

import numpy as np


def threshold(gray: np.ndarray, t: int) -> np.ndarray:
    """1 where the value is below ``t``."""
    return (gray < t).astype(np.uint8)


def upscale(gray: np.ndarray, factor: int) -> np.ndarray:
    """Linear interpolation to ``factor`` times the size, rounded down; the last line and column repeat."""
    s = gray.astype(np.int32)
    right = np.concatenate((s[:, 1:], s[:, -1:]), 1)
    below = np.concatenate((s[1:], s[-1:]), 0)
    corner = np.concatenate((right[1:], right[-1:]), 0)
    out = np.empty((s.shape[0] * factor, s.shape[1] * factor), np.uint8)
    for i in range(factor):
        for j in range(factor):
            out[i::factor, j::factor] = ((factor - i) * ((factor - j) * s + j * right) + i * ((factor - j) * below + j * corner)) // factor**2
    return out


def contexts(bits: np.ndarray) -> np.ndarray:
    """The 16-bit neighbourhood of each pixel: 5 above two lines up, 7 a line up, 4 to the left; 0 outside."""
    h, w = bits.shape
    pad = np.zeros((h + 2, w + 8), np.uint16)
    pad[2:, 4 : 4 + w] = bits
    out = np.zeros((h, w), np.uint16)
    for dy, dx in NEIGHBOURS:
        out = out << 1 | pad[2 + dy : 2 + dy + h, 4 + dx : 4 + dx + w]
    return out


#: (line, column) offsets of the neighbourhood, from the high bit to the low.
NEIGHBOURS = tuple((-2, k) for k in range(-2, 3)) + tuple((-1, k) for k in range(-3, 4)) + tuple((0, -k) for k in range(4, 0, -1))


def typical(bits: np.ndarray) -> np.ndarray:
    """1 for each line that repeats the one before."""
    same = np.zeros(len(bits), np.uint8)
    same[1:] = (bits[1:] == bits[:-1]).all(1)
    return same


def pack(bits: np.ndarray) -> bytes:
    """Lines of bits, first pixel in the high bit, padded with 0 to a byte."""
    return np.packbits(bits, axis=1).tobytes()


def unpack(data: bytes, w: int, h: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8).reshape(h, -1), axis=1, count=w)


def words(bits: np.ndarray) -> np.ndarray:
    """Lines of 32-bit words, first pixel in the high bit, pad bits 0."""
    h, w = bits.shape
    wide = np.zeros((h, -(-w // 32) * 32), np.uint8)
    wide[:, :w] = bits
    return np.packbits(wide, axis=1).view(">u4").astype(np.int64)


def palette_is_gray(cmap: np.ndarray) -> bool:
    return bool((cmap[:, 0] == cmap[:, 1]).all() and (cmap[:, 0] == cmap[:, 2]).all())


def to_gray(colour: np.ndarray) -> np.ndarray:
    """(r + 2 g + b) div 4."""
    c = colour.astype(np.int32)
    return ((c[..., 0] + 2 * c[..., 1] + c[..., 2]) // 4).astype(np.uint8)


def look_up(index: np.ndarray, cmap: np.ndarray) -> np.ndarray:
    """Colours of palette indices; an index the palette lacks is black."""
    table = np.zeros((max(int(index.max(initial=0)) + 1, len(cmap)), 3), np.uint8)
    table[: len(cmap)] = cmap
    return table[index]

"""Reader of the Netpbm family, P1 to P6."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

from .. import schemas

#: Most pixels each way.
MOST = 100_000
#: Bits a sample by the greatest gray value.
DEPTHS = {3: 2, 15: 4, 255: 8, 65535: 16}


class ImageError(Exception):
    """What makes an image unusable; ``code`` is the error column's."""

    def __init__(self, msg: str, code: int = schemas.READ):
        super().__init__(msg)
        self.code = code


@dataclass
class Raster:
    """A decoded image: d is 1, 2, 4, 8, 16 or 32; pixels are (h, w), or (h, w, 3) where d is 32."""

    pixels: np.ndarray
    d: int
    informat: str
    xres: int = 0
    yres: int = 0
    text: str | None = None
    cmap: np.ndarray | None = None
    warnings: list[str] = field(default_factory=list)

    @property
    def h(self) -> int:
        return self.pixels.shape[0]

    @property
    def w(self) -> int:
        return self.pixels.shape[1]


_HEAD = re.compile(rb"P([1-6])((?:[ \t\r\n]*#[^\n]*\n)*)")
_NUMBER = re.compile(rb"[ \t\r\n\v\f]*(\d+)")


def header(data: bytes, compat: bool = False) -> tuple[int, int, int, int, int, list[str]]:
    """Type, width, height, depth, where the raster starts, warnings.

    Comments are taken straight after the magic only. One white space ends a raw header;
    ``compat`` takes all there are.
    """
    m = _HEAD.match(data)
    if not m:
        raise ImageError("not a PNM header", schemas.FORMAT)
    kind, at, numbers, warnings = int(m[1]), m.end(), [], []
    for _ in range(2 if kind in (1, 4) else 3):
        n = _NUMBER.match(data, at)
        if not n:
            raise ImageError("PNM header without its numbers")
        digits = n[1].lstrip(b"0")
        if len(digits) > 9:
            raise ImageError(f"PNM header has a number of {len(digits)} digits")
        numbers.append(int(digits or b"0"))
        at = n.end()
    w, h = numbers[:2]
    if not (0 < w <= MOST and 0 < h <= MOST):
        raise ImageError(f"PNM size {w} x {h} out of range")
    depth = 1
    if kind in (2, 5):
        if numbers[2] not in DEPTHS:
            raise ImageError(f"PNM greatest value {numbers[2]} isn't 3, 15, 255 or 65535")
        depth = DEPTHS[numbers[2]]
    elif kind in (3, 6):
        depth = 32
        if numbers[2] != 255:
            warnings.append(f"PNM greatest value {numbers[2]} isn't 255")
    if kind > 3:
        at = re.compile(rb"[ \t\r\n\v\f]*").match(data, at).end() if compat else at + 1
    return kind, w, h, depth, at, warnings


def decode(data: bytes, compat: bool = False) -> Raster:
    """Decode one file. ``compat`` keeps a truncated raster, filled with 0, and reads 16-bit samples little-endian."""
    kind, w, h, d, at, warnings = header(data, compat)
    return raster(memoryview(data)[at:], kind, w, h, d, compat, warnings)


def raster(body: memoryview, kind: int, w: int, h: int, d: int, compat: bool, warnings: list[str]) -> Raster:
    """The raster of what follows a header."""
    per = 3 if d == 32 else 1
    if kind <= 3:
        flat = _ascii(bytes(body), kind, w * h * per, 65535 if d == 16 else 255 if d == 32 else (1 << d) - 1, compat, warnings)
    elif d == 16:
        flat = np.frombuffer(body[: len(body) // 2 * 2], "<u2" if compat else ">u2")
    else:
        flat = np.frombuffer(body, np.uint8)
    want = h * -(-w // 8) if kind == 4 else w * h * per
    if len(flat) < want:
        if not compat:
            raise ImageError(f"PNM raster has {len(flat)} of {want} values")
        warnings.append("PNM raster is cut short")
        flat = np.concatenate((flat, np.zeros(want - len(flat), flat.dtype)))
    flat = flat[:want]
    if kind == 4:
        pixels = np.unpackbits(flat.reshape(h, -1), axis=1, count=w)
    else:
        pixels = flat.reshape((h, w, 3) if d == 32 else (h, w))
        if d < 8:
            pixels = pixels & ((1 << d) - 1)
    return Raster(np.ascontiguousarray(pixels), d, "pnm", warnings=warnings)


def _ascii(body: bytes, kind: int, want: int, most: int, compat: bool, warnings: list[str]) -> np.ndarray:
    """Samples written as numbers; the digits of P1 may also stand together.

    What is no number, or one above the greatest value, is an error; ``compat`` reads the
    former as 0, so in P1 what isn't 1, and keeps the low bits of the latter.
    """
    if kind == 1:
        found = [bytes([c]) for c in body if c not in b" \t\r\n\v\f"][:want]
    else:
        found = body.split(None, want)[:want]
    values, odd = [], 0
    for token in found:
        right = token.isdigit() and len(token) < 4300 and int(token) <= most
        if not right and not compat:
            raise ImageError(f"PNM sample {token[:12].decode('latin-1')!r} isn't a number up to {most}")
        odd += not right
        values.append(int(token) if right else int(token[-4300:]) & most if token.isdigit() and kind > 1 else 0)
    if odd:
        warnings.append(f"{odd} PNM samples aren't numbers up to {most}")
    return np.array(values, np.uint16 if most > 255 else np.uint8)

"""PNG reader: chunks, inflation, line filters, interlacing, and the reductions to 8 bits without alpha."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .pnm import ImageError, Raster

SIGNATURE = b"\x89PNG\r\n\x1a\n"
MOST = 1_000_000
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First line, line step, first column, column step of the seven interlacing passes.
ADAM7 = ((0, 8, 0, 8), (0, 8, 4, 8), (4, 8, 0, 4), (0, 4, 2, 4), (2, 4, 0, 2), (0, 2, 1, 2), (1, 2, 0, 1))
CRITICAL = {b"IHDR", b"PLTE", b"IDAT", b"IEND"}


def chunks(data: bytes, warnings: list[str]):
    """(name, body) of each chunk up to IEND; a bad CRC ends the image if the chunk is critical, else drops the chunk."""
    if data[:8] != SIGNATURE:
        raise ImageError("PNG signature damaged, as by a text-mode transfer" if data[:4] == SIGNATURE[:4] else "not a PNG file")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ImageError("PNG ends inside a chunk")
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if size >= 1 << 31 or at + 12 + size > len(data):
            raise ImageError("PNG ends inside a chunk")
        good = zlib.crc32(name + body) == struct.unpack_from(">I", data, at + 8 + size)[0]
        at += 12 + size
        if good:
            yield name, body
        elif name[0] & 32 == 0:
            raise ImageError(f"{name.decode('latin-1')}: CRC error")
        else:
            warnings.append(f"{name.decode('latin-1')}: CRC error")
        if name == b"IEND":
            return
    raise ImageError("PNG without IEND")


def check_header(body: bytes) -> tuple[int, int, int, int, int]:
    """Width, height, bit depth, colour type, interlace of IHDR, validated."""
    if len(body) != 13:
        raise ImageError("IHDR of a wrong size")
    w, h, depth, colour, compression, filtering, interlace = struct.unpack(">IIBBBBB", body)
    if not (1 <= w <= MOST and 1 <= h <= MOST):
        raise ImageError(f"PNG size {w} x {h} out of range")
    if depth not in (1, 2, 4, 8, 16) or colour not in CHANNELS:
        raise ImageError(f"PNG bit depth {depth} or colour type {colour} is unknown")
    if colour == 3 and depth > 8 or colour in (2, 4, 6) and depth < 8:
        raise ImageError(f"PNG colour type {colour} doesn't go with bit depth {depth}")
    if compression or filtering or interlace > 1:
        raise ImageError("PNG compression, filter or interlace method is unknown")
    return w, h, depth, colour, interlace


def unfilter(kind: int, line: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    """Undo one line's filter; bytes of the pixel to the left lie ``bpp`` before."""
    if kind == 1:
        out = line.reshape(-1, bpp) if len(line) % bpp == 0 else None
        return np.cumsum(out, 0, dtype=np.uint8).ravel()
    if kind == 2:
        return line + above
    out, up = bytearray(line.tobytes()), above.tolist()
    n = len(out)
    if kind == 3:
        for i in range(n):
            left = out[i - bpp] if i >= bpp else 0
            out[i] = out[i] + (left + up[i] >> 1) & 255
    else:
        for i in range(n):
            left, b = (out[i - bpp], up[i]) if i >= bpp else (0, up[i])
            corner = up[i - bpp] if i >= bpp else 0
            p = left + b - corner
            out[i] = out[i] + min((left, b, corner), key=lambda x: abs(p - x)) & 255
    return np.frombuffer(bytes(out), np.uint8)


def _lines(raw: bytes, at: int, w: int, h: int, bits: int, warnings: list[str]) -> tuple[np.ndarray, int]:
    """The unfiltered bytes of ``h`` lines from ``at`` on, and where they end."""
    size, bpp = -(-w * bits // 8), max(1, bits // 8)
    if at + h * (size + 1) > len(raw):
        raise ImageError("PNG image data ends before the last line")
    table = np.frombuffer(raw, np.uint8, h * (size + 1), at).reshape(h, size + 1)
    out, above = np.empty((h, size), np.uint8), np.zeros(size, np.uint8)
    for y in range(h):
        kind, line = int(table[y, 0]), table[y, 1:]
        if kind > 4:
            warnings.append("line filter of an unknown kind taken as none")
        above = out[y] = line if kind == 0 or kind > 4 else unfilter(kind, line, above, bpp)
    return out, at + h * (size + 1)


def _samples(lines: np.ndarray, w: int, depth: int, channels: int) -> np.ndarray:
    """(h, w, channels) samples of 8 bits at most: of 16 bits the high byte stays."""
    h = len(lines)
    if depth == 16:
        return lines.reshape(h, w, channels, 2)[..., 0]
    if depth == 8:
        return lines.reshape(h, w, channels)
    bits = np.unpackbits(lines, axis=1)[:, : w * depth].reshape(h, w, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[..., None]


def pixels_of(raw: bytes, w: int, h: int, depth: int, colour: int, interlace: int, warnings: list[str]) -> np.ndarray:
    """All samples of inflated image data."""
    channels = CHANNELS[colour]
    if not interlace:
        lines, end = _lines(raw, 0, w, h, depth * channels, warnings)
        out = _samples(lines, w, depth, channels)
    else:
        out, end = np.zeros((h, w, channels), np.uint8), 0
        for y0, dy, x0, dx in ADAM7:
            ph, pw = -(-(h - y0) // dy), -(-(w - x0) // dx)
            if ph > 0 and pw > 0:
                lines, end = _lines(raw, end, pw, ph, depth * channels, warnings)
                out[y0::dy, x0::dx] = _samples(lines, pw, depth, channels)
    if end < len(raw):
        warnings.append("bytes left over behind the last line")
    return out


def raw_size(w: int, h: int, bits: int, interlace: int) -> int:
    """Bytes of inflated image data, a filter byte for each line."""
    if not interlace:
        return h * (-(-w * bits // 8) + 1)
    passes = ((-(-(h - y0) // dy), -(-(w - x0) // dx)) for y0, dy, x0, dx in ADAM7)
    return sum(ph * (-(-pw * bits // 8) + 1) for ph, pw in passes if ph > 0 and pw > 0)


def to_ppi(per_metre: int) -> int:
    """Pixels an inch, rounded."""
    return int(per_metre / 39.37 + 0.5)


def _text(name: bytes, body: bytes) -> str | None:
    """Text of a text chunk, null where it is damaged."""
    try:
        _, rest = body.split(b"\0", 1)
        if name == b"tEXt":
            return rest.decode("latin-1")
        if name == b"zTXt":
            return zlib.decompress(rest[1:]).decode("latin-1")
        packed, (_, _, value) = rest[0], rest[2:].split(b"\0", 2)
        return (zlib.decompress(value) if packed else value).decode()
    except (ValueError, zlib.error, IndexError):
        return None


class File:
    """What the chunks of a file say, taken one after the other."""

    def __init__(self):
        self.head = self.palette = self.text = None
        self.xres = self.yres = 0
        self.begun = self.closed = False
        self.warnings: list[str] = []

    def take(self, name: bytes, part: bytes) -> bytes:
        """Read one chunk; what it holds of the image data."""
        data = b""
        if self.head is None and name != b"IHDR":
            raise ImageError("PNG doesn't begin with its header")
        if name == b"IHDR":
            if self.head is not None:
                raise ImageError("PNG has a second header")
            self.head = check_header(part)
        elif name == b"PLTE":
            self._palette(part)
        elif name == b"IDAT":
            if self.head[3] == 3 and self.palette is None:
                raise ImageError("indexed PNG without a palette")
            if self.closed:
                self.warnings.append("image data behind other chunks not used")
            else:
                data = part
        elif name == b"pHYs" and len(part) == 9:
            x, y, unit = struct.unpack(">IIB", part)
            self.xres, self.yres = (to_ppi(x), to_ppi(y)) if unit == 1 else (0, 0)
        elif name in (b"tEXt", b"zTXt", b"iTXt"):
            self.text = _text(name, part) if self.text is None else self.text
        elif name != b"IEND" and name[0] & 32 == 0:
            raise ImageError(f"unknown critical chunk {name.decode('latin-1')}")
        self.begun = self.begun or bool(data)
        self.closed = self.closed or self.begun and name != b"IDAT"
        return data

    def _palette(self, part: bytes) -> None:
        if self.palette is not None:
            raise ImageError("PNG has two palettes")
        if self.head[3] in (0, 4):
            self.warnings.append("palette of a gray image not used")
        elif self.begun:
            self.warnings.append("palette behind the image data not used")
        elif len(part) % 3 or len(part) > 768:
            if self.head[3] == 3:
                raise ImageError("PNG palette of a wrong size")
            self.warnings.append("palette of a wrong size not used")
        else:
            self.palette = np.frombuffer(part, np.uint8).reshape(-1, 3)

    def raster(self, samples: np.ndarray, compat: bool = False) -> Raster:
        """The raster of all samples, or of some lines of them."""
        _, _, depth, colour, _ = self.head
        if colour in (2, 6):
            return Raster(np.ascontiguousarray(samples[..., :3]), 32, "png", self.xres, self.yres, self.text, None, self.warnings)
        d, one = min(depth, 8), samples[..., 0]
        cmap = self.palette[: 1 << depth] if colour == 3 else None
        if d == 1 and (cmap is None or compat and len(cmap) and cmap[0, 2] == 0):
            one = one ^ 1
        return Raster(np.ascontiguousarray(one), d, "png", self.xres, self.yres, self.text, cmap, self.warnings)


def decode(data: bytes, compat: bool = False) -> Raster:
    """Decode one file: gray as it is (16 bits to 8), colour to r, g, b, alpha dropped, palette kept.

    A bilevel image without palette is inverted, so 1 is black. Where it has a palette the
    indices are kept; ``compat`` inverts them if the first entry has no blue.
    """
    file, body = File(), bytearray()
    for name, part in chunks(data, file.warnings):
        body += file.take(name, part)
    if file.head is None or not body:
        raise ImageError("PNG without image data")
    w, h, depth, colour, interlace = file.head
    try:
        # one byte more than needed tells that there is more, without inflating it
        raw = zlib.decompressobj().decompress(bytes(body), raw_size(w, h, depth * CHANNELS[colour], interlace) + 1)
    except zlib.error as e:
        raise ImageError(f"PNG image data: {e}") from e
    return file.raster(pixels_of(raw, w, h, depth, colour, interlace, file.warnings), compat)

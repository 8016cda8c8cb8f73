"""From a file to its code a few lines at a time, in memory that doesn't grow with the height.

Image data are inflated as far as the next lines need, which are unfiltered over the line
before, reduced to gray, upscaled with the line after and coded under the two bilevel lines
above: what goes from strip to strip is one line of each kind and the coder's registers.
Beside the file and its code nothing of the image is held whole. Interlaced files have
lines of all heights in their first pass, and are decoded whole, as are the text kinds of
PNM.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from ..sources import png, pnm
from ..sources.pnm import ImageError, Raster
from . import container, kernels
from .binarize import Options, bilevel, gray, remove_palette, scaled_resolution
from .coder import Coder, symbols

#: Samples in a strip, and inflated bytes taken at once.
STRIP = 1 << 18


@dataclass
class Page:
    """An encoded page."""

    w: int
    h: int
    xres: int
    yres: int
    code: bytes
    warnings: list[str] = field(default_factory=list)


class Encoder:
    """Codes an image strip by strip."""

    def __init__(self, o: Options):
        self.o, self.coder = o, Coder()
        self.above, self.repeated, self.held, self.h, self.w = None, 0, None, 0, 0
        self.scale, self.warnings = 1, []

    def take(self, strip: Raster) -> None:
        """The next lines, as decoded."""
        r = gray(remove_palette(strip, self.o.compat))
        self.warnings += [x for x in r.warnings[len(strip.warnings) :] if x not in self.warnings]
        if self.o.scale == 1 or r.d != 8:
            self._code(bilevel(r, self.o).pixels)
            return
        # the last line waits for the one below it
        self.scale = self.o.scale
        lines = r.pixels if self.held is None else np.concatenate((self.held, r.pixels))
        if len(lines) > 1:
            self._code(kernels.threshold(kernels.upscale(lines, self.scale)[: -self.scale], self.o.threshold))
        self.held = lines[-1:].copy()

    def _code(self, bits: np.ndarray) -> None:
        ctx, bits_in_order = symbols(bits, self.o.typical, self.above, self.repeated)
        self.coder.feed(ctx, bits_in_order)
        seen = bits if self.above is None else np.concatenate((self.above, bits))
        self.repeated = int(len(seen) > 1 and (seen[-1] == seen[-2]).all())
        self.above = seen[-2:].copy()
        self.h, self.w = self.h + len(bits), bits.shape[1]

    def finish(self, xres: int, yres: int, warnings: list[str]) -> Page:
        if self.held is not None:
            self._code(kernels.threshold(kernels.upscale(self.held, self.scale), self.o.threshold))
        if self.scale > 1:
            both = bool(xres and yres)
            xres, yres = scaled_resolution(xres, self.scale, both), scaled_resolution(yres, self.scale, both)
        code = container.wrap(self.w, self.h, self.o.xres or xres, self.o.yres or yres, self.coder.finish(), self.o.typical, self.o.full)
        return Page(self.w, self.h, xres, yres, code, [*warnings, *self.warnings])


class _Inflated:
    """Lines of a file that isn't interlaced, from its image data as they come."""

    def __init__(self, file: png.File):
        self.w, self.h, self.depth, colour, _ = file.head
        self.file, self.channels = file, png.CHANNELS[colour]
        bits = self.depth * self.channels
        self.size, self.bpp = -(-self.w * bits // 8), max(1, bits // 8)
        self.rows = max(1, STRIP // max(1, self.size))
        self.stream, self.rest, self.above, self.done = zlib.decompressobj(), b"", np.zeros(self.size, np.uint8), 0

    def lines(self, data: bytes) -> Iterator[np.ndarray]:
        """Strips of samples that become whole with ``data``."""
        try:
            while data and not self.stream.eof:
                if self.done == self.h and self.rest:
                    return
                # behind the last line no more is needed than to know that there is more
                want = min(self.rows, self.h - self.done) * (self.size + 1) - len(self.rest)
                self.rest += self.stream.decompress(data, max(1, want))
                data = self.stream.unconsumed_tail
                n = min(len(self.rest) // (self.size + 1), self.h - self.done)
                if n and (n >= self.rows or n == self.h - self.done):
                    yield self._strip(n)
        except zlib.error as e:
            raise ImageError(f"PNG image data: {e}") from e

    def _strip(self, n: int) -> np.ndarray:
        table = np.frombuffer(self.rest, np.uint8, n * (self.size + 1)).reshape(n, self.size + 1)
        out = np.empty((n, self.size), np.uint8)
        for y in range(n):
            kind, line = int(table[y, 0]), table[y, 1:]
            if kind > 4:
                self.file.warnings.append("line filter of an unknown kind taken as none")
            self.above = out[y] = line if kind == 0 or kind > 4 else png.unfilter(kind, line, self.above, self.bpp)
        self.rest, self.done = self.rest[n * (self.size + 1) :], self.done + n
        return png._samples(out, self.w, self.depth, self.channels)

    def end(self) -> Iterator[np.ndarray]:
        """What is left when all data are in."""
        if self.done < self.h and not self.stream.eof:
            self.rest += self.stream.flush()
        n = min(len(self.rest) // (self.size + 1), self.h - self.done)
        if n:
            yield self._strip(n)
        if self.done < self.h:
            raise ImageError("PNG image data ends before the last line")
        if self.rest:
            self.file.warnings.append("bytes left over behind the last line")


def _png(data: bytes, o: Options) -> Page:
    file, encoder, lines, failed = png.File(), Encoder(o), None, None
    for name, part in png.chunks(data, file.warnings):
        found = file.take(name, part)
        if not found or failed:
            continue
        if lines is None:
            if file.head[4]:
                return _whole(png.decode(data, o.compat), o)
            lines = _Inflated(file)
        try:
            for samples in lines.lines(found):
                encoder.take(file.raster(samples, o.compat))
        except ImageError as e:  # a damaged chunk further on is told first
            failed = e
    if lines is None:
        raise ImageError("PNG without image data")
    if failed:
        raise failed
    for samples in lines.end():
        encoder.take(file.raster(samples, o.compat))
    return encoder.finish(file.xres, file.yres, file.warnings)


def _whole(r: Raster, o: Options) -> Page:
    encoder = Encoder(o)
    encoder.take(r)
    return encoder.finish(r.xres, r.yres, r.warnings)


def encode_file(data: bytes, o: Options) -> Page:
    """The page of a PNG or PNM file; an unusable one raises ``ImageError``."""
    if data[:8] == png.SIGNATURE:
        return _png(data, o)
    kind, w, h, d, at, warnings = pnm.header(data, o.compat)
    if kind <= 3 or len(data) - at < h * (-(-w // 8) if kind == 4 else w * (3 if d == 32 else 2 if d == 16 else 1)):
        return _whole(pnm.decode(data, o.compat), o)
    line = -(-w // 8) if kind == 4 else w * (3 if d == 32 else 2 if d == 16 else 1)
    rows, encoder = max(1, STRIP // line), Encoder(o)
    for y in range(0, h, rows):
        n = min(rows, h - y)
        encoder.take(pnm.raster(memoryview(data)[at + y * line : at + (y + n) * line], kind, w, n, d, o.compat, warnings))
    return encoder.finish(0, 0, warnings)

"""From a decoded raster to one bit a pixel: palette removal, gray, upscaling, threshold."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from .. import schemas
from ..sources.pnm import ImageError, Raster
from . import kernels


@dataclass(frozen=True)
class Options:
    """threshold: below it is black (0 to 255); scale: 1, 2 or 4; typical: leave out repeated lines; full: a whole file, else what a PDF embeds; xres, yres: 0 takes the image's; compat: keep the historical readings of palettes and damaged files."""

    threshold: int = 188
    scale: int = 1
    typical: bool = False
    full: bool = True
    xres: int = 0
    yres: int = 0
    compat: bool = False

    def check(self) -> Options:
        if not 0 <= self.threshold <= 255:
            raise ValueError("threshold must be from 0 to 255")
        if self.scale not in (1, 2, 4):
            raise ValueError("scale must be 1, 2 or 4")
        return self


def remove_palette(r: Raster, compat: bool = False) -> Raster:
    """An image without palette as it is; of a gray palette, bilevel or gray; else colour.

    A bilevel gray palette's darker entry becomes 1. ``compat`` keeps the indices, inverted
    if the first entry has no red.
    """
    if r.cmap is None:
        return r
    if not len(r.cmap):
        raise ImageError("palette without entries", schemas.FORMAT)
    if not kernels.palette_is_gray(r.cmap):
        if int(r.pixels.max(initial=0)) >= len(r.cmap):
            r = replace(r, warnings=[*r.warnings, "palette index out of range"])
        return replace(r, pixels=kernels.look_up(r.pixels, r.cmap), d=32, cmap=None)
    if r.d == 1:
        flip = r.cmap[0, 0] == 0 if compat else r.cmap[0, 0] < (r.cmap[1, 0] if len(r.cmap) > 1 else 128)
        return replace(r, pixels=r.pixels ^ 1 if flip else r.pixels, cmap=None)
    return replace(r, pixels=kernels.to_gray(kernels.look_up(r.pixels, r.cmap)), d=8, cmap=None)


def gray(r: Raster) -> Raster:
    """Green of a colour image; images of 8 bits or less as they are."""
    if r.d <= 8:
        return r
    if r.d != 32:
        raise ImageError(f"{r.d} bits a pixel can't become gray", schemas.FORMAT)
    return replace(r, pixels=r.pixels[..., 1], d=8)


def scaled_resolution(ppi: int, factor: float, both: bool = True) -> int:
    return int(ppi * factor + 0.5) if both else ppi


def bilevel(r: Raster, o: Options) -> Raster:
    """One bit a pixel; a bilevel image as it is, at its own size."""
    if r.d == 1:
        return r
    if o.scale > 1:
        if r.d != 8:
            raise ImageError(f"{r.d} bits a pixel can't be upscaled", schemas.DEPTH)
        both = bool(r.xres and r.yres)
        return replace(r, pixels=kernels.threshold(kernels.upscale(r.pixels, o.scale), o.threshold), d=1, xres=scaled_resolution(r.xres, o.scale, both), yres=scaled_resolution(r.yres, o.scale, both))
    if r.d not in (4, 8) or o.threshold > (16 if r.d == 4 else 256):
        raise ImageError(f"{r.d} bits a pixel can't be cut at {o.threshold}", schemas.DEPTH)
    return replace(r, pixels=kernels.threshold(r.pixels, o.threshold), d=1)


def binarize(r: Raster, o: Options) -> Raster:
    return bilevel(gray(remove_palette(r, o.compat)), o)

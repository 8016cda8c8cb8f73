"""Segments and files of ITU-T T.88: one page with one lossless generic region."""

import struct

import numpy as np

from .coder import encode_bilevel

# Fixed values of the format.
MAGIC = bytes.fromhex("974A42320D0A1A0A")
PAGE_INFO, GENERIC_REGION, END_OF_PAGE, END_OF_FILE = 48, 38, 49, 51
ADAPTIVE = (3, -1, -3, -1, 2, -2, -2, -2)


def segment(number: int, kind: int, body: bytes, page: int = 1) -> bytes:
    return struct.pack(">IBBBI", number, kind, 0, page, len(body)) + body


def page_info(w: int, h: int, xres: int, yres: int) -> bytes:
    """Page information: size, resolution as given, lossless, not striped."""
    return struct.pack(">IIIIBH", w, h, xres, yres, 1, 0)


def generic_region(w: int, h: int, code: bytes, typical: bool) -> bytes:
    return struct.pack(">IIIIBB8b", w, h, 0, 0, 0, 8 if typical else 0, *ADAPTIVE) + code


def wrap(w: int, h: int, xres: int, yres: int, code: bytes, typical: bool, full: bool) -> bytes:
    """A whole file, or (``full`` false) the two segments that a PDF embeds."""
    body = segment(0, PAGE_INFO, page_info(w, h, xres, yres)) + segment(1, GENERIC_REGION, generic_region(w, h, code, typical))
    if not full:
        return body
    return MAGIC + struct.pack(">BI", 1, 1) + body + segment(2, END_OF_PAGE, b"") + segment(3, END_OF_FILE, b"")


def encode_image(bits: np.ndarray, xres: int = 0, yres: int = 0, typical: bool = False, full: bool = True) -> bytes:
    h, w = bits.shape
    return wrap(w, h, xres, yres, encode_bilevel(bits, typical), typical, full)

"""Adaptive binary arithmetic coder of ITU-T T.88 annex E, one image a call.

The coder is sequential by nature; images are the unit of parallelism. Contexts come
from numpy beforehand, so the loop does nothing but code.
"""

import numpy as np

from . import kernels

# Table E.1 of ITU-T T.88: Qe, next state after MPS, after LPS, and whether LPS switches the sense.
STATES = (
    (0x5601, 1, 1, 1),
    (0x3401, 2, 6, 0),
    (0x1801, 3, 9, 0),
    (0x0AC1, 4, 12, 0),
    (0x0521, 5, 29, 0),
    (0x0221, 38, 33, 0),
    (0x5601, 7, 6, 1),
    (0x5401, 8, 14, 0),
    (0x4801, 9, 14, 0),
    (0x3801, 10, 14, 0),
    (0x3001, 11, 17, 0),
    (0x2401, 12, 18, 0),
    (0x1C01, 13, 20, 0),
    (0x1601, 29, 21, 0),
    (0x5601, 15, 14, 1),
    (0x5401, 16, 14, 0),
    (0x5101, 17, 15, 0),
    (0x4801, 18, 16, 0),
    (0x3801, 19, 17, 0),
    (0x3401, 20, 18, 0),
    (0x3001, 21, 19, 0),
    (0x2801, 22, 19, 0),
    (0x2401, 23, 20, 0),
    (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0),
    (0x1801, 26, 23, 0),
    (0x1601, 27, 24, 0),
    (0x1401, 28, 25, 0),
    (0x1201, 29, 26, 0),
    (0x1101, 30, 27, 0),
    (0x0AC1, 31, 28, 0),
    (0x09C1, 32, 29, 0),
    (0x08A1, 33, 30, 0),
    (0x0521, 34, 31, 0),
    (0x0441, 35, 32, 0),
    (0x02A1, 36, 33, 0),
    (0x0221, 37, 34, 0),
    (0x0141, 38, 35, 0),
    (0x0111, 39, 36, 0),
    (0x0085, 40, 37, 0),
    (0x0049, 41, 38, 0),
    (0x0025, 42, 39, 0),
    (0x0015, 43, 40, 0),
    (0x0009, 44, 41, 0),
    (0x0005, 45, 42, 0),
    (0x0001, 45, 43, 0),
)

#: Context of the line-repeats decision.
TYPICAL = 0x9B25

# a state's number here is 2 * its row + the likely bit
_QE = [q for q, _, _, _ in STATES for _ in (0, 1)]
_LIKELY = [2 * m + bit for _, m, _, _ in STATES for bit in (0, 1)]
_UNLIKELY = [2 * n + (bit ^ s) for _, _, n, s in STATES for bit in (0, 1)]


class Output:
    """Collects bytes; a carry goes into the last one, and after ff only seven bits follow."""

    def __init__(self):
        self.done, self.last = bytearray(), None

    def push(self, c: int) -> tuple[int, int]:
        """Take a byte off the top of the code register; what is left of it, and how many shifts fill the next."""
        if self.last is not None and self.last != 0xFF and c >> 27:
            self.last += 1
            c &= 0x7FFFFFF
        stuffed = self.last == 0xFF
        if self.last is not None:
            self.done.append(self.last)
        shift = 20 if stuffed else 19
        self.last = c >> shift & 0xFF
        return c & ((1 << shift) - 1), 7 if stuffed else 8


class Coder:
    """Codes an image piece by piece; all contexts start in state 0 with 0 likely."""

    def __init__(self):
        self.state, self.out = [0] * (1 << 16), Output()
        self.a, self.c, self.room = 0x8000, 0, 12

    def feed(self, contexts: np.ndarray, bits: np.ndarray) -> None:
        """Code ``bits`` under their ``contexts``."""
        state, out, a, c, room = self.state, self.out, self.a, self.c, self.room
        qes, likely, unlikely = _QE, _LIKELY, _UNLIKELY
        for ctx, bit in zip(contexts.tolist(), bits.tolist(), strict=True):
            s = state[ctx]
            qe = qes[s]
            a -= qe
            if bit == s & 1:
                if a & 0x8000:
                    c += qe
                    continue
                if a < qe:
                    a = qe
                else:
                    c += qe
                state[ctx] = likely[s]
            else:
                if a < qe:
                    c += qe
                else:
                    a = qe
                state[ctx] = unlikely[s]
            shifts = 16 - a.bit_length()
            a <<= shifts
            while shifts >= room:
                c <<= room
                shifts -= room
                c, room = out.push(c)
            c <<= shifts
            room -= shifts
        self.a, self.c, self.room = a, c, room

    def finish(self) -> bytes:
        """The code, which ends in ff ac."""
        out, c, room = self.out, self.c, self.room
        top = c + self.a
        c |= 0xFFFF
        if c >= top:
            c -= 0x8000
        for _ in range(2):
            c, room = out.push(c << room)
        tail = b"\xac" if out.last == 0xFF else b"\xff\xac"
        return bytes(out.done) + bytes([out.last]) + tail


def encode(contexts: np.ndarray, bits: np.ndarray) -> bytes:
    """The code of a whole image's ``bits`` under their ``contexts``."""
    coder = Coder()
    coder.feed(contexts, bits)
    return coder.finish()


def symbols(bits: np.ndarray, typical: bool = False, above: np.ndarray | None = None, repeated: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and bits in coding order; with ``typical``, a decision before each line, and repeated lines left out.

    ``above`` are the lines before these, two at most, and ``repeated`` whether the last of
    them repeats the one before it.
    """
    n = 0 if above is None else len(above)
    whole = bits if not n else np.concatenate((above, bits))
    ctx = kernels.contexts(whole)[n:]
    if not typical:
        return ctx.ravel(), bits.ravel()
    same = kernels.typical(whole)[n:]
    change = same ^ np.concatenate((np.array([repeated], np.uint8), same[:-1]))
    ctx = np.column_stack((np.full(len(bits), TYPICAL, np.uint16), ctx))
    coded = np.column_stack((change, bits))
    keep = np.ones(coded.shape, bool)
    keep[same == 1, 1:] = False
    return ctx[keep], coded[keep]


def encode_bilevel(bits: np.ndarray, typical: bool = False) -> bytes:
    """The arithmetic code of a bilevel raster."""
    return encode(*symbols(bits, typical))

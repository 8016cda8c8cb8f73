"""A decoder of T.88 generic regions for round trips, written from the standard's decoding flowcharts."""

import struct

import numpy as np

from rasterloom.operators.coder import STATES, TYPICAL
from rasterloom.operators.kernels import NEIGHBOURS


class Decoder:
    def __init__(self, data: bytes):
        self.data, self.at = data + b"\xff\xac", 0
        self.index, self.mps = [0] * 65536, [0] * 65536
        self.c = self.data[0] << 16
        self.bytein()
        self.c <<= 7
        self.ct -= 7
        self.a = 0x8000

    def bytein(self):
        if self.data[self.at] == 0xFF:
            if self.data[self.at + 1] > 0x8F:
                self.c += 0xFF00
                self.ct = 8
            else:
                self.at += 1
                self.c += self.data[self.at] << 9
                self.ct = 7
        else:
            self.at += 1
            self.c += self.data[self.at] << 8
            self.ct = 8

    def bit(self, cx: int) -> int:
        qe, nmps, nlps, switch = STATES[self.index[cx]]
        self.a -= qe
        if self.c >> 16 < qe:
            if self.a < qe:
                d, self.index[cx] = self.mps[cx], nmps
            else:
                d = 1 - self.mps[cx]
                self.mps[cx] ^= switch
                self.index[cx] = nlps
            self.a = qe
        else:
            self.c -= qe << 16
            if self.a & 0x8000:
                return self.mps[cx]
            if self.a < qe:
                d = 1 - self.mps[cx]
                self.mps[cx] ^= switch
                self.index[cx] = nlps
            else:
                d, self.index[cx] = self.mps[cx], nmps
        while not self.a & 0x8000:
            if self.ct == 0:
                self.bytein()
            self.a <<= 1
            self.c = self.c << 1 & 0xFFFFFFFF
            self.ct -= 1
        return d


def decode_region(code: bytes, w: int, h: int, typical: bool) -> np.ndarray:
    out, dec, ltp = np.zeros((h, w), np.uint8), Decoder(code), 0
    for y in range(h):
        if typical:
            ltp ^= dec.bit(TYPICAL)
            if ltp:
                out[y] = out[y - 1] if y else 0
                continue
        for x in range(w):
            cx = 0
            for dy, dx in NEIGHBOURS:
                inside = 0 <= y + dy and 0 <= x + dx < w
                cx = cx << 1 | (int(out[y + dy, x + dx]) if inside else 0)
            out[y, x] = dec.bit(cx)
    return out


def segments(data: bytes):
    """(number, type, page, body) of each segment."""
    at = 0
    while at < len(data):
        number, kind, _, page, size = struct.unpack_from(">IBBBI", data, at)
        yield number, kind, page, data[at + 11 : at + 11 + size]
        at += 11 + size


def decode_file(data: bytes) -> np.ndarray:
    if data[:8] == bytes.fromhex("974A42320D0A1A0A"):
        data = data[13:]
    body = next(b for _, kind, _, b in segments(data) if kind == 38)
    w, h = struct.unpack_from(">II", body)
    return decode_region(body[26:], w, h, bool(body[17] & 8))

import struct
import zlib

import numpy as np
import pytest
from make import chunk, pbm, pgm, png

from rasterloom import schemas
from rasterloom.operators.binarize import Options, binarize, remove_palette
from rasterloom.sources import pnm
from rasterloom.sources import png as png_reader
from rasterloom.sources.images import decode
from rasterloom.sources.pnm import ImageError
from rasterloom.sources.sniff import sniff_bytes

RNG = np.random.default_rng(5)


@pytest.mark.parametrize("w", [1, 8, 9, 31, 32, 33, 65])
def test_pbm(w):
    bits = RNG.integers(0, 2, (3, w)).astype(np.uint8)
    assert (pnm.decode(pbm(bits)).pixels == bits).all()
    text = b"P1\n# a comment\n%d 3\n" % w + b"\n".join(b" ".join(b"%d" % v for v in line) for line in bits)
    assert (pnm.decode(text).pixels == bits).all()
    assert (pnm.decode(text.replace(b" ", b"", 0)).pixels == bits).all()
    joined = b"P1\n%d 3\n" % w + b"\n".join(b"".join(b"%d" % v for v in line) for line in bits)
    assert (pnm.decode(joined).pixels == bits).all()


@pytest.mark.parametrize("t", [0, 1, 188, 255])
def test_pgm_threshold(t):
    gray = np.arange(256, dtype=np.uint8).reshape(16, 16)
    assert (binarize(pnm.decode(pgm(gray)), Options(threshold=t)).pixels == (gray < t)).all()


def test_pnm_depths():
    assert pnm.decode(pgm(np.zeros((2, 6), np.uint8), 3)).d == 2
    assert pnm.decode(pgm(np.zeros((2, 6), np.uint8), 15)).d == 4
    wide = pnm.decode(b"P5\n2 1\n65535\n\x01\x02\x03\x04")
    assert wide.d == 16 and wide.pixels.tolist() == [[258, 772]]
    assert pnm.decode(b"P5\n2 1\n65535\n\x01\x02\x03\x04", compat=True).pixels.tolist() == [[513, 1027]]
    for image in (pnm.decode(pgm(np.zeros((2, 6), np.uint8), 3)), pnm.decode(pgm(np.zeros((2, 6), np.uint8), 15)), wide):
        with pytest.raises(ImageError):
            binarize(image, Options())
    assert binarize(pnm.decode(pgm(np.array([[3, 9]], np.uint8), 15)), Options(threshold=8)).pixels.tolist() == [[1, 0]]
    with pytest.raises(ImageError):
        pnm.decode(pgm(np.zeros((2, 6), np.uint8), 100))


def test_ppm_is_judged_by_green():
    rgb = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255]]], np.uint8)
    for data in (b"P6\n4 1\n255\n" + rgb.tobytes(), b"P3\n4 1\n255\n" + b" ".join(b"%d" % v for v in rgb.ravel())):
        assert binarize(pnm.decode(data), Options()).pixels.tolist() == [[1, 0, 1, 0]]
    assert pnm.decode(b"P6\n1 1\n200\n\x01\x02\x03").warnings


def test_pnm_quirks():
    white_first = b"P5\n2 2\n255\n\x0a\x20\x30\x40"
    assert pnm.decode(white_first).pixels.tolist() == [[10, 32], [48, 64]]
    assert pnm.decode(white_first, compat=True).pixels.tolist() == [[48, 64], [0, 0]]
    with pytest.raises(ImageError):
        pnm.decode(b"P5\n2 2\n255\n\x01")
    cut = pnm.decode(b"P5\n2 2\n255\n\x01", compat=True)
    assert cut.pixels.tolist() == [[1, 0], [0, 0]] and cut.warnings
    assert pnm.decode(b"P5\n# one\n# two\n1 1\n255\nA").pixels.tolist() == [[65]]
    with pytest.raises(ImageError):
        pnm.decode(b"P5\n1 1\n# late\n255\nA")
    with pytest.raises(ImageError):
        pnm.decode(b"P5\n0 1\n255\n")
    with pytest.raises(ImageError) as e:
        decode(b"P4\n1 1\n\x80")
    assert e.value.code == schemas.FORMAT


CASES = [(1, 0, 1), (2, 0, 1), (4, 0, 1), (8, 0, 1), (16, 0, 1), (8, 2, 3), (16, 2, 3), (8, 4, 2), (16, 4, 2), (8, 6, 4), (16, 6, 4)]


@pytest.mark.parametrize("depth,colour,channels", CASES)
@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4)])
def test_png_depths_and_filters(depth, colour, channels, filters):
    s = RNG.integers(0, 1 << depth, (7, 11, channels))
    got = png_reader.decode(png(s, depth, colour, filters))
    want = s >> 8 if depth == 16 else s
    want = want[..., :3] if channels >= 3 else want[..., 0]
    assert (got.pixels == (want ^ 1 if depth == 1 else want)).all()
    assert got.d == (32 if channels >= 3 else min(depth, 8))


@pytest.mark.parametrize("size", [(1, 1), (3, 5), (8, 8), (9, 9), (1, 6)])
@pytest.mark.parametrize("depth,colour,channels", CASES)
def test_png_interlaced(size, depth, colour, channels):
    s = RNG.integers(0, 1 << depth, (*size, channels))
    assert (png_reader.decode(png(s, depth, colour, (0, 4), True)).pixels == png_reader.decode(png(s, depth, colour)).pixels).all()


def test_png_chunks():
    s = RNG.integers(0, 256, (20, 20, 1))
    base = png(s, 8, 0)
    assert (png_reader.decode(png(s, 8, 0, idats=7)).pixels == s[..., 0]).all()
    extra = chunk(b"tEXt", b"Title\0caf\xe9") + chunk(b"tEXt", b"Other\0x") + chunk(b"pHYs", struct.pack(">IIB", 11811, 11811, 1)) + chunk(b"gAMA", b"\0\0\xb1\x8f")
    got = png_reader.decode(png(s, 8, 0, extra=extra))
    assert (got.text, got.xres, got.yres) == ("café", 300, 300)
    assert png_reader.decode(png(s, 8, 0, extra=chunk(b"pHYs", struct.pack(">IIB", 11811, 11811, 0)))).xres == 0
    assert png_reader.decode(png(s, 8, 0, extra=chunk(b"zTXt", b"k\0\0" + zlib.compress(b"packed")))).text == "packed"
    dropped = png_reader.decode(png(s, 8, 0, extra=chunk(b"tEXt", b"a\0b", bad_crc=True)))
    assert dropped.text is None and dropped.warnings == ["tEXt: CRC error"]
    for bad in (base[:29] + b"\xff" + base[30:], base[:60], base[:-12], base.replace(b"IHDR", b"IHDX"), base.replace(b"\r\n\x1a\n", b"\n\x1a\n\n")):
        with pytest.raises(ImageError):
            png_reader.decode(bad)
    assert "bytes left over behind the last line" in png_reader.decode(png(s, 8, 0, tail=b"abc")).warnings
    with pytest.raises(ImageError, match="before the last line"):
        png_reader.decode(png(s, 8, 0).replace(struct.pack(">II", 20, 20), struct.pack(">II", 20, 21)).replace(base[29:33], struct.pack(">I", zlib.crc32(b"IHDR" + struct.pack(">IIBBBBB", 20, 21, 8, 0, 0, 0, 0)))))
    odd = png_reader.decode(png(s, 8, 0, filters=(9,)))
    assert (odd.pixels == s[..., 0]).all() and odd.warnings


@pytest.mark.parametrize("w,h,depth,colour", [(0, 1, 8, 0), (1, 0, 8, 0), (1_000_001, 1, 8, 0), (1, 1, 3, 0), (1, 1, 16, 3), (1, 1, 4, 2), (1, 1, 8, 5)])
def test_png_headers(w, h, depth, colour):
    with pytest.raises(ImageError):
        png_reader.check_header(struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0))


def test_palettes():
    idx = RNG.integers(0, 2, (6, 9, 1))
    twin = binarize(png_reader.decode(png(idx, 1, 0)), Options()).pixels
    black_white, white_black = bytes([0, 0, 0, 255, 255, 255]), bytes([255, 255, 255, 0, 0, 0])
    assert (binarize(png_reader.decode(png(idx, 1, 3, palette=black_white)), Options()).pixels == twin).all()
    assert (binarize(png_reader.decode(png(idx ^ 1, 1, 3, palette=white_black)), Options()).pixels == twin).all()
    compat = Options(compat=True)
    assert (binarize(png_reader.decode(png(idx, 1, 3, palette=black_white), True), compat).pixels == twin ^ 1).all()
    red = png_reader.decode(png(idx, 1, 3, palette=bytes([0, 0, 0, 255, 0, 0])))
    assert (remove_palette(red).pixels[..., 0] == idx[..., 0] * 255).all()
    swapped = png_reader.decode(png(idx, 1, 3, palette=bytes([0, 0, 0, 255, 0, 0])), True)
    assert (remove_palette(swapped, True).pixels[..., 0] == (1 - idx[..., 0]) * 255).all()
    for depth in (2, 4, 8):
        s = RNG.integers(0, 1 << depth, (5, 7, 1))
        grays = np.repeat(np.arange(1 << depth, dtype=np.uint8)[:, None], 3, 1)
        got = remove_palette(png_reader.decode(png(s, depth, 3, palette=grays.tobytes())))
        assert got.d == 8 and (got.pixels == s[..., 0]).all()
        colours = RNG.integers(0, 256, (1 << depth, 3)).astype(np.uint8)
        got = remove_palette(png_reader.decode(png(s, depth, 3, palette=colours.tobytes())))
        assert got.d == 32 and (got.pixels == colours[s[..., 0]]).all()
    short = remove_palette(png_reader.decode(png(np.array([[[0], [3]]]), 2, 3, palette=bytes([9, 8, 7]))))
    assert short.pixels.tolist() == [[[9, 8, 7], [0, 0, 0]]] and short.warnings


def test_upscaling_options():
    gray = RNG.integers(0, 256, (5, 6, 1))
    image = png_reader.decode(png(gray, 8, 0, extra=chunk(b"pHYs", struct.pack(">IIB", 11811, 11811, 1))))
    out = binarize(image, Options(scale=4))
    assert out.pixels.shape == (20, 24) and out.xres == 1200
    with pytest.raises(ImageError):
        binarize(png_reader.decode(png(RNG.integers(0, 4, (3, 3, 1)), 2, 0)), Options(scale=2))
    for bad in (Options(threshold=256), Options(threshold=-1), Options(scale=3)):
        with pytest.raises(ValueError):
            bad.check()


def test_sniff():
    pad = b"\0" * 12
    for head, kind in ((b"BM", "bmp"), (b"II*\0", "tiff"), (b"MM", "tiff"), (b"P6", "pnm"), (b"\xff\xd8", "jpeg"), (b"GIF89a", "gif"), (b"spix", "spix"), (b"RIFF1234WEBP", "webp"), (bytes.fromhex("0000000C6A5020200D0A870A"), "jp2"), (b"\0", None), (b"P7", None)):
        assert sniff_bytes(head + pad) == kind
    assert sniff_bytes(b"P5\n1 1\n255") is None
    for head in (b"BM", b"GIF89a", b"\xff\xd8"):
        with pytest.raises(ImageError) as e:
            decode(head + pad)
        assert e.value.code == schemas.READ

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from t88 import decode_file, segments

from rasterloom.operators import coder, container, kernels


def test_published_sequence():
    """The test sequence of T.88 annex H.2."""
    source = bytes.fromhex("00020051000000C0035287 2AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF")
    bits = np.unpackbits(np.frombuffer(source, np.uint8))
    want = "84c73bfce1a1430402200000410dbb86f4317fff88ff37471adb6adfffac"
    assert coder.encode(np.zeros(len(bits), np.uint16), bits).hex() == want


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 70), st.integers(1, 12), st.integers(0, 2**32 - 1), st.sampled_from([0.02, 0.3, 0.5]), st.booleans(), st.booleans())
def test_round_trip(w, h, seed, ink, typical, full):
    bits = (np.random.default_rng(seed).random((h, w)) < ink).astype(np.uint8)
    bits[h // 2 :] = bits[h // 2]
    assert (decode_file(container.encode_image(bits, 0, 0, typical, full)) == bits).all()


def test_large_noise():
    bits = (np.random.default_rng(1).random((500, 600)) < 0.5).astype(np.uint8)
    code = container.encode_image(bits)
    assert len(code) > 20 * 1024
    assert (decode_file(code) == bits).all()


def test_repeated_lines_cost_less():
    bits = np.tile((np.random.default_rng(2).random((1, 400)) < 0.5).astype(np.uint8), (100, 1))
    assert len(coder.symbols(bits, True)[0]) == 100 + 400
    assert len(coder.symbols(bits, False)[0]) == 40_000


@pytest.mark.parametrize("typical", [False, True])
def test_layout(typical):
    bits = np.eye(9, dtype=np.uint8)
    code = coder.encode_bilevel(bits, typical)
    assert code.endswith(b"\xff\xac")
    full, part = container.encode_image(bits, 300, 200, typical), container.encode_image(bits, 300, 200, typical, full=False)
    assert (len(full), len(part)) == (102 + len(code), 67 + len(code))
    assert full[:13].hex() == "974a42320d0a1a0a0100000001"
    assert full[13 : 13 + len(part)] == part
    page, region = list(segments(part))
    assert page[:3] == (0, 48, 1) and struct.unpack(">IIIIBH", page[3]) == (9, 9, 300, 200, 1, 0)
    assert region[:3] == (1, 38, 1) and region[3][:26] == struct.pack(">IIIIBB", 9, 9, 0, 0, 0, 8 * typical) + bytes.fromhex("03fffdff02fefefe")
    assert [s[:3] for s in segments(full[13 + len(part) :])] == [(2, 49, 1), (3, 51, 1)]


@given(st.integers(1, 66), st.integers(1, 5), st.integers(0, 1000))
@settings(max_examples=40, deadline=None)
def test_contexts_by_definition(w, h, seed):
    bits = (np.random.default_rng(seed).random((h, w)) < 0.5).astype(np.uint8)
    at = lambda y, x: int(bits[y, x]) if 0 <= y and 0 <= x < w else 0
    want = [[sum(at(y - 2, x + k) << 13 - k for k in range(-2, 3)) + sum(at(y - 1, x + k) << 7 - k for k in range(-3, 4)) + sum(at(y, x - k) << k - 1 for k in range(1, 5)) for x in range(w)] for y in range(h)]
    assert (kernels.contexts(bits) == np.array(want)).all()

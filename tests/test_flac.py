"""FLAC, against frames that a small encoder of the tests writes."""

import numpy as np
import pytest

from voxloom.errors import EngineError
from voxloom.sources.flac import decode_flac


def bits(value, n):
    return f"{value & (1 << n) - 1:0{n}b}" if n else ""


def rice(residual, k):
    out = []
    for e in residual:
        x = e * 2 if e >= 0 else -2 * e - 1
        out.append("0" * (x >> k) + "1" + bits(x, k))
    return "".join(out)


def residual_part(residual, order, block, wide, parts, escape):
    out, at = bits(int(wide), 2) + bits(parts.bit_length() - 1, 4), 0
    for p in range(parts):
        n = block // parts - (order if p == 0 else 0)
        part = residual[at : at + n]
        at += n
        if escape and p == parts - 1:
            out += bits(31 if wide else 15, 5 if wide else 4) + bits(20, 5) + "".join(bits(e, 20) for e in part)
        else:
            k = max(0, int(np.log2(np.abs(part).mean() + 1)))
            out += bits(k, 5 if wide else 4) + rice(part, k)
    return out


def subframe(x, kind, size, wasted=0, wide=False, parts=1, escape=False):
    x = [int(v) >> wasted for v in x]
    head = {"constant": 0, "verbatim": 1}.get(kind[0])
    if head is None:
        head = 8 + kind[1] if kind[0] == "fixed" else 31 + len(kind[1])
    out = "0" + bits(head, 6) + ("1" + "0" * (wasted - 1) + "1" if wasted else "0")
    size -= wasted
    if kind[0] == "constant":
        return out + bits(x[0], size)
    if kind[0] == "verbatim":
        return out + "".join(bits(v, size) for v in x)
    if kind[0] == "fixed":
        order, r = kind[1], np.array(x)
        for _ in range(order):
            r = np.diff(r)
        return out + "".join(bits(v, size) for v in x[:order]) + residual_part([int(v) for v in r], order, len(x), wide, parts, escape)
    weights, shift = kind[1], 10
    order = len(weights)
    r = [x[i] - (sum(w * x[i - 1 - j] for j, w in enumerate(weights)) >> shift) for i in range(order, len(x))]
    return out + "".join(bits(v, size) for v in x[:order]) + bits(12 - 1, 4) + bits(shift, 5) + "".join(bits(w, 12) for w in weights) + residual_part(r, order, len(x), wide, parts, escape)


def pack(text):
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def flac(blocks, rate=16_000, size=16, channels=1, mode=None):
    """``blocks``: lists of subframes' texts and the block's length."""
    info = (4096).to_bytes(2, "big") * 2 + bytes(6) + pack(bits(rate, 20) + bits(channels - 1, 3) + bits(size - 1, 5) + bits(0, 36)) + bytes(16)
    out = b"fLaC" + b"\x04" + (5).to_bytes(3, "big") + b"other" + b"\x80" + len(info).to_bytes(3, "big") + info
    for k, (subs, n) in enumerate(blocks):
        head = bits(0x7FFC, 15) + "0" + bits(7, 4) + bits(0, 4) + bits(channels - 1 if mode is None else mode, 4) + bits(0, 3) + "0"
        number = bits(k, 8) if k < 128 else bits(0xC0 | k >> 6, 8) + bits(0x80 | k & 63, 8)
        out += pack(head + number + bits(n - 1, 16) + bits(0, 8) + "".join(subs)) + b"\0\0"
    return out


def sound(n, amplitude=8000, seed=0):
    rng = np.random.default_rng(seed)
    return (amplitude * np.sin(np.arange(n) / 9) + rng.integers(-40, 40, n)).astype(np.int64)


KINDS = [("verbatim",), *[("fixed", k) for k in range(5)], ("lpc", [1800, -900]), ("lpc", [900, 100, -50, 20, 5])]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("how", [{}, {"wide": True, "parts": 4}, {"parts": 2, "escape": True}, {"wasted": 3}])
def test_each_prediction(kind, how):
    x = sound(512) // 8 * 8
    y, rate, channels = decode_flac(flac([([subframe(x, kind, 16, **how)], 512)] * 130))
    assert (rate, channels) == (16_000, 1) and np.array_equal(np.rint(y * 32768), np.tile(x, 130))


@pytest.mark.parametrize("mode", [None, 8, 9, 10])
@pytest.mark.parametrize("size", [8, 16, 24])
def test_stereo(mode, size):
    a, b = (sound(256, (1 << size - 1) // 3, s) for s in (1, 2))
    pairs = {None: (a, b, 0, 0), 8: (a, a - b, 0, 1), 9: (a - b, b, 1, 0), 10: (a + b >> 1, a - b, 0, 1)}
    p, q, ep, eq = pairs[mode]
    data = flac([([subframe(p, ("fixed", 2), size + ep), subframe(q, ("verbatim",), size + eq)], 256)], size=size, channels=2, mode=mode)
    y, _, channels = decode_flac(data)
    assert channels == 2 and np.allclose(y, (a + b) / 2 / (1 << size - 1), atol=1e-6)


def test_constant_damage_and_errors():
    x = sound(300)
    good = ([subframe(x, ("fixed", 1), 16)], 300)
    data = flac([([subframe([77] * 64, ("constant",), 16)], 64), good])
    assert len(decode_flac(data)[0]) == 364
    torn = data[:60] + b"\xff\xf8garbage" + data[60:]
    assert len(decode_flac(torn)[0]) >= 300
    assert len(decode_flac(b"ID3\x04\0\0\0\0\0\x05tag..." [:15] + data)[0]) == 364
    for bad in (b"", b"fLaC", data[:50], b"RIFF" * 20):
        with pytest.raises(EngineError) as e:
            decode_flac(bad)
        assert e.value.code == 10

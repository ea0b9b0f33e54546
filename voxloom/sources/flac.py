"""FLAC (RFC 9639), decoded frame by frame in Python.

Slow beside a native decoder (about a microsecond a sample and channel), but complete: constant, verbatim, fixed and
linear prediction, both Rice codings, all stereo decorrelations, any sample size. Checksums are not verified; a frame
that can't be read ends its packet and the next sync code is sought, as a damaged packet is skipped elsewhere."""

from __future__ import annotations

import numpy as np

from ..errors import EngineError
from ..functions.signal import MAX_SAMPLES, Resampler, downmix

#: Fixed values of the format: rates and sample sizes by their codes in a frame header.
RATES = (0, 88_200, 176_400, 192_000, 8000, 16_000, 22_050, 24_000, 32_000, 44_100, 48_000, 96_000)
SIZES = (0, 8, 12, 0, 16, 20, 24, 32)


class _Damaged(Exception):
    pass


class _Bits:
    """Bits of a stretch of bytes as text: finding the next 1 and reading numbers then run at the speed of ``str``."""

    def __init__(self, data: bytes):
        self.text, self.at = f"{int.from_bytes(data, 'big'):0{8 * len(data)}b}" if data else "", 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.text):
            raise _Damaged
        self.at += n
        return int(self.text[self.at - n : self.at], 2) if n else 0

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> n - 1 else x

    def unary(self) -> int:
        end = self.text.find("1", self.at)
        if end < 0:
            raise _Damaged
        n, self.at = end - self.at, end + 1
        return n

    def rice(self, n: int, k: int) -> list[int]:
        text, at, out = self.text, self.at, []
        for _ in range(n):
            end = text.find("1", at)
            if end < 0 or end + 1 + k > len(text):
                raise _Damaged
            x = (end - at << k) | (int(text[end + 1 : end + 1 + k], 2) if k else 0)
            out.append(x >> 1 ^ -(x & 1))
            at = end + 1 + k
        self.at = at
        return out


def _residual(bits: _Bits, block: int, order: int) -> list[int]:
    wide, parts = bits.take(2), 1 << bits.take(4)
    if wide > 1 or block % parts:
        raise _Damaged
    out: list[int] = []
    for p in range(parts):
        n = block // parts - (order if p == 0 else 0)
        k = bits.take(5 if wide else 4)
        if n < 0:
            raise _Damaged
        if k == (31 if wide else 15):
            size = bits.take(5)
            out += [bits.signed(size) for _ in range(n)]
        else:
            out += bits.rice(n, k)
    return out


def _subframe(bits: _Bits, block: int, size: int) -> np.ndarray:
    if bits.take(1):
        raise _Damaged
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    size -= wasted
    if kind == 0:
        x = np.full(block, bits.signed(size), np.int64)
    elif kind == 1:
        x = np.array([bits.signed(size) for _ in range(block)], np.int64)
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        if order > block:
            raise _Damaged
        first = [bits.signed(size) for _ in range(order)]
        if kind < 32:
            x = _fixed(first, _residual(bits, block, order))
        else:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            if precision == 16 or shift < 0:
                raise _Damaged
            weights = [bits.signed(precision) for _ in range(order)][::-1]
            out = first
            for e in _residual(bits, block, order):
                out.append(e + (sum(w * y for w, y in zip(weights, out[-order:], strict=True)) >> shift))
            x = np.array(out, np.int64)
    else:
        raise _Damaged
    return x << wasted


def _fixed(first: list[int], residual: list[int]) -> np.ndarray:
    """Sums of sums: prediction of order ``n`` leaves the ``n``-th differences."""
    order = len(first)
    heads, row = [], np.array(first, np.int64)
    for _ in range(order):
        heads.append(int(row[-1]))
        row = np.diff(row)
    x = np.array(residual, np.int64)
    for head in reversed(heads):
        x = head + np.cumsum(x)
    return np.r_[np.array(first, np.int64), x]


def _coded_number(bits: _Bits) -> None:
    ones, head = 0, bits.take(8)
    while head >> 7 - ones & 1:
        ones += 1
        if ones > 7:
            raise _Damaged
    if ones == 1:
        raise _Damaged
    for _ in range(ones - 1):
        if bits.take(8) >> 6 != 2:
            raise _Damaged


def _frame(data: bytes, about: dict) -> tuple[np.ndarray, int]:
    """Samples by channel, and the frame's length in bytes."""
    bits = _Bits(data)
    if bits.take(15) != 0x7FFC:
        raise _Damaged
    bits.take(1)
    block_code, rate_code, channels_code, size_code = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    if bits.take(1) or block_code == 0 or rate_code == 15 or channels_code > 10 or size_code == 3:
        raise _Damaged
    _coded_number(bits)
    if block_code < 6:
        block = 192 if block_code == 1 else 576 << block_code - 2
    else:
        block = bits.take(8 if block_code == 6 else 16) + 1 if block_code < 8 else 256 << block_code - 8
    if rate_code > 11:
        rate = bits.take(8) * 1000 if rate_code == 12 else bits.take(16) * (1 if rate_code == 13 else 10)
    else:
        rate = RATES[rate_code] or about["rate"]
    size = SIZES[size_code] or about["size"]
    bits.take(8)
    channels = channels_code + 1 if channels_code < 8 else 2
    if rate != about["rate"] or channels != about["channels"]:
        raise EngineError("unsupported_codec", detail="the stream changes its rate or channels; use the external decoder")
    side = {8: 1, 9: 0, 10: 1}.get(channels_code)
    x = np.stack([_subframe(bits, block, size + (c == side)) for c in range(channels)])
    if channels_code == 8:
        x[1] = x[0] - x[1]
    elif channels_code == 9:
        x[0] = x[1] + x[0]
    elif channels_code == 10:
        middle, s = x[0] * 2 + (x[1] & 1), x[1]
        x[0], x[1] = middle + s >> 1, middle - s >> 1
    return x, -(-bits.at // 8) + 2


def decode_flac(data: bytes, ceiling: int = MAX_SAMPLES) -> tuple[np.ndarray, int, int]:
    """Samples at 16 kHz, source rate, source channels."""
    if data[:3] == b"ID3" and len(data) > 10:
        tag = 10 + sum((data[6 + k] & 127) << 7 * (3 - k) for k in range(4))
        data = data[tag:]
    if data[:4] != b"fLaC":
        raise EngineError("unsupported_codec", detail="could not read container: not a FLAC file")
    at, about, last = 4, None, False
    while not last and at + 4 <= len(data):
        last, kind, n = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0 and n >= 18 and at + 22 <= len(data):
            packed = int.from_bytes(data[at + 14 : at + 22], "big")
            about = {"longest": int.from_bytes(data[at + 11 : at + 14], "big"), "block": int.from_bytes(data[at + 6 : at + 8], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "size": (packed >> 36 & 31) + 1}
        at += 4 + n
    if about is None or not about["rate"]:
        raise EngineError("unsupported_codec", detail="missing audio parameters")
    r, scale, found = Resampler(about["rate"], ceiling), np.float32(1 << about["size"] - 1), False
    reach = 64 + about["channels"] * (max(about["block"], 4608) * (about["size"] + 1) // 8 + 16)
    while at + 2 <= len(data):
        try:
            x, n = _frame(data[at : at + reach], about)
        except _Damaged:
            nxt = at + 1
            while (nxt := data.find(b"\xff", nxt)) >= 0 and (nxt + 1 >= len(data) or data[nxt + 1] & 0xFE != 0xF8):
                nxt += 1
            if nxt < 0:
                break
            at = nxt
            continue
        found = True
        r.push(downmix((x.T.astype(np.float32) / scale).ravel(), about["channels"]))
        at += n
    if not found:
        raise EngineError("unsupported_codec", detail="file contained no decodable audio")
    return r.finish(), about["rate"], about["channels"]

"""Signal functions on numpy arrays, for use inside Arrow batches."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Most samples of a file at 16 kHz: 1 GiB of single precision.
RATE, MAX_SAMPLES = 16_000, (1 << 30) // 4
#: Fixed values of the features: bands, frame and shift in samples, transform, emphasis, range in Hz.
BANDS, FRAME, SHIFT, FFT, EMPHASIS, LOW_HZ, HIGH_HZ = 80, 400, 160, 512, np.float32(0.97), 20.0, 8000.0


class TooLong(Exception):
    """The output would pass the ceiling."""


def downmix(interleaved: np.ndarray, channels: int) -> np.ndarray:
    """Mean of the channels; a frame that is cut off goes."""
    if channels <= 1:
        return interleaved
    whole = len(interleaved) // channels * channels
    return (interleaved[:whole].reshape(-1, channels).sum(1, dtype=np.float32) / np.float32(channels)).astype(np.float32)


class Resampler:
    """Streaming conversion to 16 kHz by a windowed sinc: ``push`` pieces, then ``finish``.

    Output ``m`` is the filtered signal at ``m * source / 16000``, whatever the pieces; there are
    ``ceil(n * 16000 / source)`` of them.
    """

    HALF = 24  # zero crossings on either side

    def __init__(self, source: int, ceiling: int = MAX_SAMPLES):
        if source <= 0:
            raise ValueError("a sample rate is positive")
        self.source, self.ceiling = source, ceiling
        self.stretch = max(1.0, source / RATE)
        self.reach = int(np.ceil(self.HALF * self.stretch)) + 1
        self.held, self.first, self.n, self.made, self.out = np.zeros(self.reach, np.float64), -self.reach, 0, 0, []

    def _check(self) -> None:
        if -(-self.n * RATE // self.source) > self.ceiling:
            raise TooLong

    def push(self, samples: np.ndarray) -> None:
        self.n += len(samples)
        self._check()
        if self.source == RATE:
            self.out.append(np.asarray(samples, np.float32))
            return
        self.held = np.r_[self.held, np.asarray(samples, np.float64)]
        self._emit((self.n - self.reach) * RATE // self.source)

    def _emit(self, upto: int) -> None:
        """Outputs before ``upto``: all their taps are there."""
        while self.made < upto:
            m = np.arange(self.made, min(upto, self.made + 4096))
            whole, part = np.divmod(m * self.source, RATE)
            taps = np.arange(-self.reach + 1, self.reach + 1)
            at = (part[:, None] / RATE - taps) / self.stretch
            shape = np.where(abs(at) < self.HALF, np.cos(np.pi * at / (2 * self.HALF)) ** 2, 0.0)
            x = self.held[whole[:, None] + taps - self.first]
            self.out.append((x * np.sinc(at) * shape).sum(1).astype(np.float32) / np.float32(self.stretch))
            self.made += len(m)
        drop = self.made * self.source // RATE - self.reach - self.first
        if drop > 0:
            self.held, self.first = self.held[drop:], self.first + drop

    def finish(self) -> np.ndarray:
        if self.source != RATE:
            self.held = np.r_[self.held, np.zeros(self.reach + 1)]
            self._emit(-(-self.n * RATE // self.source))
        return np.concatenate([np.zeros(0, np.float32), *self.out])


def resample(samples: np.ndarray, source: int, ceiling: int = MAX_SAMPLES) -> np.ndarray:
    r = Resampler(source, ceiling)
    r.push(samples)
    return r.finish()


def window(samples: np.ndarray, chunk: int, size: int = 160_000, hop: int = 16_000) -> np.ndarray:
    """One window, padded with silence to its size."""
    part = samples[chunk * hop : chunk * hop + size]
    return np.r_[part, np.zeros(size - len(part), samples.dtype)] if len(part) < size else part


def mel(hz):
    return 1127.0 * np.log1p(np.asarray(hz) / 700.0)


@cache
def mel_banks(bands: int = BANDS, fft: int = FFT, rate: int = RATE, low: float = LOW_HZ, high: float = HIGH_HZ) -> np.ndarray:
    """Triangles over the bins below Nyquist, one row for each band."""
    bins = mel(np.arange(fft // 2) * rate / fft)
    edge = mel(low) + np.arange(bands + 2) * (mel(high) - mel(low)) / (bands + 1)
    left, center, right = (edge[k : k + bands, None] for k in range(3))
    inside = (bins > left) & (bins < right)
    return np.where(inside, np.where(bins <= center, (bins - left) / (center - left), (right - bins) / (right - center)), 0.0).astype(np.float32)


def features(samples: np.ndarray) -> np.ndarray:
    """Log mel energies of a window by frame, less their mean over the window."""
    if len(samples) < FRAME:
        return np.zeros((0, BANDS), np.float32)
    n = (len(samples) - FRAME) // SHIFT + 1
    x = np.lib.stride_tricks.sliding_window_view(np.asarray(samples, np.float32) * np.float32(32768), FRAME)[: n * SHIFT : SHIFT]
    x = x - x.mean(1, keepdims=True, dtype=np.float32)
    x = x - EMPHASIS * np.concatenate([x[:, :1], x[:, :-1]], axis=1)
    x = x * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(FRAME) / (FRAME - 1))).astype(np.float32)
    power = (np.abs(np.fft.rfft(x, FFT)) ** 2)[:, : FFT // 2].astype(np.float32)
    out = np.log(np.maximum(power @ mel_banks().T, np.finfo(np.float32).eps))
    return out - out.mean(0, dtype=np.float32)


def select_rows(rows: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Rows on whose nearest mask frame the mask is on."""
    if not len(rows):
        return rows
    return rows[mask[np.minimum(np.arange(len(rows)) * len(mask) // len(rows), len(mask) - 1)]]

import hashlib
import os
import struct

import numpy as np
import pytest

from voxloom.errors import CODES, EngineError
from voxloom.functions import signal
from voxloom.functions.text import word_error_rate
from voxloom.options import JobOptions
from voxloom.plans import resources
from voxloom.sources import decode, discovery, models


def wav(samples, rate=16_000, channels=1, bits=16, size=None, tag=1):
    if bits == 8:
        raw = (samples * 127 + 128).astype(np.uint8).tobytes()
    elif bits == 24:
        raw = b"".join(int(x * (2**23 - 1)).to_bytes(3, "little", signed=True) for x in samples)
    elif tag == 3:
        raw = samples.astype("<f4").tobytes()
    else:
        raw = (samples * (2 ** (bits - 1) - 1)).astype(f"<i{bits // 8}").tobytes()
    block = channels * bits // 8
    head = struct.pack("<HHIIHH", tag, channels, rate, rate * block, block, bits)
    return b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(raw) if size is None else size) + raw


def tone(hz, seconds, rate):
    return 0.5 * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


@pytest.mark.parametrize("rate", [8000, 11_025, 16_000, 22_050, 44_100, 48_000])
def test_resampler(rate):
    x = tone(440, 1.3, rate).astype(np.float32)
    y = signal.resample(x, rate)
    assert len(y) == -(-len(x) * 16_000 // rate)
    spectrum = np.abs(np.fft.rfft(y * np.hanning(len(y))))
    assert abs(spectrum.argmax() * 16_000 / len(y) - 440) < 2
    assert abs(np.abs(y[2000:-2000]).max() - 0.5) < 0.01
    r = signal.Resampler(rate)
    for part in np.array_split(x, 17):
        r.push(part)
    assert np.array_equal(r.finish(), y)
    with pytest.raises(signal.TooLong):
        signal.resample(x, rate, ceiling=len(y) - 1)
    assert len(signal.resample(x[:0], rate)) == 0


def test_resampler_removes_what_16_khz_cannot_hold():
    y = signal.resample(tone(11_000, 1, 48_000).astype(np.float32), 48_000)
    assert np.abs(y[500:-500]).max() < 0.02


def test_downmix_and_window():
    assert signal.downmix(np.float32([1, 3, 2, 4, 9]), 2).tolist() == [2, 3]
    assert signal.downmix(np.float32([1, 2]), 1).tolist() == [1, 2]
    w = signal.window(np.ones(170_000, np.float32), 1)
    assert len(w) == 160_000 and w.sum() == 154_000


def test_features():
    x = tone(1000, 10, 16_000).astype(np.float32)
    f = signal.features(x)
    assert f.shape == (998, 80) and np.abs(f.mean(0)).max() < 1e-3
    assert signal.features(x[:399]).shape == (0, 80) and signal.features(x[:400]).shape == (1, 80)
    quiet = np.r_[np.zeros(8000, np.float32), x[:8000]]
    low, high = signal.features(quiet)[5], signal.features(quiet)[-5]
    banks = signal.mel_banks()
    assert banks.shape == (80, 256) and banks.min() >= 0 and (banks.sum(1) > 0).all()
    assert abs((high - low).argmax() - banks[:, 32].argmax()) <= 1  # 1000 Hz is bin 32
    mask = np.zeros(589, bool)
    mask[100:200] = True
    assert len(signal.select_rows(f, mask)) == 169


@pytest.mark.parametrize(("bits", "tag"), [(8, 1), (16, 1), (24, 1), (32, 1), (32, 3)])
@pytest.mark.parametrize("channels", [1, 2])
def test_wav(bits, tag, channels):
    x = tone(300, 0.5, 16_000)
    y, rate, n = decode.decode_wav(wav(np.repeat(x, channels), channels=channels, bits=bits, tag=tag))
    assert (rate, n) == (16_000, channels) and np.abs(y - x).max() < 0.01


def test_wav_headers_are_not_trusted():
    x = tone(300, 0.5, 16_000)
    for size in (0, 700_000_000):
        assert len(decode.decode_wav(wav(x, size=size))[0]) == 8000
    for bad in (b"", b"RIFFxxxxWAVE", b"garbage" * 10, wav(x[:0]), wav(x[:0], size=700_000_000), wav(x, rate=0), wav(x, tag=85)):
        with pytest.raises(EngineError) as e:
            decode.decode_wav(bad)
        assert e.value.code == 10


def test_he_aac():
    hex_ = bytes.fromhex
    assert all(map(decode.is_he_aac, (hex_("2800"), hex_("e800"), hex_("141056e5a8"), hex_("121056e5"))))
    assert not any(map(decode.is_he_aac, (hex_("140056e5a8"), hex_("1210"), b"", hex_("12"), hex_("121056e0"))))


def test_external_outcome_order():
    ok = np.ones(3, np.float32)
    assert len(decode.external_outcome(ok, None, True, "")) == 3
    for args, word in (((None, signal.TooLong(), False, ""), "longer"), ((None, OSError("pipe"), False, ""), "pipe"), ((ok, None, False, " bad "), "failed: bad"), ((ok[:0], None, True, ""), "no audio")):
        with pytest.raises(EngineError, match=word):
            decode.external_outcome(*args)
    assert decode.float_stream(ok.tobytes() + b"xx").tolist() == [1, 1, 1]


def test_decode_files_and_blocks(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(tone(300, 2.5, 8000), rate=8000))
    (tmp_path / "b.mp3").write_bytes(b"x")
    (tmp_path / "c.wav").write_bytes(b"no")
    files = discovery.files_table(spark, [*discovery.discover([str(tmp_path)]), str(tmp_path / "gone.wav")])
    rows = decode.decode_files(files)
    out = {os.path.basename(r["path"]): r for r in rows.collect()}
    assert out["a.wav"]["duration"] == 2.5 and out["a.wav"]["source_sample_rate"] == 8000 and out["a.wav"]["error"] is None
    assert [out[k]["error"]["code"] for k in ("b.mp3", "c.wav", "gone.wav")] == [10, 10, 14]
    assert str(tmp_path / "c.wav") in out["c.wav"]["error"]["message"]
    blocks = decode.audio_blocks(rows, seconds=1).collect()
    assert sorted((r["block_no"], len(r["samples"])) for r in blocks) == [(0, 16_000), (1, 16_000), (2, 8000)]


def test_discovery(tmp_path):
    for p in ("b.WAV", "a.mp3", "notes.txt", "sub/c.m4b", "_x.ogg", ".hidden.wav"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"")
    os.symlink(tmp_path, tmp_path / "sub" / "loop")
    names = lambda **k: [os.path.relpath(p, tmp_path) for p in discovery.discover([str(tmp_path), str(tmp_path / "a.mp3"), str(tmp_path / "notes.txt")], **k)]
    assert names() == [".hidden.wav", "_x.ogg", "a.mp3", "b.WAV"]
    assert names(recursive=True) == [".hidden.wav", "_x.ogg", "a.mp3", "b.WAV", "sub/c.m4b"]


def test_word_error_rate():
    assert word_error_rate("the quick brown fox", "The quick, brown fox!") == 0
    assert word_error_rate("a b c d", "a x c") == 0.5
    assert word_error_rate("", "") == 0 and word_error_rate("", "x") == 1 and word_error_rate("a b", "") == 1
    assert word_error_rate("a b", "z a b y x") == 1.5


GB = 1 << 30


def test_resources():
    assert resources.largest_fitting(64 * GB, 1) == "large-v3-turbo" and resources.largest_fitting(1 * GB, 1) == "tiny"
    assert resources.resolve_model(None, None, 1) == models.DEFAULT and resources.resolve_model("base", 1, 1) == "base"
    assert resources.resolve_jobs(0, "cpu", 8 * GB, 8) == (1, None) and resources.resolve_jobs(40, "cpu", GB, 8) == (40, None)
    assert resources.resolve_jobs(None, "gpu", None, 8) == (1, None) and resources.resolve_jobs(5, "gpu", None, 8)[0] == 2
    with pytest.raises(EngineError, match="no model fits") as e:
        resources.guard_memory("large-v3", 4, 2 * GB)
    assert e.value.code == 12
    with pytest.raises(EngineError, match="largest that fits is small"):
        resources.guard_memory("large-v3", 1, 3 * GB)
    resources.guard_memory("large-v3", 99, None)


@pytest.mark.parametrize("diarize", [0, models.DIARIZATION_RESIDENT])
def test_what_is_chosen_is_never_refused(diarize):
    for cores in (1, 2, 8, 64, 256):
        for ram in (2, 3, 4, 8, 16, 64, 512):
            jobs, _ = resources.resolve_jobs(None, "cpu", ram * GB, cores, diarize)
            resources.guard_memory(resources.resolve_model(None, ram * GB, jobs, diarize), jobs, ram * GB, diarize)


def test_capabilities_and_options():
    models.check_capabilities("distil-large-v3.5", "transcribe", "EN")
    models.check_capabilities("large-v3", "translate", "fr")
    for args in (("tiny", "translate", None), ("distil-large-v3.5", "transcribe", "fr"), ("nope", "transcribe", None)):
        with pytest.raises(EngineError) as e:
            models.check_capabilities(*args)
        assert e.value.code == 2
    assert JobOptions(formats=("srt", "txt", "srt")).effective_formats == ("srt", "txt") and JobOptions(json=True).effective_formats == ("json",)
    for bad in ({"formats": ("pdf",)}, {"task": "sing"}, {"num_speakers": 2}, {"decoder": "x"}):
        with pytest.raises(EngineError):
            JobOptions(**bad)
    assert CODES["interrupted"] == CODES["partial_batch_failure"] == 20


def test_model_cache(tmp_path, monkeypatch):
    body, asked = b"weights", []
    row = ("tiny", "ggml-tiny.bin", len(body), hashlib.sha256(body).hexdigest().upper(), True, False, 4)
    monkeypatch.setattr(models, "MODELS", [row])

    def fetch(name, path):
        asked.append(name)
        path.write_bytes(body if len(asked) > 1 else b"torn")

    cache = models.ModelCache(str(tmp_path), fetch)
    assert cache.ensure("tiny").read_bytes() == body and len(asked) == 2
    assert cache.ensure("tiny") and len(asked) == 2 and cache.listing()[0]["cached"]
    assert cache.evict("tiny") and not cache.evict("tiny")
    with pytest.raises(EngineError) as e:
        models.ModelCache(str(tmp_path), fetch, offline=True).ensure("tiny")
    assert e.value.code == 11
    with pytest.raises(EngineError, match="digest"):
        models.ModelCache(str(tmp_path), lambda n, p: p.write_bytes(b"x")).ensure("tiny")

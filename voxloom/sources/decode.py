"""Audio files to 16 kHz mono, as rows: samples or an error, never an exception.

The built-in decoders read WAV (PCM of 8 to 32 bits, floats) and FLAC. Other formats have no decoder in Python here: they
give code 10, or go through the external program where it is installed. Decoders are looked up by extension."""

from __future__ import annotations

import shutil
import struct
import subprocess
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.signal import MAX_SAMPLES, RATE, Resampler, TooLong, downmix
from .flac import decode_flac

AUDIO = "file_id long, path string, status string, samples array<float>, source_sample_rate int, source_channels int, duration double, error struct<code:int,message:string>"
#: Format tags of a WAV header, and the object types and marker of the AAC variants that are refused.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
SBR, PS, SYNC_EXTENSION = 5, 29, 0x2B7
TOO_LONG = "audio is longer than about 4.6 hours of 16 kHz mono; split it into shorter clips"


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        if n > self.left:
            raise EOFError
        self.left -= n
        return self.value >> self.left & (1 << n) - 1

    def object_type(self) -> int:
        kind = self.take(5)
        return 32 + self.take(6) if kind == 31 else kind


def is_he_aac(config: bytes) -> bool:
    """Whether an AAC configuration names the spectral-band variants: as its type, or in the extension after it."""
    bits = _Bits(config)
    try:
        if bits.object_type() in (SBR, PS):
            return True
        if bits.take(4) == 15:
            bits.take(24)  # a rate of its own
        if not 1 <= bits.take(4) <= 7:  # channels laid out elsewhere: no fixed place for the extension
            return False
        bits.take(1)
        if bits.take(1):
            bits.take(14)
        bits.take(1)
        return bits.take(11) == SYNC_EXTENSION and bits.object_type() in (SBR, PS)
    except EOFError:
        return False


def _wav_samples(raw: bytes, tag: int, width: int, block: int) -> np.ndarray:
    raw = raw[: len(raw) // width * width]
    if tag == FLOAT:
        return np.frombuffer(raw, f"<f{width}").astype(np.float32)
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / np.float32(128)
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / np.float32(1 << 23)
    return np.frombuffer(raw, f"<i{width}").astype(np.float32) / np.float32(1 << 8 * width - 1)


def decode_wav(data: bytes, ceiling: int = MAX_SAMPLES) -> tuple[np.ndarray, int, int]:
    """Samples at 16 kHz, source rate, source channels. Sizes in the header are not trusted: what is there counts."""
    if len(data) < 12 or data[:4] not in (b"RIFF", b"RF64") or data[8:12] != b"WAVE":
        raise EngineError("unsupported_codec", detail="could not read container: not a WAV file")
    at, shape, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(data):
            tag, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if tag == EXTENSIBLE and size >= 40 and at + 34 <= len(data):
                tag = struct.unpack_from("<H", data, at + 32)[0]
            shape = tag, channels, rate, bits, block
        elif name == b"data":
            body = data[at + 8 : at + 8 + size] if size else data[at + 8 :]
            break
        at += 8 + size + size % 2
    if shape is None:
        raise EngineError("unsupported_codec", detail="missing audio parameters")
    tag, channels, rate, bits, block = shape
    if rate == 0:
        raise EngineError("unsupported_codec", detail="unknown sample rate")
    if tag not in (PCM, FLOAT) or bits not in ((8, 16, 24, 32) if tag == PCM else (32, 64)):
        raise EngineError("unsupported_codec", detail="no decoder for this kind of WAV")
    channels = max(1, channels)
    x = _wav_samples(body or b"", tag, bits // 8, block)
    if len(x) < channels:
        raise EngineError("unsupported_codec", detail="file contained no decodable audio")
    r = Resampler(rate, ceiling)
    for part in range(0, len(x), channels << 18):  # bounded pieces
        r.push(downmix(x[part : part + (channels << 18)], channels))
    return r.finish(), rate, channels


def _missing(kind: str) -> Callable:
    def decode(data: bytes, ceiling: int = MAX_SAMPLES):
        raise EngineError("unsupported_codec", detail=f"no built-in decoder for {kind}")

    return decode


#: Decoders by extension; a job may add its own.
DECODERS: dict[str, Callable] = {"wav": decode_wav, "flac": decode_flac} | {k: _missing(k) for k in ("mp3", "ogg", "oga", "m4a", "mp4", "m4b")}


def float_stream(raw: bytes, ceiling: int = MAX_SAMPLES) -> np.ndarray:
    """Little-endian single floats; bytes of one that is cut off are dropped."""
    if len(raw) // 4 > ceiling:
        raise TooLong
    return np.frombuffer(raw[: len(raw) // 4 * 4], "<f4")


def external_outcome(samples: np.ndarray | None, problem: Exception | None, success: bool, said: str) -> np.ndarray:
    """What a finished run of the external decoder gave, or its error; the order of cases matters."""
    if isinstance(problem, TooLong):
        raise EngineError("unsupported_codec", detail=TOO_LONG)
    if problem is not None:
        raise EngineError("unsupported_codec", detail=f"reading the decoder's output failed: {problem}")
    if not success:
        raise EngineError("unsupported_codec", detail=f"the decoder failed: {said.strip()}")
    if samples is None or not len(samples):
        raise EngineError("unsupported_codec", detail="the decoder produced no audio")
    return samples


def decode_external(path: str, ceiling: int = MAX_SAMPLES, program: str = "ffmpeg", timeout: float = 3600) -> tuple[np.ndarray, int, int]:
    """The external decoder's 16 kHz mono; at most ``ceiling`` samples are read before it is ended."""
    import os
    import threading

    if shutil.which(program) is None:
        raise EngineError("unsupported_codec", detail=f"{program} is not installed")
    command = [program, "-nostdin", "-v", "error", "-i", os.path.realpath(path), "-f", "f32le", "-ac", "1", "-ar", str(RATE), "-"]
    run = subprocess.Popen(command, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    said: list[bytes] = []
    drain = threading.Thread(target=lambda: said.append(run.stderr.read()))
    drain.start()
    end = threading.Timer(timeout, run.kill)
    end.start()
    samples = problem = None
    try:
        samples = float_stream(run.stdout.read(4 * ceiling + 4), ceiling)
    except (TooLong, OSError) as e:
        problem = e
        run.kill()
    success = run.wait() == 0
    end.cancel()
    drain.join()
    return external_outcome(samples, problem, success, b"".join(said).decode(errors="replace")), RATE, 1


def load_audio(path: str, decoder: str = "builtin", ceiling: int = MAX_SAMPLES) -> tuple[np.ndarray, int, int]:
    if decoder == "ffmpeg":
        return decode_external(path, ceiling)
    try:
        with open(path, "rb") as f:
            data = f.read()
    except FileNotFoundError as e:
        raise EngineError("file_not_found", path=path) from e
    except OSError as e:
        raise EngineError("io", detail=str(e)) from e
    return DECODERS.get(path.rpartition(".")[2].lower(), decode_wav)(data, ceiling)


def decode_files(files: DataFrame, *, decoder: str = "builtin", ceiling: int = MAX_SAMPLES) -> DataFrame:
    """``files`` (``file_id, path``, and ``content`` where Spark has read the bytes) to audio rows."""
    has_content = "content" in files.columns

    def run(batches):
        import pyarrow as pa

        samples_type = pa.list_(pa.float32())
        for b in batches:
            contents = b["content"] if has_content else [None] * b.num_rows
            for k, (i, path) in enumerate(zip(b["file_id"].to_pylist(), b["path"].to_pylist(), strict=True)):
                x = rate = channels = error = None
                try:
                    if has_content and decoder == "builtin":
                        x, rate, channels = DECODERS.get(path.rpartition(".")[2].lower(), decode_wav)(contents[k].as_py() or b"", ceiling)
                    else:
                        x, rate, channels = load_audio(path, decoder, ceiling)
                except EngineError as e:
                    error = {"code": e.code, "message": str(e).replace("decode :", f"decode {path}:")}
                except TooLong:
                    error = {"code": 10, "message": TOO_LONG}
                audio = pa.array([x], samples_type) if x is not None else pa.nulls(1, samples_type)
                seconds = None if x is None else len(x) / RATE
                kind = pa.struct([("code", pa.int32()), ("message", pa.string())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int64()), pa.array([path]), pa.array(["failed" if error else "pcm"]), audio, pa.array([rate], pa.int32()), pa.array([channels], pa.int32()), pa.array([seconds], pa.float64()), pa.array([error], kind)],
                    ["file_id", "path", "status", "samples", "source_sample_rate", "source_channels", "duration", "error"],
                )

    return files.select("file_id", "path", *["content"] * has_content).mapInArrow(run, AUDIO)


def audio_blocks(audio: DataFrame, seconds: int = 60) -> DataFrame:
    """Long recordings as rows of at most ``seconds``: ``file_id, block_no, samples``."""
    size = seconds * RATE
    n = F.call_function("div", F.size("samples") + size - 1, F.lit(size)).cast("int")
    rows = audio.filter("samples is not null").select("file_id", "samples", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).alias("block_no"))
    return rows.select("file_id", "block_no", F.slice("samples", F.col("block_no") * size + 1, size).alias("samples"))

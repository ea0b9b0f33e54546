"""Models that can be run, what they need, and whether that fits."""

from __future__ import annotations

import hashlib
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError

#: Speech models with size in bytes, SHA-256, whether they know other languages than English and
#: whether they translate; and the rank in which one is chosen where none is asked for (the others never are).
MODELS = [
    ("tiny", "ggml-tiny.bin", 77_691_713, "be07e048e1e599ad46341c8d2a135645097a538221678b7acdd1b1919c6e1b21", True, False, 4),
    ("base", "ggml-base.bin", 147_951_465, "60ed5bc3dd14eea856493d334349b405782ddcaf0028d4b5df4088345fba2efe", True, False, 3),
    ("small", "ggml-small.bin", 487_601_967, "1be3a9b2063867b937e64e2ec7483364a79917e157fa98c5d94b5c1fffea987b", True, False, 2),
    ("large-v3", "ggml-large-v3.bin", 3_095_033_483, "64d182b440b98d5203c4f9bd541544d84c605196c4f7b845dfa11fb23594d1e2", True, True, None),
    ("large-v3-turbo", "ggml-large-v3-turbo.bin", 1_624_555_275, "1fc70f774d38eb169993ac391eea357ef47c88757ef72ee5943879b7e8e2bc69", True, False, 1),
    ("distil-large-v3.5", "ggml-model.bin", 1_519_521_155, "ec2498919b498c5f6b00041adb45650124b3cd9f26f545fffa8f5d11c28dcf26", False, False, None),
]
#: The two diarization models with size in bytes and SHA-256.
DIARIZATION = [
    ("segmentation", "segmentation.onnx", 5_986_908, "057ee564753071c0b09b5b611648b50ac188d50846bff5f01e9f7bbf1591ea25"),
    ("embedding", "embedding.onnx", 26_535_549, "3955447b0499dc9e0a4541a895df08b03c69098eba4e56c02b5603e9f7f4fcbb"),
]
#: Bytes for a decoded file, for diarization, share of memory that may be used.
DECODE_BUFFER, DIARIZATION_RESIDENT, BUDGET_PERCENT = 1 << 30, 256 << 20, 85
DEFAULT, SMALLEST, MOST = "large-v3-turbo", "tiny", 2**63 - 1


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "model string, file string, size long, sha256 string, multilingual boolean, can_translate boolean, rank int")


def resident_memory(size: Column) -> Column:
    """Weights and half as much again."""
    return size + F.call_function("div", size, F.lit(2))


def estimated_memory(size: Column, jobs: Column) -> Column:
    """With so many files in decoding; stays at the most a long holds."""
    need = resident_memory(size).cast("decimal(38,0)") + F.lit(DECODE_BUFFER) * F.greatest(jobs, F.lit(1)).cast("decimal(20,0)")
    return F.least(need, F.lit(MOST).cast("decimal(38,0)")).cast("long")


def memory_budget(ram: Column) -> Column:
    product = F.least(ram.cast("decimal(38,0)") * BUDGET_PERCENT, F.lit(MOST).cast("decimal(38,0)")).cast("long")
    return F.call_function("div", product, F.lit(100))


def would_exceed(ram: Column, size: Column, jobs: Column, extra: Column) -> Column:
    return estimated_memory(size, jobs).cast("decimal(38,0)") + extra > memory_budget(ram)


def max_jobs_fitting(ram: Column, size: Column, extra: Column) -> Column:
    room = F.greatest(memory_budget(ram) - resident_memory(size) - extra, F.lit(0).cast("long"))
    return F.greatest(F.call_function("div", room, F.lit(DECODE_BUFFER)), F.lit(1))


def largest_fitting(machines: DataFrame, *, ram: str = "ram", jobs: str = "jobs", extra: str = "extra", name: str = "model") -> DataFrame:
    """``machines`` with the first model of the ranking that fits, or the smallest. The ranking is four constants,
    so it is a column and not a join."""
    out = F.lit(SMALLEST)
    for model, _, size, *_, rank in sorted((m for m in MODELS if m[-1]), key=lambda m: -m[-1]):
        out = F.when(~would_exceed(F.col(ram), F.lit(size), F.col(jobs), F.col(extra)), model).otherwise(out)
    return machines.withColumn(name, out)


def find_model(name: str) -> tuple:
    for m in MODELS:
        if m[0] == name:
            return m
    raise EngineError("usage", detail=f"unknown model {name}")


def check_capabilities(model: str, task: str, language: str | None) -> None:
    """A model that can't translate, or knows English only, is refused before work starts."""
    _, _, _, _, multilingual, can_translate, _ = find_model(model)
    if task == "translate" and not can_translate:
        raise EngineError("usage", detail=f"{model} does not translate; large-v3 does")
    if not multilingual and (language or "").strip() and language.lower() not in ("en", "auto"):
        raise EngineError("usage", detail=f"{model} knows English only, not {language}")


class ModelCache:
    """Model files in a folder on the driver. ``fetch(name, path)`` gets one; it is tried once more where what came
    doesn't have the right digest, and never offline."""

    def __init__(self, folder: str, fetch=None, offline: bool = False):
        self.folder, self.fetch, self.offline = Path(folder), fetch, offline

    def path(self, model: str) -> Path:
        return self.folder / model / self._about(model)[1]

    @staticmethod
    def _about(model: str) -> tuple:
        return next((m for m in DIARIZATION if m[0] == model), None) or find_model(model)

    def cached(self, model: str) -> bool:
        return self.path(model).exists()

    def listing(self) -> list[dict]:
        return [{"model": m[0], "size": m[2], "cached": self.cached(m[0]), "path": str(self.path(m[0]))} for m in MODELS]

    def diarization(self) -> dict:
        """Both diarization models as one: their sizes summed, cached if both are."""
        return {"model": "diarization", "size": sum(m[2] for m in DIARIZATION), "cached": all(self.cached(m[0]) for m in DIARIZATION)}

    def evict(self, model: str) -> bool:
        path = self.path(model)
        there = path.exists() or path.is_symlink()
        if path.is_symlink():
            Path(os.path.realpath(path)).unlink(missing_ok=True)
        path.unlink(missing_ok=True)
        return there

    def ensure(self, model: str) -> Path:
        path, want = self.path(model), self._about(model)[3]
        if path.exists() and matches(path, want):
            return path
        if self.offline or self.fetch is None:
            raise EngineError("model_download_failed", model=model, detail="not in the cache, and " + ("offline" if self.offline else "nothing is named that fetches it"))
        for _ in range(2):
            self.evict(model)
            path.parent.mkdir(parents=True, exist_ok=True)
            tmp = path.with_suffix(".part")
            try:
                self.fetch(model, tmp)
            except OSError as e:
                raise EngineError("model_download_failed", model=model, detail=str(e)) from e
            os.replace(tmp, path)
            if matches(path, want):
                return path
        self.evict(model)
        raise EngineError("model_download_failed", model=model, detail="its digest is wrong")


def matches(path: Path, sha256: str) -> bool:
    """Digest of a file of any size, in pieces."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest() == sha256.lower()

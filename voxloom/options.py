"""Options of a job, one for each flag of the command line they stand for."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import EngineError

FORMATS = ("txt", "srt", "vtt", "json", "tsv", "csv")


@dataclass(frozen=True)
class JobOptions:
    inputs: tuple[str, ...] = ()
    recursive: bool = False
    model: str | None = None
    language: str = "auto"
    task: str = "transcribe"
    formats: tuple[str, ...] = ("txt",)
    out_dir: str | None = None
    jobs: int | None = None
    threads: int | None = None
    force: bool = False
    explain_only: bool = False
    decoder: str = "builtin"
    json: bool = False
    offline: bool = False
    diarize: bool = False
    num_speakers: int | None = None
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.task not in ("transcribe", "translate"):
            raise EngineError("usage", detail=f"unknown task {self.task}")
        if bad := [f for f in self.formats if f not in FORMATS]:
            raise EngineError("usage", detail=f"unknown format {bad[0]}")
        if self.decoder not in ("builtin", "ffmpeg"):
            raise EngineError("usage", detail=f"unknown decoder {self.decoder}")
        if self.threads is not None and self.threads < 1:
            raise EngineError("usage", detail="a number of threads is 1 or more")
        if self.num_speakers is not None and (self.num_speakers < 1 or not self.diarize):
            raise EngineError("usage", detail="a number of speakers is 1 or more and needs diarization")

    @property
    def effective_formats(self) -> tuple[str, ...]:
        """``json`` overrides; otherwise as asked for, each once."""
        return ("json",) if self.json else tuple(dict.fromkeys(self.formats))

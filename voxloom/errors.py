"""Failures as data: a code and one line, carried in a struct column; the driver turns codes into an exit code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes that scripts rely on. New kinds get new numbers; none changes.
CODES = {
    "io": 1, "usage": 2, "unsupported_codec": 10, "model_download_failed": 11, "out_of_memory": 12, "gpu_init_failed": 13, "file_not_found": 14,
    "model_load_failed": 15, "transcription_failed": 16, "diarization_failed": 17, "partial_batch_failure": 20, "interrupted": 20,
}
#: What to do about it.
HINTS = {
    "io": "I/O error: {detail}",
    "usage": "{detail}",
    "unsupported_codec": "cannot decode {path}: {detail}. Convert it to WAV, or use the external decoder.",
    "model_download_failed": "model {model} is not here and could not be fetched: {detail}.",
    "out_of_memory": "out of memory: {detail}.",
    "gpu_init_failed": "GPU not usable: {detail}. The CPU does the same work.",
    "file_not_found": "no such file or directory: {path}",
    "model_load_failed": "{path} is not a model that can be loaded: {detail}.",
    "transcription_failed": "transcription failed: {detail}",
    "diarization_failed": "speaker diarization failed: {detail}",
    "partial_batch_failure": "some files have no transcript: {failed} of the {processed} that were tried. Their rows say why.",
    "interrupted": "stopped by request after {completed} of {total} files; run again for the others.",
}
ERROR_TYPE = "struct<code:int,message:string>"


class EngineError(Exception):
    def __init__(self, kind: str, **detail):
        self.kind, self.code = kind, CODES[kind]
        super().__init__(HINTS[kind].format(**{"detail": "", "path": "", "model": ""} | detail))


def error_column(kind: Column, detail: Column, path: Column) -> Column:
    """Struct of code and line for a column of kinds; null where the kind is null or unknown."""
    code = F.lit(None).cast("int")
    line = F.lit(None).cast("string")
    for k, hint in HINTS.items():
        code = F.when(kind == k, CODES[k]).otherwise(code)
        text = F.lit(hint)
        for name, value in (("{detail}", detail), ("{path}", path)):
            text = F.replace(text, F.lit(name), F.coalesce(value, F.lit("")))
        line = F.when(kind == k, text).otherwise(line)
    return F.when(code.isNotNull(), F.struct(code.alias("code"), line.alias("message")))

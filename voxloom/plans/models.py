"""What the neural steps are to a job, and stand-ins for them.

No weights come with this package. A job takes any object with these methods; the stand-ins compute something
repeatable from the signal and name themselves ``stub`` in the results: they recognise nothing."""

from __future__ import annotations

from typing import Protocol

import numpy as np

from ..functions.frames import CLASSES, FRAMES


class Transcriber(Protocol):
    name: str

    def transcribe(self, samples: np.ndarray, language: str, task: str, words: bool) -> tuple[str, list[dict]]:
        """Language, and raw segments: ``no_speech, text, start_cs, end_cs, tokens`` (``text, t0_cs, t1_cs``)."""


class SpeakerModels(Protocol):
    def segment(self, window: np.ndarray) -> np.ndarray:
        """Scores of 589 frames by 7 classes."""

    def embed(self, rows: np.ndarray) -> np.ndarray:
        """A vector for the selected feature rows; raises where it is not finite."""


class StubTranscriber:
    """A segment for each stretch of sound, its words naming second and loudness."""

    name = "stub"

    def transcribe(self, samples, language="auto", task="transcribe", words=False):
        n = len(samples) // 16_000
        loud = np.sqrt((samples[: n * 16_000].reshape(n, -1).astype(np.float64) ** 2).mean(1)) if n else np.zeros(0)
        out = []
        for k, x in enumerate(loud):
            text = f" second {k} level {int(np.rint(1000 * x))}"
            tokens = [{"text": " " + w, "t0_cs": 100 * k + 20 * j, "t1_cs": 100 * k + 20 * j + 20} for j, w in enumerate(text.split())]
            out.append({"no_speech": 1.0 if x < 1e-3 else 0.0, "text": text, "start_cs": 100 * k, "end_cs": 100 * k + 100, "tokens": tokens if words else []})
        return ("en" if language in ("auto", "", None) else language.lower()), out


class StubSpeakers:
    """Tells low from high sounds: frames where the signal is on go to the first or second speaker by zero crossings."""

    def segment(self, window):
        parts = np.array_split(window.astype(np.float64), FRAMES)
        out = np.full((FRAMES, CLASSES), -5.0, np.float32)
        for k, p in enumerate(parts):
            loud = np.sqrt((p**2).mean())
            crossings = (np.diff(np.signbit(p)) != 0).mean()
            out[k, 0 if loud < 1e-3 else 1 if crossings < 0.1 else 2] = -0.1
        return out

    def embed(self, rows):
        v = rows.mean(0).astype(np.float64)
        if not len(v) or not np.isfinite(v).all():
            raise ValueError("the embedding is not finite")
        return v


class OnnxSpeakers:
    """Segmentation and embedding models as ONNX files; sessions are made once in each worker."""

    def __init__(self, segmentation: str, embedding: str):
        self.paths, self.sessions = (segmentation, embedding), None

    def _load(self):
        if self.sessions is None:
            import onnxruntime

            from ..errors import EngineError

            made = []
            for p in self.paths:
                try:
                    s = onnxruntime.InferenceSession(p)
                except Exception as e:  # the runtime raises types of its own
                    raise EngineError("model_load_failed", path=p, detail=str(e)) from e
                if len(s.get_outputs()) != 1:
                    raise EngineError("model_load_failed", path=p, detail="more than one output")
                made.append((s, s.get_inputs()[0].name))
            self.sessions = made
        return self.sessions

    def __getstate__(self):
        return {"paths": self.paths, "sessions": None}

    def segment(self, window):
        session, name = self._load()[0]
        out = np.asarray(session.run(None, {name: window.astype(np.float32)[None, None, :]})[0])
        if out.shape != (1, FRAMES, CLASSES):
            raise ValueError(f"segmentation gave {out.shape}")
        return out[0]

    def embed(self, rows):
        session, name = self._load()[1]
        out = np.asarray(session.run(None, {name: rows.astype(np.float32)[None]})[0]).ravel().astype(np.float64)
        if not len(out) or not np.isfinite(out).all():
            raise ValueError("the embedding is empty or not finite")
        return out

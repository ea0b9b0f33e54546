"""How many files at once and which model: arithmetic on the driver before a job starts."""

from __future__ import annotations

import os

from ..errors import EngineError
from ..sources.models import BUDGET_PERCENT, DECODE_BUFFER, DEFAULT, MODELS, SMALLEST, find_model


def human(size: int) -> str:
    if size < 1024:
        return f"{size} B"
    value, units = float(size), ["B", "KB", "MB", "GB", "TB", "PB"]
    k = 0
    while value >= 1024 and k < len(units) - 1:
        value, k = value / 1024, k + 1
    return f"{value:.1f} {units[k]}"


def detected_parallelism() -> int:
    return os.cpu_count() or 4


def total_memory() -> int | None:
    try:
        return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") or None
    except (OSError, ValueError):
        return None


def estimated(model: str, jobs: int) -> int:
    size = find_model(model)[2]
    return size + size // 2 + DECODE_BUFFER * max(1, jobs)


def exceeds(ram: int, model: str, jobs: int, extra: int = 0) -> bool:
    return estimated(model, jobs) + extra > ram * BUDGET_PERCENT // 100


def largest_fitting(ram: int, jobs: int, extra: int = 0) -> str:
    ranked = sorted((m for m in MODELS if m[-1]), key=lambda m: m[-1])
    return next((m[0] for m in ranked if not exceeds(ram, m[0], jobs, extra)), SMALLEST)


def resolve_model(asked: str | None, ram: int | None, jobs: int, extra: int = 0) -> str:
    """What was asked for; else the largest of the ranking that fits; the default where memory is unknown."""
    return asked or (DEFAULT if ram is None else largest_fitting(ram, jobs, extra))


def max_jobs(ram: int, model: str, extra: int = 0) -> int:
    size = find_model(model)[2]
    return max(1, (ram * BUDGET_PERCENT // 100 - size - size // 2 - extra) // DECODE_BUFFER)


def resolve_jobs(asked: int | None, backend: str, ram: int | None, cores: int, extra: int = 0) -> tuple[int, str | None]:
    """Jobs and a note. A number that was asked for is kept on a CPU; a GPU takes two at most."""
    if backend == "cpu":
        if asked is not None:
            return max(1, asked), None
        half = max(1, cores // 2)
        return (half if ram is None else max(1, min(half, max_jobs(ram, SMALLEST, extra)))), None
    want = max(1, asked if asked is not None else 1)
    return (2, f"{want} jobs asked for; 2 are run, since one GPU takes turns") if want > 2 else (want, None)


def thread_settings(threads: int | None, cores: int) -> dict[str, str]:
    """Settings for models that use ``threads`` threads a file: a task takes as many cores, all of them at most."""
    if threads is None:
        return {}
    n = str(min(threads, cores))
    return {"spark.task.cpus": n, "spark.executorEnv.OMP_NUM_THREADS": n}


def guard_memory(model: str, jobs: int, ram: int | None, extra: int = 0) -> None:
    if ram is None or not exceeds(ram, model, jobs, extra):
        return
    best = largest_fitting(ram, jobs, extra)
    advice = "no model fits, so lower the number of jobs" if exceeds(ram, best, jobs, extra) else f"the largest that fits is {best}"
    raise EngineError("out_of_memory", detail=f"this machine has {human(ram)}, {jobs} x {model} take {human(estimated(model, jobs) + extra)}, {advice}")

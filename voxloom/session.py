"""Session and table helpers."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import signal
import tempfile
import threading
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("voxloom")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"} | conf
    return builder.config(map=settings).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Once for each application, send this package to the Python workers, unless they start where it is on the path."""
    context, home = spark.sparkContext, Path(__file__).resolve().parent.parent
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if context.master.startswith("local") and home in {Path(p).resolve() for p in path if p}:
        return
    if context.master.startswith("local[") and home == Path.cwd().resolve():
        return
    folder = tempfile.mkdtemp(prefix="voxloom-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/voxloom-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((home / "voxloom").rglob("*.py")):
            z.write(p, p.relative_to(home))
    context.addPyFile(archive)  # the driver serves it to executors as long as it runs


@contextlib.contextmanager
def interruptible(spark: SparkSession, tag: str = "voxloom-job") -> Iterator[dict]:
    """Within, the first Ctrl-C stops the jobs that carry ``tag``, and no others: the action under way fails, as
    do those that follow, and ``state["interrupted"]`` is true. The next Ctrl-C does what it did before. Each use begins
    anew. Off the main thread, where signals can't be taken, it only tags."""
    state, pressed, over = {"interrupted": False}, threading.Event(), threading.Event()
    main = threading.current_thread() is threading.main_thread()
    before = signal.getsignal(signal.SIGINT) if main else None

    def press(*_) -> None:  # the main thread may be in a call to the JVM, so another one makes the next call
        state["interrupted"] = True
        signal.signal(signal.SIGINT, before)
        pressed.set()

    def stop() -> None:
        pressed.wait()
        while not over.is_set():
            spark.sparkContext.cancelJobsWithTag(tag)  # the session's interruptTag finds nothing to stop here
            over.wait(0.2)

    watcher = threading.Thread(target=stop, daemon=True)
    spark.sparkContext.addJobTag(tag)
    if main:
        signal.signal(signal.SIGINT, press)
        watcher.start()
    try:
        yield state
    finally:
        over.set()
        pressed.set()
        if main:
            signal.signal(signal.SIGINT, before)
            watcher.join()
        spark.sparkContext.removeJobTag(tag)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""The folder that driver and executors share, intermediate tables in it, and column helpers."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: On ``file:`` (no other store looks at this) intermediate tables have no checksum files beside them. With those, and
#: without Hadoop's native library, an executor forks a process twice for every file, under a large heap.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Stands for a null document id inside the operators.
NULL_ID = -(2**63)


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset (tests on a local master), a temporary folder that is set as it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="voxloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Workspace:
    """One run's tables in the shared folder. ``clear`` removes them once the result is no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark, self.path = spark, f"{shared_root(spark)}/voxloom/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(self._clear_at_exit)  # results are read lazily, so not before

    def folder(self, name: str) -> str:
        self.n += 1
        return f"{self.path}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
        """Write ``df`` and read it back: cuts the lineage at files every executor can reach."""
        to = self.folder(name)
        df.write.options(**PLAIN_FILES).partitionBy(*partition_by).parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def listed(self, files: DataFrame) -> DataFrame:
        """Runs a plan that writes files and returns a small row for each of them; the rows go by way of the driver.

        As a table each row would be a file of its own, and an executor starts several processes to make a file."""
        return self.spark.createDataFrame(files.collect(), files.schema)

    def local_path(self, name: str) -> str | None:
        """A folder of this run for plain files that are read and written in place; None where the shared folder is no path."""
        files = SharedFiles(self.folder(name))
        return files.root if files.local else None

    def free(self) -> None:
        """Let Spark drop the shuffle files of steps that have been kept."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _clear_at_exit(self) -> None:
        if self.path.startswith(("/", "file:")):
            shutil.rmtree(SharedFiles(self.path).root, ignore_errors=True)

    def clear(self) -> None:
        """Remove the tables now; in stores that only Spark reaches nothing else does."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class SharedFiles:
    """Plain files in the shared folder, from Python on driver or executor.

    ``file:`` and bare paths go through the operating system (temporary file, then rename, so that a task
    that runs twice leaves one whole file); other schemes through ``pyarrow.fs``.
    """

    def __init__(self, uri: str):
        if uri.startswith("file:"):
            uri = "/" + uri[5:].lstrip("/")
        self.local, self.fs, self.root = "://" not in uri, None, uri
        if not self.local:
            import pyarrow.fs

            self.fs, self.root = pyarrow.fs.FileSystem.from_uri(uri)

    @contextlib.contextmanager
    def create(self, name: str):
        """A file to write; it gets its name once it is whole."""
        path = f"{self.root}/{name}"
        tmp = f"{path}.{uuid.uuid4().hex}.tmp"
        if self.local:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            try:
                with open(tmp, "wb") as f:
                    yield f
            except BaseException:
                os.remove(tmp)
                raise
            os.replace(tmp, path)
        else:
            self.fs.create_dir(path.rpartition("/")[0], recursive=True)
            with self.fs.open_output_stream(tmp) as f:
                yield f
            self.fs.move(tmp, path)

    def write(self, name: str, chunks: Iterable[bytes]) -> int:
        n = 0
        with self.create(name) as f:
            for c in chunks:
                f.write(c)
                n += len(c)
        return n

    def open(self, name: str):
        """A seekable ``pyarrow`` input file; local ones are memory-mapped."""
        import pyarrow as pa

        return pa.memory_map(f"{self.root}/{name}") if self.local else self.fs.open_input_file(f"{self.root}/{name}")


def worker(run):
    """``run``, a function for ``mapInArrow``; when it ends, memory that is free goes back to the system.

    Python workers outlive their tasks, and allocators keep what they had at their busiest.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the GNU library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does just that on text without wider characters, and faster."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def doc_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def null_id(c: Column) -> Column:
    """Back from ``doc_id``."""
    return F.when(c != NULL_ID, c)


def names_of(df: DataFrame) -> list[str]:
    """The columns' names as references, whatever characters are in them."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

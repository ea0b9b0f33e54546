"""Which outputs are there, fresh, or in each other's way; and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import output_path


def fresh_inputs(inputs: DataFrame, outputs: DataFrame, formats: DataFrame | None = None, *, by: str = "path") -> DataFrame:
    """``by, fresh``: whether every expected output exists and is as new as its input.

    ``inputs``: ``by, mtime``; ``outputs``: ``by, format, mtime`` (null where there is none). ``formats`` (one
    column ``format``, a handful of rows) lists what is asked for; by default what ``outputs`` lists for the input.
    An input without a time or without expected outputs on record is stale.
    """
    out = outputs.select(F.col(by).alias("__by"), "format", F.col("mtime").alias("__out"))
    if formats is not None:
        names = [r["format"] for r in formats.select("format").distinct().collect()]  # at most the six formats
        want = inputs.select(by, "mtime", F.explode(F.array(*map(F.lit, names))).alias("format"))
        rows = want.join(out.withColumnRenamed("format", "__format"), (F.col(by) == F.col("__by")) & (F.col("format") == F.col("__format")), "left")
    else:
        rows = inputs.join(out, F.col(by) == F.col("__by"), "left")
    return rows.groupBy(by).agg(F.bool_and(F.coalesce(F.col("__out") >= F.col("mtime"), F.lit(False))).alias("fresh"))


def stale_inputs(inputs: DataFrame, outputs: DataFrame, formats: DataFrame | None = None, *, by: str = "path", force: bool = False) -> DataFrame:
    """Inputs that need work."""
    return inputs if force else inputs.join(fresh_inputs(inputs, outputs, formats, by=by).filter("fresh"), by, "left_anti")


def collisions(outputs: DataFrame, *, key: str = "output", source: str = "input", order: str = "input") -> DataFrame:
    """``folded, first_input, second_input, first_output, second_output, same_case``: for each output path, case
    aside, that different inputs would write, the first two in order."""
    rows = outputs.select(F.lower(key).alias("folded"), F.col(key).alias("o"), F.col(source).alias("i"), F.col(order).alias("n"))
    firsts = rows.groupBy("folded", "i").agg(F.min(F.struct("n", "o")).alias("x")).select("folded", "i", "x.n", "x.o")
    clash = firsts.groupBy("folded").agg(F.count("*").alias("c"), F.min(F.struct("n", "i", "o")).alias("a")).filter("c > 1")
    second = firsts.join(clash.select("folded", "a"), "folded").filter("i <> a.i").groupBy("folded").agg(F.first("a").alias("a"), F.min(F.struct("n", "i", "o")).alias("b"))
    return second.select("folded", F.col("a.i").alias("first_input"), F.col("b.i").alias("second_input"), F.col("a.o").alias("first_output"), F.col("b.o").alias("second_output"), (F.col("a.o") == F.col("b.o")).alias("same_case"))


def first_collision(files: DataFrame, formats: tuple[str, ...], out_dir: str | None = None) -> str | None:
    """One line on the first collision in the order of inputs, then formats; None if there is none."""
    lit_dir = None if out_dir is None else F.lit(out_dir)
    formats_array = F.array(*map(F.lit, formats))
    rows = files.select(F.col("path").alias("input"), F.posexplode(formats_array).alias("k", "fmt"))
    rows = rows.withColumn("output", output_path(F.col("input"), F.col("fmt"), lit_dir)).withColumn("n", F.struct("input", "k"))
    row = collisions(rows, order="n").join(rows.select(F.col("input").alias("second_input"), F.lower("output").alias("folded"), "k"), ["second_input", "folded"]).orderBy("second_input", "k").first()
    if row is None:
        return None
    if row["same_case"]:
        return f"{row['first_input']} and {row['second_input']} both write {row['second_output']}"
    return f"{row['first_input']} and {row['second_input']} write {row['first_output']} and {row['second_output']}, which are one file where case does not count"


def write_files(contents: DataFrame) -> DataFrame:
    """Writes ``output, content`` rows as files and returns ``output, n_bytes, error``; a file is written under
    another name and renamed, so a task may run twice, and a failure leaves no part of it. The folder has to be one
    that all executors see. Nothing is written before the result is used."""

    def run(batches):
        import os
        import uuid

        import pyarrow as pa

        for b in batches:
            sizes, errors = [], []
            for path, text in zip(b["output"].to_pylist(), b["content"].to_pylist(), strict=True):
                tmp, raw = f"{path}.{uuid.uuid4().hex}.tmp", text.encode()
                try:
                    with open(tmp, "wb") as f:
                        f.write(raw)
                    os.replace(tmp, path)
                    sizes.append(len(raw))
                    errors.append(None)
                except OSError as e:
                    if os.path.exists(tmp):
                        os.remove(tmp)
                    sizes.append(None)
                    errors.append(f"could not write {path}: {e.strerror}")
            yield pa.RecordBatch.from_arrays([b["output"], pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], ["output", "n_bytes", "error"])

    return contents.select("output", "content").mapInArrow(run, "output string, n_bytes long, error string")


def talk_time(turns: DataFrame, *, by: str = "file_id") -> DataFrame:
    """``by, speaker, seconds, turns``."""
    return turns.groupBy(by, "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("seconds"), F.count("*").alias("turns"))


def repeated_texts(lines: DataFrame, *, by: str = "file_id", text: str = "text", more_than: int = 2) -> DataFrame:
    """``by, text, n`` of trimmed texts that a file has more often: a transcript that loops."""
    return lines.groupBy(by, F.trim(F.col(text)).alias("text")).agg(F.count("*").alias("n")).filter(F.col("n") > more_than)

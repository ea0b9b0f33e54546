"""Who speaks when: windows in parallel, one clustering for each file, then frame algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import FRAMES, HOP, LOCAL_SPEAKERS, MIN_CLEAN_FRAMES, MIN_FEATURE_ROWS, POWERSET, WINDOW, num_chunks, num_global_frames
from ..functions.signal import features, select_rows
from ..operators.clustering import cluster_slots
from ..operators.frames import cluster_support, renumber, speaker_count, to_turns, top_clusters

SLOTS = "file_id long, chunk_no int, local_spk int, active boolean, embedding array<double>, frames array<int>, error string"


def windows(audio: DataFrame) -> DataFrame:
    """``file_id, chunk_no, window``: ten seconds every second; the last one may be short, an empty file has an empty one."""
    rows = audio.filter("samples is not null").select("file_id", "samples", F.explode(F.sequence(F.lit(0), num_chunks(F.size("samples")) - 1)).alias("chunk_no"))
    return rows.select("file_id", "chunk_no", F.slice("samples", F.col("chunk_no") * HOP + 1, WINDOW).alias("window"))


def slots(chunks: DataFrame, models) -> DataFrame:
    """Each window's local speakers: the frames they are on, and an embedding where there is enough of them.

    Silent speakers and short masks don't reach the embedding model."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kinds = pa.schema([("file_id", pa.int64()), ("chunk_no", pa.int32()), ("local_spk", pa.int32()), ("active", pa.bool_()), ("embedding", pa.list_(pa.float64())), ("frames", pa.list_(pa.int32())), ("error", pa.string())])
        table = np.array(POWERSET, bool)
        for b in batches:
            out = []
            for i, k, w in zip(b["file_id"].to_pylist(), b["chunk_no"].to_pylist(), b["window"], strict=True):
                x = np.zeros(WINDOW, np.float32)
                part = np.asarray(w.values) if w.is_valid else x[:0]
                x[: len(part)] = part
                try:
                    scores = np.asarray(models.segment(x))
                    scores = np.where(np.isnan(scores), np.where(np.arange(scores.shape[1]) == 0, np.inf, -np.inf), scores)
                    on = table[scores.argmax(1)]
                    rows = features(x)
                    for s in range(LOCAL_SPEAKERS):
                        clean = on[:, s] & (on.sum(1) < 2)
                        mask = clean if clean.sum() > MIN_CLEAN_FRAMES else on[:, s]
                        chosen = select_rows(rows, mask) if mask.any() else rows[:0]
                        v = models.embed(chosen) if len(chosen) >= MIN_FEATURE_ROWS else None
                        out.append((i, k, s, bool(on[:, s].any()), v, np.flatnonzero(on[:, s]).astype(np.int32), None))
                except Exception as e:  # a model failed: the file's error, not the job's
                    out += [(i, k, s, False, None, None, str(e)) for s in range(LOCAL_SPEAKERS)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    return chunks.select("file_id", "chunk_no", "window").mapInArrow(run, SLOTS)


def turns(slot_rows: DataFrame, labels: DataFrame, *, num_speakers: int | None = None) -> DataFrame:
    """``file_id, start, end, speaker`` from slots and their clusters. Files without a cluster have no turns."""
    files = slot_rows.groupBy("file_id").agg((F.max("chunk_no") + 1).alias("n_chunks")).withColumn("n_frames", num_global_frames(F.col("n_chunks")))
    clusters = labels.filter("cluster is not null").groupBy("file_id").agg((F.max("cluster") + 1).alias("n_clusters"))
    files = files.join(clusters, "file_id")
    active = slot_rows.join(files.select("file_id"), "file_id", "left_semi").select("file_id", "chunk_no", "local_spk", F.explode("frames").alias("frame_no"))
    counts = speaker_count(active, files, cap=num_speakers)
    support = cluster_support(active, labels.select("file_id", "chunk_no", "local_spk", "cluster"))
    return renumber(to_turns(top_clusters(support, counts, files.select("file_id", "n_clusters")), files))


def diarize(audio: DataFrame, models, *, num_speakers: int | None = None, checkpoint=None) -> tuple[DataFrame, DataFrame]:
    """Turns, and ``file_id, error`` of files that failed. ``checkpoint`` (a function of a DataFrame) keeps the
    slots, which both results need; without one they are cached."""
    rows = slots(windows(audio), models)
    rows = checkpoint(rows) if checkpoint else rows.cache()
    labels = cluster_slots(rows, num_speakers=num_speakers)
    labels = checkpoint(labels) if checkpoint else labels.cache()
    errors = rows.select("file_id", "error").unionByName(labels.select("file_id", "error")).filter("error is not null").groupBy("file_id").agg(F.min("error").alias("error"))
    good = rows.join(errors, "file_id", "left_anti")
    return turns(good, labels, num_speakers=num_speakers), errors


__all__ = ["FRAMES", "diarize", "slots", "turns", "windows"]

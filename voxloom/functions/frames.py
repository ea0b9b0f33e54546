"""Frame arithmetic and masks, native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the segmentation model: samples a second, window and hop in samples, frames of a window,
#: speakers and classes of a frame.
RATE, WINDOW, HOP, FRAMES, LOCAL_SPEAKERS, CLASSES = 16_000, 160_000, 16_000, 589, 3, 7
FRAME_SECONDS = 10 / 589
#: Who is on in each class, by rising size of the set, then by speaker.
POWERSET = ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1))
#: A mask without overlap counts from more frames than this; an embedding needs this many feature rows.
MIN_CLEAN_FRAMES, MIN_FEATURE_ROWS = 10, 25


def num_chunks(samples: Column) -> Column:
    """Windows of a signal: whole ones, and one padded tail where something is left; at least one."""
    over = samples - WINDOW
    return F.when(over < 0, 1).otherwise(F.call_function("div", over, F.lit(HOP)) + 1 + F.when(F.pmod(over, F.lit(HOP)) != 0, 1).otherwise(0)).cast("int")


def closest_frame(seconds: Column) -> Column:
    """Index of the frame whose middle is nearest, ties to even, not below 0."""
    return F.greatest(F.rint(seconds / F.lit(FRAME_SECONDS) - 0.5), F.lit(0.0)).cast("int")


def chunk_start_frame(chunk: Column) -> Column:
    return closest_frame(chunk.cast("double"))


def num_global_frames(chunks: Column) -> Column:
    """Frames of a file of so many windows."""
    return (closest_frame(10 + chunks.cast("double") - 1) + 1).cast("int")


def powerset_argmax(scores: Column) -> Column:
    """Index of the first largest score; a score that is not a number never wins over the first."""
    clean = F.transform(scores, lambda x: F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(x))
    best = F.array_position(clean, F.array_max(clean)).cast("int") - 1
    return F.when(F.isnan(scores[0]), 0).otherwise(best)


def decode_frame(scores: Column) -> Column:
    """Who is on, as an array of booleans."""
    table = F.array(*[F.array(*[F.lit(bool(x)) for x in row]) for row in POWERSET])
    return table[powerset_argmax(scores)]


def choose_mask(frames: Column, speaker: Column) -> Column:
    """Of an array of frames (arrays of booleans): those of the speaker alone if more than 10, else all of theirs."""
    on = lambda f: f[speaker]
    clean = F.transform(frames, lambda f: on(f) & (F.size(F.filter(f, lambda x: x)) < 2))
    return F.when(F.size(F.filter(clean, lambda x: x)) > MIN_CLEAN_FRAMES, clean).otherwise(F.transform(frames, on))


def nearest_upsample(index: Column, source: Column | int, total: Column) -> Column:
    """Which of ``source`` mask frames row ``index`` of ``total`` falls on."""
    source = source if isinstance(source, Column) else F.lit(source)
    return F.least(F.call_function("div", index.cast("long") * source, total.cast("long")), source - 1).cast("int")


def frame_middle(frame: Column) -> Column:
    return (frame + 0.5) * F.lit(10.0) / F.lit(589.0)

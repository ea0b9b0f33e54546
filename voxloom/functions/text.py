"""Scalar functions of transcripts, native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Segments above this probability of silence go; compared in single precision.
NO_SPEECH = 0.6


def unicode_trim(c: Column) -> Column:
    """Without Unicode white space at either end; ``trim`` takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def speech_filter(no_speech: Column, text: Column) -> Column:
    """Whether a raw segment stays: likely speech, and not blank."""
    return (no_speech.cast("float") <= F.lit(NO_SPEECH).cast("float")) & (unicode_trim(text) != "")


def is_special_token(token: Column) -> Column:
    """In brackets as it stands, or blank."""
    return (token.startswith("[") & token.endswith("]")) | (unicode_trim(token) == "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalize_language(c: Column) -> Column:
    """Lower case; blank is unset. Not trimmed."""
    return F.when(unicode_trim(c) != "", ascii_lower(c))


def reported_language(asked: Column, detected: Column) -> Column:
    """What was asked for unless that was ``auto`` or nothing, else what was detected."""
    asked = normalize_language(asked)
    return F.coalesce(F.when(asked != "auto", asked), detected)


def speaker_label(speaker: Column) -> Column:
    """For machines, from 0."""
    return F.when(speaker.isNotNull(), F.format_string("SPEAKER_%02d", speaker.cast("long")))


def speaker_name(speaker: Column) -> Column:
    """For people, from 1."""
    return F.when(speaker.isNotNull(), F.format_string("Speaker %d", speaker.cast("long") + 1))


def milliseconds(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("long")


def timestamp(seconds: Column, mark: str) -> Column:
    """``HH:MM:SS`` mark ``mmm``; hours unbounded, negative times are 0."""
    ms = milliseconds(F.greatest(seconds, F.lit(0.0)))
    part = lambda unit, base: F.floor(ms / unit).cast("long") % base
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000).cast("long"), part(60_000, 60), part(1000, 60), ms % 1000)


def vtt_escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def csv_field(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def one_decimal(numerator: Column, denominator: Column) -> Column:
    """A ratio of whole numbers with one decimal, ties to even, by whole numbers alone."""
    whole = F.call_function("div", numerator, denominator)
    over = (numerator - whole * denominator) * 10
    tenths = whole * 10 + F.call_function("div", over, denominator)
    rest = F.pmod(over, denominator) * 2
    tenths = tenths + F.when((rest > denominator) | ((rest == denominator) & (tenths % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"))


def human_size(size: Column) -> Column:
    """Bytes with binary units and one decimal; plain below 1 KiB; units end with PB."""
    size = size.cast("long")
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        out = F.when(size >= 1024**k, F.concat(one_decimal(size, F.lit(1024**k)), F.lit(f" {unit}"))).otherwise(out)
    return out


def one_decimal_of_double(x: Column) -> Column:
    """A double with one decimal, rounded by its exact value, ties to even: ten times it is the sum of two exact
    products, and what that sum rounds away decides where it looks like a tie."""

    def tenths(r):
        big, small = r * 8, r * 2
        return F.struct((big + small).alias("ten"), (small - (big + small - big)).alias("lost"))

    def text(t):
        ten, low = t["ten"], F.floor(t["ten"])
        tie = (ten - low) == 0.5
        n = F.when(tie & (t["lost"] > 0), low + 1).when(tie & (t["lost"] < 0), low).otherwise(F.rint(ten)).cast("long")
        return F.concat(F.call_function("div", n, F.lit(10)).cast("string"), F.lit("."), (n % 10).cast("string"))

    return F.transform(F.transform(F.array(x), tenths), text)[0]  # the arrays bind values that are used many times


def realtime_factor(audio: Column, wall: Column) -> Column:
    """``x.y×RT``, null where no time has passed."""
    return F.concat(one_decimal_of_double(audio / F.when(wall > 0, wall)), F.lit("×RT"))


def sha256_matches(content: Column, expected: Column) -> Column:
    return F.sha2(content, 256) == F.lower(expected)


def file_stem(path: Column) -> Column:
    """Last part without its last extension; a leading dot is no extension."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")


def output_path(path: Column, fmt: Column, out_dir: Column | None = None) -> Column:
    """``<stem>.<format>`` in ``out_dir``, or beside the input."""
    folder = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1) if out_dir is None else out_dir
    name = F.concat(file_stem(path), F.lit("."), fmt)
    return F.when(folder == "", F.when(path.startswith("/") & (F.lit(out_dir is None)), F.concat(F.lit("/"), name)).otherwise(name)).otherwise(F.concat(F.regexp_replace(folder, "/$", ""), F.lit("/"), name))


def word_error_rate(reference: str, hypothesis: str) -> float:
    """Edits between lower-cased words without punctuation, by the reference's number of words."""
    clean = lambda s: [w for w in ("".join(c for c in x if c.isalnum()).lower() for x in s.split()) if w]
    want, got = clean(reference), clean(hypothesis)
    if not want:
        return 1.0 if got else 0.0
    return edit_distance(want, got) / len(want)


def edit_distance(a: list, b: list) -> int:
    """Least insertions, deletions and replacements from ``a`` to ``b``: a column of the table of distances is held as two
    numbers, a bit for each place in ``a`` where the distance goes up or down by one, so a step is a few operations."""
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every, last = (1 << len(a)) - 1, len(a) - 1
    up, down, distance = every, 0, len(a)
    for x in b:
        same = places.get(x, 0)
        level = (((same & up) + up) ^ up) | same | down
        right_up, right_down = (down | ~(level | up)) & every, level & up
        distance += (right_up >> last & 1) - (right_down >> last & 1)
        right_up, right_down = right_up << 1 | 1, right_down << 1
        up, down = (right_down | ~(level | right_up)) & every, right_up & level & every
    return distance

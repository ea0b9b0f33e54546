"""Queries over the test tables, one for each operator or family of them. There is no audio in these tables:
conversations stand for files with segments, events for frame activity, embeddings for vectors and signals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import error_column
from .functions import frames as fr
from .functions import text as tx
from .functions import vectors as ve
from .operators import batch, clustering, frames, intervals, outputs, subtitles, words
from .session import table
from .sources import discovery, models

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- proxies ------------------------------------------------------------------------------------------------


def _timeline(spark, sf_dir) -> DataFrame:
    """Conversations with ``base`` (length of what came before) and ``len``, in ms of 10 a character."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "conversations").withColumn("len", 10 * F.length("text").cast("long"))
    return rows.withColumn("base", F.coalesce(F.sum("len").over(before), F.lit(0).cast("long")))


def _segments(spark, sf_dir) -> DataFrame:
    start = F.col("base") - 300 * (F.col("turn") % 2)
    return _timeline(spark, sf_dir).select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seg_no"), "text", start.alias("start"), (start + F.col("len")).alias("end"))


def _turns(spark, sf_dir, roles=("user", "assistant")) -> DataFrame:
    rows = _timeline(spark, sf_dir).filter(F.col("role").isin(*roles))
    start = F.col("base") + 900 * (F.col("turn") % 3)
    speaker = F.when(F.col("role") == "user", 0).otherwise(1)
    return rows.select(F.col("conv_id").alias("file_id"), start.alias("start"), (start + F.col("len") - 400).alias("end"), speaker.alias("speaker"))


def _spoken(spark, sf_dir) -> DataFrame:
    """Attributed segments, times in seconds."""
    rows = intervals.dominant_speaker(_segments(spark, sf_dir), _turns(spark, sf_dir))
    return rows.withColumns({"start": F.col("start") / 1000.0, "end": F.col("end") / 1000.0})


def _vectors(spark, sf_dir) -> DataFrame:
    """Embeddings as slots of five files, label as cluster."""
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("file_id"), "vec_id", F.col("label").alias("cluster"), "embedding")


def _frames(spark, sf_dir) -> DataFrame:
    """Events numbered within each user, as frames with one speaker each."""
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kinds = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
    cluster = F.lit(None).cast("int")
    for k, v in kinds.items():
        cluster = F.when(F.col("event_type") == k, v).otherwise(cluster)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), (F.row_number().over(line) - 1).alias("frame"), cluster.alias("cluster"), "value")


def _activity(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Long-form activity from events: window ``value % 4``, local speaker by kind; files of four windows."""
    rows = _frames(spark, sf_dir)
    whole = F.floor(F.col("value")).cast("int")
    active = rows.select("file_id", (whole % 4).alias("chunk_no"), (F.col("frame") * 7 % fr.FRAMES).cast("int").alias("frame_no"), (F.col("cluster") % 3).alias("local_spk")).distinct()
    return active, rows.select("file_id").distinct().withColumn("n_chunks", F.lit(4))


def _labels(spark, sf_dir) -> DataFrame:
    """A cluster for each slot: two local speakers share one in every other window."""
    _, files = _activity(spark, sf_dir)
    slot = files.select("file_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("chunk_no")).withColumn("local_spk", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return slot.withColumn("cluster", F.when((F.col("chunk_no") % 2 == 0) & (F.col("local_spk") == 2), 0).otherwise(F.col("local_spk")))


# --- segments and speakers ----------------------------------------------------------------------------------


@query
def segments_from_conversations(spark, sf_dir):
    rows = _segments(spark, sf_dir).withColumn("text", tx.unicode_trim(F.col("text"))).filter("text <> ''")
    return rows.select("file_id", "seg_no", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), F.length("text").cast("long").alias("n_chars"))


@query
def no_speech_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    raw = rows.select("event_id", (F.col("value") / 500).cast("float").alias("no_speech"), F.concat(F.lit(" "), F.col("event_type")).alias("text"), (F.col("event_id") * 100).alias("start_cs"), (F.col("event_id") * 100 + 50).alias("end_cs"))
    return words.filter_segments(raw)


@query
def dominant_speaker_segments(spark, sf_dir):
    rows = intervals.dominant_speaker(_segments(spark, sf_dir), _turns(spark, sf_dir))
    return rows.select("file_id", "seg_no", "speaker")


@query
def dominant_speaker_bins(spark, sf_dir):
    rows = intervals.dominant_speaker(_segments(spark, sf_dir), _turns(spark, sf_dir), bin_width=2000)
    return rows.select("file_id", "seg_no", "speaker")


@query
def dominant_speaker_none(spark, sf_dir):
    rows = intervals.dominant_speaker(_segments(spark, sf_dir), _turns(spark, sf_dir, ("assistant",)))
    return rows.select("file_id", "seg_no", "speaker")


@query
def dominant_speaker_words(spark, sf_dir):
    parts = F.filter(F.split("text", " "), lambda w: w != "")
    rows = intervals.with_overlapping_turns(_segments(spark, sf_dir), _turns(spark, sf_dir), bin_width=60_000).withColumn("w", parts).withColumn("n", F.size("w").cast("long"))
    rows = rows.select("file_id", "seg_no", "start", "end", "turns", "n", F.posexplode("w").alias("word_no", "word"))
    share = lambda k: F.col("start") + F.call_function("div", (F.col("end") - F.col("start")) * k, F.col("n"))
    rows = rows.withColumns({"from": share(F.col("word_no")), "to": share(F.col("word_no") + 1)})
    return rows.select("file_id", "seg_no", "word_no", "word", intervals.speaker_within(F.col("from"), F.col("to"), F.col("turns")).alias("speaker"))


@query
def sanitize_timestamps(spark, sf_dir):
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(line).cast("long"))
    value = F.round(F.col("value") * 10).cast("long")
    start = F.col("n") * 1000 - value
    seg = rows.select(F.col("user_id").alias("file_id"), F.col("n").alias("seg_no"), start.alias("start"), (start + 2500 - value % 4000).alias("end"))
    return subtitles.sanitized(seg).select("file_id", "seg_no", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))


def _rendered(fmt, **how):
    def run(spark, sf_dir):
        return subtitles.render(_spoken(spark, sf_dir), fmt, **how)

    return run


for _name, _fmt, _how in (("txt_lines", "txt", {}), ("srt_cues", "srt", {}), ("vtt_cues", "vtt", {}), ("tsv_rows", "tsv", {"diarized": True}), ("csv_rows", "csv", {"diarized": True}), ("tsv_rows_plain", "tsv", {})):
    QUERIES[_name] = _rendered(_fmt, **_how)


@query
def json_document_fields(spark, sf_dir):
    rows = _spoken(spark, sf_dir).withColumns({"language": F.lit("en"), "duration": F.lit(60.0)})
    docs = subtitles.render(rows, "json")
    shape = "struct<schema_version:int,model:string,language:string,duration:double,segments:array<struct<start:double,end:double,text:string,speaker:string>>>"
    d = docs.select("file_id", F.from_json("content", shape).alias("d")).select("file_id", "d.schema_version", "d.model", "d.language", F.posexplode("d.segments").alias("at", "s"))
    return d.select("file_id", "schema_version", "model", "language", "at", F.round("s.start", 3).alias("start"), F.round("s.end", 3).alias("end"), "s.text", "s.speaker")


@query
def group_words(spark, sf_dir):
    pieces = F.regexp_extract_all("text", F.lit(r" ?[^ ]{1,4}"), F.lit(0))
    tokens = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seg_no"), F.posexplode(pieces).alias("tok_no", "text"))
    tokens = tokens.withColumn("text", F.when(F.col("tok_no") % 11 == 3, "[_BEG_]").when(F.col("tok_no") % 13 == 5, " ").otherwise(F.col("text")))
    tokens = tokens.withColumns({"t0_cs": F.col("tok_no").cast("long") * 10, "t1_cs": F.col("tok_no").cast("long") * 10 + 8})
    return words.group_words(tokens)


@query
def normalize_language(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    asked = F.element_at(F.array(F.upper("lang"), F.lit(" "), F.lit("AUTO"), F.lit(None).cast("string"), F.concat(F.col("lang"), F.lit(" "))), (F.col("doc_id") % 5 + 1).cast("int"))
    return rows.select("doc_id", tx.normalize_language(asked).alias("normalized"), tx.reported_language(asked, F.col("lang")).alias("reported"))


@query
def speaker_labels(spark, sf_dir):
    ids = F.dense_rank().over(Window.partitionBy("conv_id").orderBy("role")) - 1
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", ids.alias("speaker"))
    return rows.select("conv_id", "turn", tx.speaker_label(F.col("speaker")).alias("label"), tx.speaker_name(F.col("speaker")).alias("name"))


@query
def timestamps(spark, sf_dir):
    seconds = F.round(F.col("value") * 100).cast("long") / 4.0 - 60
    return table(spark, sf_dir, "events").select("event_id", tx.timestamp(seconds, ",").alias("srt"), tx.timestamp(seconds, ".").alias("vtt"), tx.milliseconds(seconds).alias("ms"))


# --- frames and turns ---------------------------------------------------------------------------------------


@query
def hopping_windows_full_tail(spark, sf_dir):
    line = Window.partitionBy("user_id").orderBy("event_id", "ts", "value")
    total = F.sum("value").over(line.rowsBetween(Window.unboundedPreceding, 0))  # added up in order: sums near a half round as their last bits say
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", total.alias("total"), F.row_number().over(line).alias("at"))
    files = rows.groupBy("user_id").agg((F.max("event_id") - F.min("event_id") + F.round(F.max_by("total", "at")).cast("long")).alias("n")).withColumn("n_samples", F.col("n") * 100)
    rows = frames.chunk_plan(files)
    return rows.select(F.col("user_id").alias("file_id"), "n_samples", "chunk_no", "start_sample")


@query
def frame_grid(spark, sf_dir):
    seconds = F.col("value")
    chunks = (F.floor("value") + 1).cast("int")
    return table(spark, sf_dir, "events").select("event_id", fr.closest_frame(seconds).alias("frame"), fr.chunk_start_frame(chunks).alias("chunk_start"), fr.num_global_frames(chunks).alias("n_frames"))


@query
def frame_speaker_count(spark, sf_dir):
    active, files = _activity(spark, sf_dir)
    return frames.speaker_count(active, files).groupBy("file_id", "n").agg(F.count("*").alias("frames"), F.sum("frame").alias("sum_frames"))


@query
def cluster_support(spark, sf_dir):
    active, _ = _activity(spark, sf_dir)
    return frames.cluster_support(active, _labels(spark, sf_dir))


@query
def topk_by_row_limit(spark, sf_dir):
    active, files = _activity(spark, sf_dir)
    counts = frames.speaker_count(active, files)
    support = frames.cluster_support(active, _labels(spark, sf_dir))
    return frames.top_clusters(support, counts, files.select("file_id", F.lit(3).alias("n_clusters")))


def _frame_turns(spark, sf_dir) -> DataFrame:
    rows = _frames(spark, sf_dir)
    files = rows.groupBy("file_id").agg(F.count("*").alias("n_frames"))
    return frames.to_turns(rows.select("file_id", "frame", "cluster"), files)


@query
def turns_gaps_islands(spark, sf_dir):
    return _frame_turns(spark, sf_dir).select("file_id", "cluster", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query
def turns_renumbered(spark, sf_dir):
    return frames.renumber(_frame_turns(spark, sf_dir)).select("file_id", "speaker", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query
def speaker_talk_time(spark, sf_dir):
    rows = outputs.talk_time(frames.renumber(_frame_turns(spark, sf_dir)))
    return rows.select("file_id", "speaker", F.round("seconds", 6).alias("seconds"), "turns")


@query
def powerset_argmax(spark, sf_dir):
    scores = F.slice("embedding", 1, fr.CLASSES)
    on = fr.decode_frame(scores)
    return table(spark, sf_dir, "embeddings").select("vec_id", fr.powerset_argmax(scores).alias("class"), *[on[k].alias(f"spk{k}") for k in range(3)])


@query
def overlap_free_mask(spark, sf_dir):
    on = lambda k: F.floor(F.col("value") / (k + 2)).cast("int") % (k + 2) == 0
    rows = _frames(spark, sf_dir).withColumn("f", F.array(on(0), on(1), on(2)))
    lists = rows.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "f"))), lambda x: x["f"]).alias("frames"))
    rows = lists.withColumn("speaker", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    mask = fr.choose_mask(F.col("frames"), F.col("speaker"))
    return rows.select("file_id", "speaker", F.array_join(F.transform(mask, lambda x: x.cast("int").cast("string")), "").alias("mask"))


@query
def nearest_upsample(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    total = (F.col("vec_id") % 40 + 64).cast("long")
    return rows.select("vec_id", "i", fr.nearest_upsample(F.col("i"), 64, total).alias("src"))


# --- vectors ------------------------------------------------------------------------------------------------


@query
def l2_normalize(spark, sf_dir):
    v = ve.doubles(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(ve.l2_normalized(v)).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


def _neighbours(spark, sf_dir, distance, name) -> DataFrame:
    """Distance of each vector to the one before it under its label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", ve.doubles(F.col("embedding")).alias("v"))
    line = Window.partitionBy("label").orderBy("vec_id")
    rows = rows.withColumns({"before": F.lag("v").over(line), "other_id": F.lag("vec_id").over(line)}).filter("before is not null")
    return rows.select("vec_id", "other_id", F.round(distance(F.col("v"), F.col("before")), 6).alias(name))


@query
def cosine_neighbours(spark, sf_dir):
    return _neighbours(spark, sf_dir, ve.cosine_distance, "cosine")


@query
def euclidean_neighbours(spark, sf_dir):
    return _neighbours(spark, sf_dir, ve.euclidean, "euclidean")


@query
def centroids_raw_mean(spark, sf_dir):
    rows = clustering.centroids(_vectors(spark, sf_dir))
    return rows.select("file_id", "cluster", F.posexplode("centroid").alias("i", "x")).select("file_id", "cluster", "i", F.round("x", 6).alias("x"))


@query
def nearest_centroid(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return clustering.nearest_centroid(rows, clustering.centroids(rows)).select("file_id", "vec_id", "nearest")


@query
def absorb_small_clusters(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    sizes = rows.groupBy("file_id", "cluster").count()
    least = sizes.groupBy("file_id").agg(F.ceil(F.avg("count")).alias("least"))
    return clustering.absorb_small_clusters(rows, least).select("file_id", "cluster", "absorbed")


#: Length of the frames of ``power_spectrum_64`` and bands of ``mel_energy``.
_N, _BANDS = 64, 8


def mel_weights() -> list[list[float]]:
    from .functions.signal import mel_banks

    return [[round(float(x), 6) for x in row] for row in mel_banks(_BANDS, _N, 16_000, 20.0, 8000.0)]


def _spectrum(v):
    wave = lambda k, f: F.aggregate(F.zip_with(v, F.sequence(F.lit(0), F.lit(_N - 1)), lambda x, n: x * f(F.lit(2 * math.pi / _N) * k * n)), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.sequence(F.lit(0), F.lit(_N // 2 - 1)), lambda k: F.pow(wave(k, F.cos), F.lit(2.0)) + F.pow(wave(k, F.sin), F.lit(2.0)))


@query
def power_spectrum_64(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(_spectrum(ve.doubles(F.col("embedding")))).alias("k", "p"))
    return rows.select("vec_id", "k", F.round("p", 6).alias("power"))


@query
def mel_energy(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", _spectrum(ve.doubles(F.col("embedding"))).alias("p"))
    banks = F.array(*[F.array(*map(F.lit, row)) for row in mel_weights()])
    energy = F.transform(banks, lambda w: F.log(F.greatest(ve.dot(F.col("p"), w), F.lit(1.1920929e-07))))
    return rows.select("vec_id", F.posexplode(energy).alias("band", "e")).select("vec_id", "band", F.round("e", 6).alias("energy"))


@query
def cmn(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(ve.doubles(F.col("embedding"))).alias("i", "x"))
    mean = F.avg("x").over(Window.partitionBy("label", "i"))
    return rows.select("vec_id", "i", F.round(F.col("x") - mean, 6).alias("x"))


@query
def downmix_stereo(spark, sf_dir):
    v = ve.doubles(F.col("embedding"))
    mono = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(v), F.lit(2)).cast("int") - 1), lambda k: (v[2 * k] + v[2 * k + 1]) / 2)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(mono).alias("i", "x")).select("vec_id", "i", F.round("x", 9).alias("x"))


@query
def hac_centroid(spark, sf_dir):
    """Vectors drawn to a direction of their label, so that there is something to find."""
    rows = _vectors(spark, sf_dir).withColumn("e", ve.doubles(F.col("embedding")))
    pull = F.transform(F.sequence(F.lit(0), F.size("e") - 1), lambda k: F.when(k == F.col("cluster"), 2.3).otherwise(0.0))
    slot = rows.select("file_id", F.col("vec_id").alias("chunk_no"), F.lit(0).alias("local_spk"), F.lit(True).alias("active"), F.zip_with(F.transform("e", lambda x: x * 0.3), pull, lambda a, b: a + b).alias("embedding"))
    return clustering.cluster_slots(slot).select("file_id", F.col("chunk_no").alias("vec_id"), "cluster", "error")


@query
def resample_length(spark, sf_dir):
    n = F.round(F.col("value") * 100).cast("long")
    rate = F.element_at(F.array(*map(F.lit, (8000, 16_000, 44_100, 48_000))), (F.col("event_id") % 4 + 1).cast("int")).cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.call_function("div", n * 16_000 + rate - 1, rate).alias("n_out"), (F.call_function("div", n * 16_000 + rate - 1, rate) > 20_000).alias("too_long"))


# --- outputs, batches, resources ----------------------------------------------------------------------------


def _paths(spark, sf_dir) -> DataFrame:
    """Pages as files: last part of the URL and an extension."""
    exts = ["wav", "MP3", "flac", "txt", "Ogg", "m4a", "pdf", "M4B", "", "wav.bak"]
    name = F.regexp_extract("url", r"([^/]*)$", 1)
    ext = F.element_at(F.array(*map(F.lit, exts)), (F.col("page_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/in/"), F.col("page_id") % 3, F.lit("/"), name, F.lit("."), ext).alias("path"))


@query
def discover_by_extension(spark, sf_dir):
    rows = _paths(spark, sf_dir).filter(discovery.is_audio_column(F.col("path")))
    return rows.select("page_id", "path", tx.file_stem(F.col("path")).alias("stem"), tx.output_path(F.col("path"), F.lit("srt")).alias("beside"), tx.output_path(F.col("path"), F.lit("srt"), F.lit("/out")).alias("in_out_dir"))


@query
def collision_check(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("input"), F.regexp_extract("url", r"([^/?#.]*)[^/]*$", 1).alias("output"))
    rows = rows.withColumn("output", F.when(F.col("input") % 2 == 0, F.upper("output")).otherwise(F.col("output")))
    return outputs.collisions(rows)


def _freshness(spark, sf_dir):
    inputs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"))
    out = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("string").alias("format"), F.col("l_shipdate").alias("mtime"))
    return inputs, out


@query
def up_to_date_outputs(spark, sf_dir):
    return outputs.fresh_inputs(*_freshness(spark, sf_dir))


@query
def stale_inputs_anti(spark, sf_dir):
    return outputs.stale_inputs(*_freshness(spark, sf_dir)).select("path")


def _results(spark, sf_dir) -> DataFrame:
    what = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "skipped").otherwise("failed")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), (cents / 4.0).alias("duration"), (F.col("o_orderkey") % 7).cast("double").alias("wall"), what.alias("outcome"))


@query
def batch_summary(spark, sf_dir):
    return batch.summary(_results(spark, sf_dir)).select("done", "skipped", "failed", "audio", "wall")


@query
def batch_exit_code(spark, sf_dir):
    rows = _results(spark, sf_dir).withColumn("batch", F.col("name") % 50)
    counts = rows.groupBy("batch").agg(F.count_if(F.col("outcome") == "failed").alias("failed"), F.count("*").alias("processed"))
    return counts.select("batch", "failed", "processed", batch.exit_code(F.col("failed"), F.col("processed"), F.lit(320).cast("long"), F.col("batch") % 2 == 0).alias("exit_code"))


@query
def file_outcomes(spark, sf_dir):
    pick = lambda n, k, text: F.when(F.col("event_id") % n == k, F.concat(F.lit(text), F.col("event_type")))
    status = F.when(F.col("event_id") % 11 == 0, "skip").when(F.col("event_id") % 13 == 0, "failed").otherwise("pcm")
    what, why = batch.outcome(status, pick(7, 1, "run: "), pick(5, 2, "speakers: "), pick(17, 3, "write: "))
    return table(spark, sf_dir, "events").select("event_id", what.alias("outcome"), F.when(status == "pcm", why).alias("reason"))


@query
def report_lines(spark, sf_dir):
    rows = _results(spark, sf_dir).withColumns({"language": F.lit("en"), "outputs": F.array(F.concat(F.lit("/out/"), F.col("name"), F.lit(".srt"))), "reason": F.concat(F.lit("code "), F.col("name") % 3)})
    return batch.report_lines(rows)


@query
def realtime_factor(spark, sf_dir):
    audio, wall = F.col("l_quantity"), F.when(F.col("l_linenumber") == 3, 0.0).otherwise(F.col("l_linenumber").cast("double") * 8)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tx.realtime_factor(audio * 1.0, wall).alias("speed"))


def _machines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size").cast("long") * (1 << 30)).alias("ram"), (F.col("p_partkey") % 9).alias("jobs"), F.when(F.col("p_partkey") % 2 == 0, models.DIARIZATION_RESIDENT).otherwise(0).cast("long").alias("extra"))


@query
def largest_fitting_model(spark, sf_dir):
    return models.largest_fitting(_machines(spark, sf_dir)).select("p_partkey", "model")


@query
def memory_guard(spark, sf_dir):
    rows = _machines(spark, sf_dir).withColumn("m", F.explode(F.array(*[F.struct(F.lit(m[0]).alias("model"), F.lit(m[2]).cast("long").alias("size")) for m in models.MODELS]))).select("*", "m.*")
    need = models.estimated_memory(F.col("size"), F.col("jobs")) + F.col("extra")
    return rows.select("p_partkey", "model", need.alias("need"), models.would_exceed(F.col("ram"), F.col("size"), F.col("jobs"), F.col("extra")).alias("refused"), models.max_jobs_fitting(F.col("ram"), F.col("size"), F.col("extra")).alias("max_jobs"))


@query
def model_registry(spark, sf_dir):
    rows = models.registry(spark)
    return rows.select("model", "file", "size", "multilingual", "can_translate", tx.human_size(F.col("size")).alias("human"))


@query
def wer_documents(spark, sf_dir):
    """Error rate of each document's text against that of the one before it, over both whole texts."""
    line = Window.partitionBy("source", "lang").orderBy("doc_id")  # of ids only; texts are joined by id
    docs = table(spark, sf_dir, "documents")
    pairs = docs.select("doc_id", "source", "lang").select("doc_id", F.lag("doc_id").over(line).alias("before_id")).filter("before_id is not null")
    rows = docs.select("doc_id", F.col("text").alias("got")).join(pairs, "doc_id")
    rows = rows.join(docs.select(F.col("doc_id").alias("before_id"), F.col("text").alias("want")), "before_id").filter("want is not null")
    wer = F.pandas_udf(lambda a, b: a.combine(b, tx.word_error_rate), "double")
    return rows.select("doc_id", wer("want", "got").alias("wer"))


@query
def repetition_loop(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return outputs.repeated_texts(lines, by="doc_id", text="line")


@query
def sha256_text(spark, sf_dir):
    digest = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select("doc_id", digest.alias("sha256"), tx.sha256_matches(F.col("text"), F.upper(digest)).alias("same"))


@query
def human_size(spark, sf_dir):
    size = F.col("n_chars") * F.element_at(F.array(*[F.lit(7**k).cast("long") for k in range(0, 14, 2)]), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), tx.human_size(size).alias("human"))


@query
def error_rows(spark, sf_dir):
    kinds = ["unsupported_codec", "file_not_found", "io", "transcription_failed", "diarization_failed", "none"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 6 + 1).cast("int"))
    e = error_column(kind, F.col("event_type"), F.concat(F.lit("/in/"), F.col("event_id")))
    return table(spark, sf_dir, "events").select("event_id", e["code"].alias("code"), e["message"].alias("message"))


@query
def activity_by_hour(spark, sf_dir):
    """The streaming aggregate, over the table at rest."""
    from .streaming.folder import activity_windows

    rows = activity_windows(table(spark, sf_dir, "events"))
    return rows.select(F.unix_timestamp("w.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which speaker owns each segment, as SRT cues by conversation."""
    return QUERIES["srt_cues"](spark, sf_dir)

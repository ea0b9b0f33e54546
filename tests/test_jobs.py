import json
import os
import signal
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_signal_and_sources import tone, wav

from voxloom.errors import EngineError, error_column
from voxloom.functions import text as tx
from voxloom.operators import batch, outputs, subtitles
from voxloom.options import JobOptions
from voxloom.plans import diarize, transcribe
from voxloom.plans.models import StubSpeakers, StubTranscriber
from voxloom.streaming import folder


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_texts(spark):
    assert one(spark, tx.timestamp(F.lit(3661.0005), ",")) == "01:01:01,001" and one(spark, tx.timestamp(F.lit(-5.0), ".")) == "00:00:00.000"
    assert one(spark, tx.timestamp(F.lit(360_000.0), ",")) == "100:00:00,000"
    assert one(spark, tx.vtt_escape(F.lit("a<b>&amp;"))) == "a&lt;b&gt;&amp;amp;"
    assert one(spark, tx.csv_field(F.lit('say "x",\n'))) == '"say ""x"",\n"'
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB", 1536: "1.5 KB", 77_691_713: "74.1 MB", 2**60: "1024.0 PB"}
    assert {k: one(spark, tx.human_size(F.lit(k).cast("long"))) for k in sizes} == sizes
    for audio, wall in ((1.25, 1.0), (0.35, 1.0), (0.65, 1.0), (0.25, 1.0), (55.8, 1.8), (1e6, 3.0), (0.05, 1.0), (2.675, 1.0)):
        assert one(spark, tx.realtime_factor(F.lit(audio), F.lit(wall))) == f"{audio / wall:.1f}×RT"
    assert one(spark, tx.realtime_factor(F.lit(1.0), F.lit(0.0))) is None
    stems = {"/a/b.tar.gz": "b.tar", "x.wav": "x", "/d/.hidden": ".hidden", "/d/noext": "noext", "/d/": "d"}
    assert {k: one(spark, tx.file_stem(F.lit(k))) for k in stems} == stems
    paths = {"/a/b.wav": "/a/b.srt", "b.wav": "b.srt", "/b.wav": "/b.srt", "d/b.c.wav": "d/b.c.srt"}
    assert {k: one(spark, tx.output_path(F.lit(k), F.lit("srt"))) for k in paths} == paths
    assert one(spark, tx.output_path(F.lit("/a/b.wav"), F.lit("srt"), F.lit("/o"))) == "/o/b.srt"


def test_error_column(spark):
    e = one(spark, error_column(F.lit("unsupported_codec"), F.lit("d{path}"), F.lit("/x")))
    assert e["code"] == 10 and e["message"].startswith("cannot decode /x: d")
    assert one(spark, error_column(F.lit(None).cast("string"), F.lit("d"), F.lit("/x"))) is None


def test_rendering(spark):
    rows = [(1, 1, 0.5, 2.0, "Hi & <you>", 0, [(0.5, 1.0, "Hi", 0)]), (1, 2, 1.0, 1.5, 'a "b"', None, []), (1, 10, -3.0, -1.0, "c\td", 11, None)]
    df = spark.createDataFrame([(*r, "en", 9.0) for r in rows], "file_id long, seg_no int, start double, end double, text string, speaker int, words array<struct<start:double,end:double,text:string,speaker:int>>, language string, duration double")
    out = {f: subtitles.render(df, f, diarized=True).first()["content"] for f in ("txt", "srt", "vtt", "tsv", "csv", "json")}
    assert out["txt"] == 'Speaker 1: Hi & <you>\na "b"\nSpeaker 12: c\td\n'
    assert out["srt"].startswith("1\n00:00:00,500 --> 00:00:02,000\nSpeaker 1: Hi & <you>\n\n2\n00:00:02,000 --> 00:00:02,000\n")
    assert out["vtt"].startswith("WEBVTT\n\n00:00:00.500 --> 00:00:02.000\n<v Speaker 1>Hi &amp; &lt;you&gt;\n\n")
    assert out["tsv"] == 'start\tend\ttext\tspeaker\n500\t2000\tHi & <you>\tSPEAKER_00\n2000\t2000\ta "b"\t\n2000\t2000\tc\td\tSPEAKER_11\n'
    assert out["csv"].split("\n")[2] == '2000,2000,"a ""b""",'
    doc = json.loads(out["json"])
    assert (doc["schema_version"], doc["model"], doc["language"], doc["duration"]) == (1, "stub", "en", 9.0)
    assert doc["segments"][0] == {"start": 0.5, "end": 2.0, "text": "Hi & <you>", "speaker": "SPEAKER_00", "words": [{"start": 0.5, "end": 1.0, "text": "Hi", "speaker": "SPEAKER_00"}]}
    assert set(doc["segments"][1]) == {"start", "end", "text"}
    with pytest.raises(ValueError):
        subtitles.render(df, "pdf")


def test_freshness_and_collisions(spark):
    when = lambda k: f"2024-01-01 00:00:{k:02d}"
    inputs = spark.createDataFrame([("a", when(10)), ("b", when(10)), ("c", None), ("d", when(10))], "path string, t string").select("path", F.to_timestamp("t").alias("mtime"))
    out = [("a", "txt", when(10)), ("a", "srt", when(11)), ("b", "txt", when(20)), ("b", "srt", when(9)), ("c", "txt", when(9)), ("c", "srt", when(9)), ("d", "txt", when(30))]
    out = spark.createDataFrame(out, "path string, format string, t string").select("path", "format", F.to_timestamp("t").alias("mtime"))
    formats = spark.createDataFrame([("txt",), ("srt",)], "format string")
    assert {r["path"]: r["fresh"] for r in outputs.fresh_inputs(inputs, out, formats).collect()} == {"a": True, "b": False, "c": False, "d": False}
    assert outputs.stale_inputs(inputs, out, formats, force=True).count() == 4
    files = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert outputs.first_collision(files("/a/x.wav", "/a/y.wav"), ("txt", "srt")) is None
    assert outputs.first_collision(files("/a/x.mp3", "/a/x.wav"), ("txt",)) == "/a/x.mp3 and /a/x.wav both write /a/x.txt"
    assert "one file where case does not count" in outputs.first_collision(files("/a/X.wav", "/b/x.wav"), ("txt", "srt"), "/o")


def test_exit_codes(spark):
    rows = spark.createDataFrame([("a", 10.0, 2.0, "done"), ("b", 5.0, 1.0, "failed"), ("c", 0.0, 0.0, "skipped")], "name string, duration double, wall double, outcome string")
    s = batch.summary(rows).first()
    assert (s["done"], s["skipped"], s["failed"], s["speed"]) == (1, 1, 1, "5.0×RT")
    code = lambda df, **k: batch.batch_exit_code(df, **k).first()["exit_code"]
    good = rows.filter("outcome <> 'failed'")
    assert (code(rows), code(good), code(good, interrupted=True, total=2), code(good, interrupted=True, total=3)) == (20, 0, 0, 20)


def two_voices(seconds=24):
    rate, parts = 16_000, []
    for k in range(seconds // 4):
        parts.append(tone(200 if k % 2 == 0 else 3000, 4, rate))
    return np.concatenate(parts)


def test_diarization_with_stand_ins(spark):
    x = two_voices().astype(np.float32)
    audio = spark.createDataFrame([(1, x.tolist()), (2, [0.0] * 50_000), (3, None)], "file_id long, samples array<float>")
    turns, errors = diarize.diarize(audio, StubSpeakers())
    rows = sorted(turns.collect(), key=lambda r: r["start"])
    assert {r["file_id"] for r in rows} == {1} and {r["speaker"] for r in rows} == {0, 1} and errors.count() == 0
    talk = {r["speaker"]: r["seconds"] for r in outputs.talk_time(turns).collect()}
    assert all(abs(v - 12) < 1 for v in talk.values())
    one_voice, _ = diarize.diarize(audio, StubSpeakers(), num_speakers=1)
    assert {r["speaker"] for r in one_voice.collect()} == {0}


def test_whole_job(spark, tmp_path):
    class Broken(StubTranscriber):
        def transcribe(self, *a):
            raise RuntimeError("no model")

    class Mute(StubSpeakers):
        def embed(self, rows):
            raise ValueError("not finite")

    (tmp_path / "talk.wav").write_bytes(wav(two_voices()))
    (tmp_path / "silent.wav").write_bytes(wav(np.zeros(32_000)))
    (tmp_path / "bad.mp3").write_bytes(b"?")
    formats = ("txt", "srt", "vtt", "tsv", "csv", "json")
    options = JobOptions(inputs=(str(tmp_path),), formats=formats, out_dir=str(tmp_path / "out"), diarize=True, model="tiny")
    listing = transcribe.run(spark, JobOptions(**(options.__dict__ | {"explain_only": True})), StubTranscriber())
    assert listing.count() == 18 and os.listdir(tmp_path / "out") == []
    rows = {r["path"].split("/")[-1]: r for r in transcribe.run(spark, options, StubTranscriber(), StubSpeakers()).collect()}
    assert {k: r["outcome"] for k, r in rows.items()} == {"talk.wav": "done", "silent.wav": "done", "bad.mp3": "failed"}
    assert "bad.mp3" in rows["bad.mp3"]["reason"] and rows["talk.wav"]["duration"] == 24 and len(rows["talk.wav"]["outputs"]) == 6
    assert (tmp_path / "out/silent.txt").read_text() == "" and (tmp_path / "out/silent.csv").read_text() == "start,end,text,speaker\n"
    doc = json.loads((tmp_path / "out/talk.json").read_text())
    assert doc["model"] == "stub" and len(doc["segments"]) == 24 and {s["speaker"] for s in doc["segments"]} == {"SPEAKER_00", "SPEAKER_01"}
    assert doc["segments"][0]["words"][0]["text"] == "second" and json.loads((tmp_path / "out/silent.json").read_text())["segments"] == []
    assert not [p for p in os.listdir(tmp_path / "out") if p.endswith(".tmp")]
    again = {r["outcome"] for r in transcribe.run(spark, options, StubTranscriber(), StubSpeakers()).collect() if "bad" not in r["path"]}
    assert again == {"skipped"}
    time.sleep(0.01)
    forced = JobOptions(**(options.__dict__ | {"force": True, "formats": ("txt",)}))
    mute = {r["path"].split("/")[-1]: r for r in transcribe.run(spark, forced, StubTranscriber(), Mute()).collect()}
    assert mute["talk.wav"]["outcome"] == "failed" and "transcript saved" in mute["talk.wav"]["reason"] and mute["talk.wav"]["outputs"]
    assert "Speaker" not in (tmp_path / "out/talk.txt").read_text()
    plain = JobOptions(inputs=options.inputs, force=True, out_dir=options.out_dir, model="tiny")
    assert {r["outcome"] for r in transcribe.run(spark, plain, Broken()).collect()} == {"failed"}


def test_checks_before_work(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"")
    (tmp_path / "a.mp3").write_bytes(b"")
    for options, code in ((JobOptions(), 2), (JobOptions(inputs=("/nowhere",)), 14), (JobOptions(inputs=(str(tmp_path),), model="large-v3"), 12), (JobOptions(inputs=(str(tmp_path),), model="tiny", task="translate"), 2), (JobOptions(inputs=(str(tmp_path),), model="tiny"), 2)):
        with pytest.raises(EngineError) as e:
            transcribe.run(spark, options, StubTranscriber(), ram=4 << 30)
        assert e.value.code == code


def test_stream_over_a_folder(spark, tmp_path):
    folder_, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")
    os.makedirs(folder_)
    (tmp_path / "in/a.WAV").write_bytes(wav(tone(300, 1, 16_000)))
    (tmp_path / "in/notes.txt").write_bytes(b"no")
    folder.decode_stream(spark, folder_, out, at).awaitTermination(120)
    (tmp_path / "in/b.wav").write_bytes(b"?")
    folder.decode_stream(spark, folder_, out, at).awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert sorted((os.path.basename(r["path"]), r["status"]) for r in rows) == [("a.WAV", "pcm"), ("b.wav", "failed")]


def test_events_as_a_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    df = spark.range(200).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("id") * 60)).alias("ts"), F.concat(F.lit("k"), F.col("id") % 3).alias("event_type"), F.col("id").cast("double").alias("value"))
    df.repartition(4).write.parquet(src)
    stream = folder.activity_windows(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src), late="1 day")
    q = stream.writeStream.format("memory").queryName("act").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("act").collect())) == sorted(map(str, folder.activity_windows(df).collect()))


def test_command_line(spark, tmp_path, capsys):
    from voxloom.__main__ import main

    (tmp_path / "a.wav").write_bytes(wav(tone(300, 2, 16_000)))
    common = [str(tmp_path), "--out-dir", str(tmp_path / "o"), "--model", "tiny"]
    assert main([*common, "--dry-run", "--format", "srt,txt"]) == 0
    assert capsys.readouterr().out.split("\n")[0] == f"{tmp_path}/a.wav -> {tmp_path}/o/a.srt"
    assert main([*common, "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["model"] == "stub"
    assert main([*common, "--json"]) == 0 and "1 skipped" in capsys.readouterr().err
    assert main(["/nowhere/at/all"]) == 14 and main([str(tmp_path), "--format", "pdf"]) == 2
    assert main(["models", "list", "--cache", str(tmp_path)]) == 0 and "large-v3-turbo" in capsys.readouterr().out
    assert main(["models", "pull", "tiny", "--cache", str(tmp_path), "--offline"]) == 11


def slow_transcriber():
    class Slow(StubTranscriber):
        marker = os.environ["SLOW_MARKER"]

        def transcribe(self, *a):
            open(self.marker, "w").close()
            time.sleep(90)

    return Slow()


def test_interrupt(spark, tmp_path, capsys, monkeypatch):
    from voxloom.__main__ import main
    from voxloom.session import interruptible

    marker = tmp_path / "begun"
    monkeypatch.setenv("SLOW_MARKER", str(marker))
    (tmp_path / "a.wav").write_bytes(wav(tone(300, 1, 16_000)))
    (tmp_path / "b.wav").write_bytes(wav(tone(300, 1, 16_000)))
    (tmp_path / "b.txt").write_text("")  # done before

    def press():
        while not marker.exists():
            time.sleep(0.1)
        os.kill(os.getpid(), signal.SIGINT)

    before, began = signal.getsignal(signal.SIGINT), time.time()
    threading.Thread(target=press, daemon=True).start()
    assert main([str(tmp_path), "--model", "tiny", "--transcriber", "test_jobs:slow_transcriber"]) == 20
    assert marker.exists() and time.time() - began < 60
    assert not list(spark.sparkContext.statusTracker().getActiveJobsIds()) and not (tmp_path / "a.txt").exists()
    err = capsys.readouterr().err
    assert "1 of 2 with outputs, interrupted" in err and "1 of 2 files" in err
    assert signal.getsignal(signal.SIGINT) is before and not spark.sparkContext.getJobTags()
    with interruptible(spark) as state:  # begins anew
        assert spark.range(3).count() == 3 and spark.sparkContext.getJobTags()
    assert not state["interrupted"]
    assert main([str(tmp_path), "--model", "tiny", "--threads", "0"]) == 2


def fetched(name, path):
    path.write_bytes(name.encode())


def test_fetch_and_diarization_pair(tmp_path, capsys, monkeypatch):
    from voxloom.__main__ import main
    from voxloom.sources import models

    digest = lambda n: __import__("hashlib").sha256(n.encode()).hexdigest()
    monkeypatch.setattr(models, "DIARIZATION", [(n, n + ".onnx", size, digest(n)) for n, size in (("segmentation", 1024), ("embedding", 512))])
    cache = models.ModelCache(str(tmp_path))
    assert cache.diarization() == {"model": "diarization", "size": 1536, "cached": False}
    at = ["--cache", str(tmp_path)]
    assert main(["models", "pull", "diarization", *at]) == 11 and "nothing is named" in capsys.readouterr().err
    assert main(["models", "pull", "segmentation", "--fetch", "test_jobs:fetched", *at]) == 0 and not cache.diarization()["cached"]
    assert main(["models", "pull", "diarization", "--fetch", "test_jobs:fetched", *at]) == 0 and cache.diarization()["cached"]
    assert main(["models", "pull", "tiny", "--fetch", "test_jobs:fetched", *at]) == 11 and "digest" in capsys.readouterr().err
    assert main(["models", "list", *at]) == 0
    line = capsys.readouterr().out.strip().split("\n")[-1].split()
    assert line == ["diarization", "1.5", "KB", "cached"]
    assert main(["models", "remove", "diarization", *at]) == 0 and not cache.diarization()["cached"]


def test_threads_become_task_cores():
    from voxloom.plans.resources import thread_settings

    assert thread_settings(None, 8) == {}
    assert thread_settings(3, 8) == {"spark.task.cpus": "3", "spark.executorEnv.OMP_NUM_THREADS": "3"}
    assert thread_settings(99, 8)["spark.task.cpus"] == "8"
